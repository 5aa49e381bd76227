"""Scalar expressions over columns: categories, guards, transforms and tails."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

# Elapsed-time categories in order, with the largest gap of each.
GAP_CATEGORIES = (("1_year", 1), ("2_years", 2), ("3_5_years", 5), ("6_10_years", 10), ("gt10_years", None))
#: Two-sided 95 % point of the normal distribution.
Z95 = 1.959963984540054


def gap_category(gap: Column) -> Column:
    """Name of the elapsed-time category; null for null and for gaps below 1."""
    out = F.when(gap.isNull() | (gap < 1), F.lit(None).cast("string"))
    for name, most in GAP_CATEGORIES:
        out = out.otherwise(name) if most is None else out.when(gap <= most, name)
    return out


def gap_ordinal(category: Column) -> Column:
    """Place of a category in their order, from 1."""
    out = F.lit(None).cast("int")
    for i, (name, _) in enumerate(GAP_CATEGORIES, 1):
        out = F.when(category == name, i).otherwise(out)
    return out


def first_match(cases: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The value of the first case that holds."""
    out = F.lit(default).cast("string")
    for condition, value in reversed(cases):
        out = F.when(condition, value).otherwise(out)
    return out


def count_of(raw: Column) -> Column:
    """A response count: numbers as they are, all else 0 (also what is no number), nothing below 0."""
    return F.greatest(F.nanvl(F.coalesce(raw.try_cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0))


def flag_of(raw: Column) -> Column:
    """1 where a flag is above 0, else 0."""
    return (count_of(raw) > 0).cast("double")


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text.cast("string"), r"^\s+|\s+$", "")


def normalised(text: Column) -> Column:
    return F.lower(trimmed(text))


def harmonised(code: Column, groups: dict[str, str]) -> Column:
    """Codes replaced by the group they belong to."""
    if not groups:
        return code
    table = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), code)


def rate(hits: Column, of: Column) -> Column:
    """hits / of; null where there's nothing to divide by."""
    return F.when(of > 0, hits / of)


def expit(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column, edge: float = 1e-8) -> Column:
    """Log odds of a probability kept off 0 and 1."""
    kept = F.greatest(F.least(p, F.lit(1 - edge)), F.lit(edge))
    return F.log(kept / (1 - kept))


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def quantised(x: Column, tolerance: float) -> Column:
    """The grid line nearest to x, halves to even."""
    return F.rint(x / tolerance).cast("long")


def labelled(code: Column, labels: dict[str, str]) -> Column:
    return harmonised(code, labels)


def spread_or_error(sd: Column, what: str) -> Column:
    """A standard deviation that is positive and finite; any other raises when read."""
    bad = sd.isNull() | F.isnan(sd) | (sd <= 0) | (sd == float("inf"))
    return F.when(bad, F.raise_error(F.lit(f"no spread in {what}")).cast("double")).otherwise(sd)


def number(raw: Column) -> Column:
    """A double, or null for what is none: not-a-number counts as missing."""
    x = raw.cast("double")
    return F.when(~F.isnan(x), x)


def zscored(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """df with z-scores by sample standard deviation over all its rows, named by column: a one-row aggregate beside each row.

    A column without spread raises: all its scores would be missing, and complete cases would drop every row.
    """
    own = {c: number(F.col(c)) for c in names}
    stats = df.agg(*[x for i, c in enumerate(names) for x in (F.avg(own[c]).alias(f"_mean{i}"), F.stddev_samp(own[c]).alias(f"_sd{i}"))])
    scores = {name: (own[c] - F.col(f"_mean{i}")) / spread_or_error(F.col(f"_sd{i}"), c) for i, (c, name) in enumerate(names.items())}
    return df.join(F.broadcast(stats)).withColumns(scores).drop(*[f"_{k}{i}" for i in range(len(names)) for k in ("mean", "sd")])


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def chi2_tail(x: float, df: int) -> float:
    """Upper tail of a chi-square distribution, from that of one or two degrees of freedom on."""
    if df % 2:
        return math.erfc(math.sqrt(x / 2)) + sum((x / 2) ** (k / 2) * math.exp(-x / 2) / math.gamma(k / 2 + 1) for k in range(1, df - 1, 2))
    term = total = 1.0
    for i in range(1, df // 2):
        term *= x / 2 / i
        total += term
    return math.exp(-x / 2) * total


def holm(df: DataFrame, p: str, family: list[str], order: list[str], name: str = "p_holm") -> DataFrame:
    """Holm's step-down p-values within each family; null p-values stay null and don't count."""
    known = df.where(F.col(p).isNotNull())
    ordered = Window.partitionBy(*family).orderBy(p, *order)
    m = F.count("*").over(Window.partitionBy(*family))
    scaled = known.withColumn("_step", (m - F.row_number().over(ordered) + 1) * F.col(p))
    out = scaled.withColumn(name, F.least(F.lit(1.0), F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)))).drop("_step")
    return out.unionByName(df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double")))
