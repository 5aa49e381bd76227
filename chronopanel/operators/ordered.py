"""Prefix sums of groups of any size, and the rows and quantiles at given ranks.

For prefix sums a group is cut into slices by its approximate quantiles first. The cuts only decide how the work is dealt; sums
are exact. A slice holds about 1 / SLICES of its group, however hot the group, as long as its keys differ; rows of equal keys are summed up before
they come here. Where only some ranks are asked for, they are found by radix: sums by the leading bits of an order-preserving key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from chronopanel.sources.tables import written

SLICES = 64


def text_order(text: Column) -> Column:
    """A number in the order of text: its first 7 bytes, so that slices can be cut by it; texts alike in these share one."""
    padded = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), 1, 7)), 14, "0")
    return F.conv(padded, 16, 10).cast("double")


def prefix_sums(df: DataFrame, by: list[str], key: Column, order: list[Column], sums: dict[str, Column], descending: bool = False) -> DataFrame:
    """df with, for each name of sums, the sum over the rows of its group (``by``) up to and with each one.

    Rows go by ``key`` (a number; largest first where descending) and then by ``order``, which must agree with it.
    """
    sign = -1 if descending else 1
    df = df.withColumns({"_key": sign * key, **{f"_a{i}": c for i, c in enumerate(sums.values())}})
    cuts = F.percentile_approx("_key", F.array(*[F.lit(i / SLICES) for i in range(1, SLICES)]), 10 * SLICES)
    edges = df.groupBy(*by).agg(F.array_distinct(cuts).alias("_edges"))
    df = df.join(edges, by) if by else df.join(F.broadcast(edges))
    df = df.withColumn("_slice", F.size(F.filter("_edges", lambda e: e < F.col("_key")))).drop("_edges")
    names = range(len(sums))
    slices = df.groupBy(*by, "_slice").agg(*[F.sum(f"_a{i}").alias(f"_s{i}") for i in names])
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = slices.select(*by, "_slice", *[F.coalesce(F.sum(f"_s{i}").over(before), F.lit(0)).alias(f"_b{i}") for i in names])
    within = Window.partitionBy(*by, "_slice").orderBy("_key", *order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumns({f"_w{i}": F.sum(f"_a{i}").over(within) for i in names}).join(starts, [*by, "_slice"])
    out = out.withColumns({name: F.col(f"_b{i}") + F.col(f"_w{i}") for i, name in enumerate(sums)})
    return out.drop("_key", "_slice", *[f"_{c}{i}" for c in "abw" for i in names])


def order_key(value: Column) -> Column:
    """A 64-bit integer in the order of doubles: sign, exponent and mantissa as they are laid out. NaN is the largest."""
    whole = F.abs(value.cast("double"))
    size = F.when(whole < float("inf"), whole).otherwise(1.0)
    least = 2.0**-1022
    near = F.pow(F.lit(2.0), F.floor(F.least(F.log2(F.greatest(size, F.lit(least))), F.lit(1023.0))))
    # the logarithm may be off by one next to a power of two; halves and doubles are exact
    power = F.when(near > F.greatest(size, F.lit(least)), near / 2).when(near * 2 <= size, near * 2).otherwise(near)
    exponent = F.when(size < least, 0).otherwise(F.round(F.log2(power)).cast("long") + 1023)
    fraction = F.when(size < least, size / least).otherwise(size / power - 1)
    key = F.when(whole == float("inf"), F.lit(2047 << 52)).otherwise(exponent * F.lit(1 << 52) + (fraction * float(1 << 52)).cast("long"))
    return F.when(F.isnan(whole), F.lit((1 << 63) - 1)).when(value < 0, -key).otherwise(key)


def text_key(text: Column, skip: Column) -> Column:
    """A 63-bit integer in the order of texts that share their first ``skip`` bytes, by the seven next ones."""
    padded = F.rpad(F.hex(F.substring(F.encode(text, "UTF-8"), skip + 1, F.lit(7))), 14, "0")
    return F.shiftleft(F.conv(padded, 16, 10).cast("long"), 7)


def at_ranks(rows: DataFrame, by: list[str], key: str, order: list[str], weight: str, sums: list[str], wanted: DataFrame) -> DataFrame:
    """The rows at which the running ``weight`` of their group reaches given ranks, with that rank and the sums of all rows before: rank, before_weight, before_….

    wanted has (by…, ranks): whole numbers from 1 to the group's weight. Selection by radix: sums of the first 16 bits of ``key`` (a long) say which
    buckets hold a rank, those of the next 16 bits within them the same, and only the rows of these buckets are put in order, by key and ``order``.
    So a group of any size has 65,536 sums in a window, and its rows are never in one task, unless they share 32 bits of key.
    rows is read three times: store it first where it's dear.
    """
    names = [weight, *sums]
    found, held = wanted.select(*by, "ranks", *[F.lit(0).alias(f"_b_{c}") for c in names]), by
    for bits in (48, 32):
        bucket = f"_bucket{bits}"
        rows = rows.withColumn(bucket, F.shiftright(key, bits))
        joined = rows.join(found, held) if held else rows.join(F.broadcast(found))
        counted = joined.groupBy(*held, bucket).agg(*[F.sum(c).alias(c) for c in names], *[F.first(c).alias(c) for c in ("ranks", *[f"_b_{c}" for c in names])])
        found = _holding(counted, Window.partitionBy(*held).orderBy(bucket), names, weight)
        held = [*by, bucket]
        found = found.select(*held, "ranks", *[f"_b_{c}" for c in names])
    kept = [c for c in rows.columns if not c.startswith("_bucket")]
    last = _holding(rows.join(found, held), Window.partitionBy(*held).orderBy(key, *order), names, weight)
    return last.select(*kept, F.explode("ranks").alias("rank"), *[F.col(f"_b_{c}").alias(f"before_{c}") for c in names])


def _holding(rows: DataFrame, window, names: list[str], weight: str) -> DataFrame:
    """Of rows with the sums before their window (_b_…) those that hold a rank; with the sums before each row, and its ranks."""
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({f"_s_{c}": F.sum(c).over(upto) for c in names}).withColumns({f"_b_{c}": F.col(f"_b_{c}") + F.col(f"_s_{c}") - F.col(c) for c in names})
    own = F.filter("ranks", lambda r: (r > F.col(f"_b_{weight}")) & (r <= F.col(f"_b_{weight}") + F.col(weight)))
    return rows.withColumn("ranks", own).where(F.size("ranks") > 0)


def quantiles(df: DataFrame, by: list[str], value: str, shares: list[float], weight: str | None = None) -> DataFrame:
    """(by…, quantiles): exact quantiles of each group with linear interpolation; nulls don't count. A row stands for ``weight`` rows (1 by default)."""
    number = F.sum(weight) if weight else F.count("*")
    each = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("_v")).agg(number.alias("_n")).where("_n > 0")
    each = written(each.withColumn("_k", order_key(F.col("_v"))), "quantiles-values", keep=True)
    totals = each.groupBy(*by).agg(F.sum("_n").alias("_total"))
    at = F.array(*[F.lit(float(q)) for q in shares])
    place = lambda end: F.transform(at, lambda q: end(q * (F.col("_total") - 1)).cast("long") + 1)
    wanted = totals.where("_total > 0").select(*by, F.array_distinct(F.concat(place(F.floor), place(F.ceil))).alias("ranks"), "_total")
    held = at_ranks(each, by, "_k", [], "_n", [], wanted.drop("_total"))
    values = held.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "_v"))).alias("_values"))
    out = values.join(wanted, by) if by else values.join(F.broadcast(wanted))

    def quantile(q):
        p = q * (F.col("_total") - 1)
        low, high = (F.element_at("_values", end(p).cast("long") + 1) for end in (F.floor, F.ceil))
        return low + (p - F.floor(p)) * (high - low)

    return out.select(*by, F.transform(at, quantile).alias("quantiles"))
