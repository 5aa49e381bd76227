"""Event histories of (unit, period) panels: what each row knew strictly before its own period.

All columns of a history come from one window, by unit in the order of periods, over earlier rows only, so a panel is
shuffled and sorted once for any number of responses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.functions.scalar import count_of, first_match, flag_of, gap_category, gap_ordinal, normalised
from chronopanel.sources.contract import ContractError, resolved

RESPONSES = ("landslide_count", "active", "shallow_count", "shallow_active")


def derive_response(panel: DataFrame, events: DataFrame | None = None) -> DataFrame:
    """Counts of both responses as doubles, and activity as 0/1 integers.

    The total comes from a count column, else from the events where there are any, else from an activity flag (1 where it is
    above 0). The shallow response comes from its count column or flag, else from the events of type shallow. Without a source a response raises.
    """
    own = resolved(panel.columns, RESPONSES)
    total, shallow = (own.get("landslide_count"), None if events is not None else own.get("active")), (own.get("shallow_count"), own.get("shallow_active"))
    derived = {"_n": not any(total), "_shallow": not any(shallow)}
    if any(derived.values()):
        if events is None:
            raise ContractError(f"no {'overall' if derived['_n'] else 'shallow'} response: neither a column of the panel nor events")
        kind = resolved(events.columns, ["landslide_type"]).get("landslide_type")
        if derived["_shallow"] and kind is None:
            raise ContractError("no shallow response: the panel has no column for it and the events no type")
        some = {"_n": F.count("*"), "_shallow": F.count_if(normalised(F.col(f"`{kind}`")) == "shallow") if kind else F.lit(0)}
        counted = events.where(F.col("su_id").isNotNull() & F.col("year").isNotNull()).groupBy("su_id", "year").agg(*[some[k].alias(k) for k, wanted in derived.items() if wanted])
        panel = panel.join(counted, ["su_id", "year"], "left")
    source = lambda count, flag, name: count_of(F.col(f"`{count}`")) if count else flag_of(F.col(f"`{flag}`")) if flag else count_of(F.col(name))
    rest = [F.col(f"`{c}`") for c in panel.columns if c not in {"su_id", "year", "_n", "_shallow", *own.values(), *RESPONSES}]
    out = panel.select("su_id", "year", *rest, source(*total, "_n").alias("landslide_count"), source(*shallow, "_shallow").alias("shallow_count"))
    return out.withColumns({"active": (F.col("landslide_count") > 0).cast("int"), "shallow_active": (F.col("shallow_count") > 0).cast("int")})


def history_block(panel: DataFrame, prefix: str, missing_years: list[int]) -> DataFrame:
    """Columns of one response's history; prefix is '' or 'shallow_'."""
    count, active = ("landslide_count", "active") if not prefix else ("shallow_count", "shallow_active")
    earlier = Window.partitionBy("su_id").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col(active) == 1, F.col("year")), ignorenulls=True).over(earlier)
    names = {k: k.format(p=prefix) for k in ("prior_{p}landslide_count", "prior_{p}active_years", "prior_{p}failure", "last_{p}active_year", "years_since_last_{p}activity", "{p}history_crosses_missing_gap")}
    n, k, failed, at, since, crosses = names.values()
    df = panel.withColumns({n: F.coalesce(F.sum(count).over(earlier), F.lit(0.0)), k: F.coalesce(F.sum(active).over(earlier), F.lit(0)).cast("int"), at: last.cast("int")})
    between = F.exists(F.array(*[F.lit(y).cast("int") for y in missing_years]), lambda y: (F.col(at) < y) & (y < F.col("year"))) if missing_years else F.lit(False)
    df = df.withColumns({failed: (F.col(k) > 0).cast("int"), since: F.col("year") - F.col(at), crosses: F.coalesce(between, F.lit(False)).cast("int")})
    return df.withColumn("gap_shallow_category" if prefix else "gap_time_category", gap_category(F.col(since)))


def build_history(panel: DataFrame, missing_years: list[int]) -> DataFrame:
    """A panel with responses, as a history panel: both blocks, classes and transforms."""
    df = history_block(history_block(panel, "", missing_years), "shallow_", missing_years)
    active, before, k = F.col("active") == 1, F.col("prior_failure") == 1, F.col("prior_active_years")
    first_year = F.col("year") == F.min("year").over(Window.partitionBy("su_id").orderBy("year").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumns({
        "previously_active_state": F.when(before, "previously_active").otherwise("never_previously_active"),
        "activity_class": first_match([(active & first_year, "active_history_unknown"), (active & ~before, "first_observed_activation"), (active & before, "recurrent_activity")], "inactive"),
        "recurrence_stage": first_match([(k == 1, "1_prior_active_year"), (k == 2, "2_prior_active_years"), (k >= 3, "3plus_prior_active_years")]),
        "prior_active_years_log1p": F.log1p("prior_active_years"),
        "prior_landslide_count_log1p": F.log1p("prior_landslide_count"),
        "prior_shallow_active_years_log1p": F.log1p("prior_shallow_active_years"),
    })


def risk_set(history: DataFrame, prefix: str = "") -> DataFrame:
    """Rows with an earlier event, whose history crosses no missing year and has a gap category."""
    category = "gap_shallow_category" if prefix else "gap_time_category"
    return history.where((F.col(f"prior_{prefix}failure") == 1) & (F.col(f"{prefix}history_crosses_missing_gap") == 0) & F.col(category).isNotNull())


def risk_support(history: DataFrame) -> DataFrame:
    """Per category of the risk set: rows, active ones, units and their rate; categories without rows are left out."""
    return (
        risk_set(history).groupBy("gap_time_category")
        .agg(F.count("*").alias("n_slope_unit_years"), F.sum("active").cast("long").alias("active_outcomes"), F.count_distinct("su_id").alias("n_slope_units"))
        .withColumn("observed_rate", F.col("active_outcomes") / F.col("n_slope_unit_years"))
        .orderBy(gap_ordinal(F.col("gap_time_category")))
    )


def year_audit(history: DataFrame) -> DataFrame:
    whole = lambda c: F.sum(c).cast("long")
    return history.groupBy("year").agg(F.count_distinct("su_id").alias("slope_units"), whole("active").alias("active_slope_units"), whole("landslide_count").alias("landslides"), whole("shallow_active").alias("shallow_active_slope_units"), whole("shallow_count").alias("shallow_landslides"))


def exclusion_audit(history: DataFrame) -> DataFrame:
    """Per analysis and year: rows, those before any event, those whose history crosses a gap, and those retained."""
    out = None
    for analysis, p in (("recurrence", ""), ("rainfall_history", "shallow_")):
        first = F.count_if(F.col(f"prior_{p}failure") == 0)
        crossing = F.count_if((F.col(f"prior_{p}failure") == 1) & (F.col(f"{p}history_crosses_missing_gap") == 1))
        one = history.groupBy("year").agg(F.count("*").alias("slope_unit_years"), first.alias("pre_first_excluded"), crossing.alias("gap_crossing_excluded_from_risk"))
        one = one.withColumn("retained_risk_rows", F.col("slope_unit_years") - F.col("pre_first_excluded") - F.col("gap_crossing_excluded_from_risk")).withColumn("analysis", F.lit(analysis))
        out = one if out is None else out.unionByName(one)
    return out


def exclusion_summary(audit: DataFrame, prediction: DataFrame | None = None) -> DataFrame:
    """Sums of an exclusion audit by analysis, and those of the prediction's exclusions (:func:`audit.prediction_exclusions`) as one more row."""
    whole = lambda c, name: F.sum(c).cast("long").alias(name)
    out = audit.groupBy("analysis").agg(whole("slope_unit_years", "potential_slope_unit_years"), whole("pre_first_excluded", "pre_first_excluded"), whole("gap_crossing_excluded_from_risk", "gap_crossing_excluded"), whole("retained_risk_rows", "retained_risk_rows"))
    if prediction is None:
        return out
    sums = prediction.agg(whole("potential_slope_unit_years", "potential_slope_unit_years"), F.lit(None).cast("long").alias("pre_first_excluded"), whole("excluded_history_crosses_gap", "gap_crossing_excluded"), whole("retained_prediction_rows", "retained_risk_rows"))
    return out.unionByName(sums.withColumn("analysis", F.lit("forward_prediction_test_set")))


def activity_matrix(history: DataFrame, years: list[int]) -> DataFrame:
    """(su_id, mask): bit i is set where the unit was active in the i-th year; only units that ever were."""
    place = F.create_map(*[F.lit(x) for i, y in enumerate(sorted(years)) for x in (y, i)])
    active = history.where("active = 1").select("su_id", F.element_at(place, F.col("year")).alias("i"))
    return active.groupBy("su_id").agg(F.bit_or(F.expr("shiftleft(1L, i)")).alias("mask"))


def wide_activity(history: DataFrame, years: list[int]) -> DataFrame:
    """One row a unit with a 0/1 column for each year."""
    return history.groupBy("su_id").agg(*[F.max(F.when(F.col("year") == y, F.col("active")).otherwise(0)).cast("int").alias(f"y{y}") for y in sorted(years)])
