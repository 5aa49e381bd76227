"""Covariates of panels: climatology, within and between effects, dominant cells, lags, and complete cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.scalar import number, spread_or_error
from chronopanel.operators.ordered import prefix_sums, text_order


def climatology(covariate: DataFrame, value: str) -> DataFrame:
    """Mean and sample standard deviation of each unit over all its periods; one period has no deviation."""
    x = number(F.col(value))
    return covariate.groupBy("su_id").agg(F.avg(x).alias("unit_mean"), F.stddev_samp(x).alias("unit_sd"))


def within_between(frame: DataFrame, covariate: DataFrame, value: str) -> DataFrame:
    """frame with {value}_within_z, the deviation from the unit's own climatology in its deviations, and {value}_between_z, the
    unit's mean standardised over the distinct units of the frame.

    A unit of one period has no deviation and a null score; a deviation of 0, of a unit or between units, raises.
    """
    unit = climatology(covariate, value)
    units = frame.select("su_id").distinct().join(unit, "su_id")
    spread = units.agg(F.avg("unit_mean").alias("_m"), F.stddev_samp("unit_mean").alias("_s"))
    between = (F.col("unit_mean") - F.col("_m")) / spread_or_error(F.col("_s"), f"unit means of {value}")
    within = F.when(F.col("unit_sd").isNotNull(), (number(F.col(value)) - F.col("unit_mean")) / spread_or_error(F.col("unit_sd"), f"{value} of a unit"))
    out = frame.join(unit, "su_id", "left").join(F.broadcast(spread))
    return out.withColumns({f"{value}_within_z": within, f"{value}_between_z": F.when(F.col("unit_mean").isNotNull(), between)}).drop("unit_mean", "unit_sd", "_m", "_s")


def centred(frame: DataFrame, covariate: DataFrame, value: str, name: str) -> DataFrame:
    """frame with ``name``: the value less its unit's mean over all periods of the covariate."""
    mean = covariate.groupBy("su_id").agg(F.avg(number(F.col(value))).alias("_mean"))
    return frame.join(mean, "su_id", "left").withColumn(name, number(F.col(value)) - F.col("_mean")).drop("_mean")


def dominant_cell(weights: DataFrame) -> DataFrame:
    """The cell of the largest weight of each unit, ties to the first by name: one aggregate, no sort."""
    best = F.min(F.struct((-F.col("weight")).alias("less"), "grid_id"))
    return weights.where(F.col("weight").isNotNull()).groupBy("su_id").agg(best.alias("best")).select("su_id", "best.grid_id", (-F.col("best.less")).alias("weight"))


def lagged(covariate: DataFrame, values: list[str]) -> DataFrame:
    """Covariates of the calendar year before: (su_id, year, {value}_lag1, rainfall_source_year)."""
    return covariate.select("su_id", (F.col("year") + 1).cast("int").alias("year"), F.col("year").alias("rainfall_source_year"), *[F.col(v).alias(f"{v}_lag1") for v in values])


def missing_report(frame: DataFrame, required: list[str], analysis: str) -> DataFrame:
    """Rows without each required column, and without any: one pass, then unpivoted."""
    counts = [F.count_if(F.col(c).isNull()).alias(c) for c in required]
    anything = F.count_if(F.greatest(*[F.col(c).isNull().cast("int") for c in required]) == 1 if len(required) > 1 else F.col(required[0]).isNull()).alias("ANY_REQUIRED")
    wide = frame.agg(*counts, anything)
    long = wide.unpivot([], [*required, "ANY_REQUIRED"], "variable", "missing_rows")
    return long.select(F.lit(analysis).alias("analysis"), "variable", "missing_rows")


def complete_cases(frame: DataFrame, required: list[str]) -> DataFrame:
    return frame.dropna(subset=required)


def static_features(terrain: DataFrame, materials: DataFrame, area: str = "su_area_m2", areas: DataFrame | None = None) -> DataFrame:
    """Unit attributes with log_su_area; an area that is null or not positive raises when read.

    areas (su_id, area) is joined where neither of the tables has the area.
    """
    out = terrain.join(materials, "su_id", "left")
    if area not in out.columns and areas is not None:
        out = out.join(areas.select("su_id", area), "su_id", "left")
    size = F.col(area).cast("double")
    bad = size.isNull() | F.isnan(size) | (size <= 0)
    return out.withColumn("log_su_area", F.when(bad, F.raise_error(F.lit("an area is missing or not positive")).cast("double")).otherwise(F.log(size)))


def cluster_codes(frame: DataFrame, key: str) -> DataFrame:
    """(key, code): distinct keys numbered from 0 in their order; prefix sums over slices of the keys, so no task has all of them."""
    distinct = frame.select(key).where(F.col(key).isNotNull()).distinct()
    numbered = prefix_sums(distinct, [], text_order(F.col(key)), [F.col(key)], {"_n": F.lit(1)})
    return numbered.select(key, (F.col("_n") - 1).cast("int").alias("code"))
