"""Audits: leakage, exclusions, comparison of tables, and tables of checks and results."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column


def leakage_checks(rows: DataFrame, features: list[str], current: list[str]) -> DataFrame:
    """(check, passed, detail): rows has test_year, max_training_year and rainfall_source_year; features are the models' columns, current
    the covariates of the target year, which must not be among them. Source years that are missing don't count."""
    test, last, source = F.col("test_year"), F.col("max_training_year"), F.col("rainfall_source_year")
    first = rows.agg(F.min("test_year").alias("first"))
    leaks = sorted(set(features) & set(current))
    row = rows.join(F.broadcast(first)).agg(
        F.count_if(~F.coalesce(last < test, F.lit(False))).alias("all_max_training_year_before_test_year"),
        F.count_if((test == F.col("first")) & ~F.coalesce(last == test - 1, F.lit(False))).alias("first_test_year_uses_previous_year_as_latest_training_year"),
        F.count_if(source.isNotNull() & (source != test - 1)).alias("all_nonmissing_rainfall_sources_are_t_minus_1"),
        F.lit(len(leaks)).cast("long").alias("no_current_year_rainfall_in_feature_sets"),
    )
    return row.unpivot([], row.columns, "check", "n").select("check", (F.col("n") == 0).alias("passed"), F.when(F.col("check").startswith("no_"), ", ".join(leaks)).otherwise(F.concat("n", F.lit(" rows against it"))).alias("detail"))


def prediction_exclusions(rows: DataFrame, lagged: list[str], year: str = "year") -> DataFrame:
    """Per test year: rows, those left out for crossing a gap, and of retained ones the number, units, and rows with a lagged covariate missing."""
    kept = F.col("history_crosses_missing_gap") == 0
    missing = reduce(Column.__or__, [F.col(c).isNull() for c in lagged], F.lit(False))
    return rows.groupBy(F.col(year).alias("test_year")).agg(
        F.count("*").alias("potential_slope_unit_years"), F.count_if(F.col("history_crosses_missing_gap") == 1).alias("excluded_history_crosses_gap"), F.count_if(kept).alias("retained_prediction_rows"),
        F.count_distinct(F.when(kept, F.col("su_id"))).alias("retained_slope_units"), F.count_if(kept & missing).alias("missing_lagged_rainfall_rows"),
    )


def material_exclusions(rows: DataFrame, excluded: list[str]) -> DataFrame:
    """Rows, units and active rows before and after some materials are left out, and what goes: one pass for all three."""
    gone = F.coalesce(F.col("parent_material").isin(*excluded), F.lit(False)) if excluded else F.lit(False)
    stages = F.explode(F.when(gone, F.array(F.lit("before"), F.lit("removed"))).otherwise(F.array(F.lit("before"), F.lit("after")))).alias("stage")
    found = rows.select("su_id", "active", stages).groupBy("stage").agg(F.count("*").alias("rows"), F.count_distinct("su_id").alias("units"), F.sum("active").cast("long").alias("active"))
    names = rows.sparkSession.createDataFrame([("before",), ("after",), ("removed",)], "stage string")
    return names.join(found, "stage", "left").na.fill(0, ["rows", "units", "active"])


def compare_tables(left: DataFrame, right: DataFrame, keys: list[str], absolute: float = 1e-8, relative: float = 1e-6) -> DataFrame:
    """(check, status, detail): columns, rows, keys on one side only, and values of common columns apart by more than the tolerance."""
    spark = left.sparkSession
    common = [c for c in left.columns if c in right.columns and c not in keys]
    shape = [("columns", "equal" if set(left.columns) == set(right.columns) else "different", ",".join(sorted(set(left.columns) ^ set(right.columns))))]
    numeric = {f.name for f in left.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint", "smallint", "tinyint") or f.dataType.simpleString().startswith("decimal")}
    a, b = left.alias("a").withColumn("_in_a", F.lit(True)), right.alias("b").withColumn("_in_b", F.lit(True))
    joined = a.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"a_{c}") for c in common], "_in_a").join(b.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in common], "_in_b"), [f"k_{k}" for k in keys], "full")

    def apart(c):
        x, y = F.col(f"a_{c}"), F.col(f"b_{c}")
        if c in numeric:
            return ~((x.isNull() & y.isNull()) | F.coalesce(F.abs(x - y) <= absolute + relative * F.abs(y), F.lit(False)))
        return ~x.eqNullSafe(y)

    both = F.col("_in_a") & F.col("_in_b")
    row = joined.agg(F.count_if(F.col("_in_b").isNull()).alias("only_left"), F.count_if(F.col("_in_a").isNull()).alias("only_right"), *[F.count_if(both & apart(c)).alias(f"values:{c}") for c in common])
    long = row.unpivot([], row.columns, "check", "n").select("check", F.when(F.col("n") == 0, "equal").otherwise("different").alias("status"), F.col("n").cast("string").alias("detail"))
    return spark.createDataFrame(shape, "check string, status string, detail string").unionByName(long)


def publication_checks(measured: DataFrame, expected: DataFrame) -> DataFrame:
    """(section, check, passed, blocking, observed, requirement): expected (section, check, requirement) against measured (section, check, observed), both text.

    A check that wasn't measured fails; what was measured and isn't expected is listed as no requirement of its own.
    """
    joined = expected.join(measured, ["section", "check"], "full")
    passed = F.col("requirement").isNull() | F.coalesce(F.col("observed") == F.col("requirement"), F.lit(False))
    return joined.select("section", "check", passed.alias("passed"), F.col("requirement").isNotNull().alias("blocking"), F.coalesce("observed", F.lit("missing")).alias("observed"), "requirement")


def margins_kept(before: DataFrame, after: DataFrame) -> DataFrame:
    """(margin, differing) of two (su_id, year) tables of active cells: rows and columns whose sums changed."""
    out = None
    for margin in ("su_id", "year"):
        a, b = before.groupBy(margin).agg(F.count("*").alias("a")), after.groupBy(margin).agg(F.count("*").alias("b"))
        one = a.join(b, margin, "full").where(~F.col("a").eqNullSafe(F.col("b"))).agg(F.count("*").alias("differing")).withColumn("margin", F.lit(margin))
        out = one if out is None else out.unionByName(one)
    return out
