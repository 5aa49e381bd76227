"""The driver's tables as panels, covariates, points and predictions; and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.operators import covariates, history
from chronopanel.operators.spatial import clean_events, fixed_locations, with_keys

YEARS = [1995, 1996, 1998, 1999, 2000, 2001]
MISSING = [1997]
DAYS = [d for d in range(1, 32) if d not in (11, 12)]
MISSING_DAYS = [11, 12]
POINT_YEARS = [2000, 2001, 2002, 2004, 2005, 2006]
POINT_MISSING = [2003]
TEST_YEARS = [1999, 2000, 2001]
MODELS = ("P0", "P1", "P2")
TOLERANCE = 0.05


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _balanced(units: DataFrame, years: list[int], counted: DataFrame) -> DataFrame:
    every = units.withColumn("year", F.explode(F.array(*[F.lit(y) for y in years])))
    return every.join(counted, ["su_id", "year"], "left")


def annual_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts by year of shipping; events are returned lines of 45 pieces or more, shallow ones those that are finished."""
    lines = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R' and l_quantity >= 45")
    counted = lines.groupBy(F.col("l_partkey").cast("string").alias("su_id"), F.year("l_shipdate").alias("year")).agg(F.count("*").alias("landslide_count"), F.count_if(F.col("l_linestatus") == "F").alias("shallow_count"))
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("su_id"))
    return _balanced(units, YEARS, counted)


def daily_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by day of the month; events are errors of a value over 60, shallow ones over 80."""
    events = table(spark, sf_dir, "events")
    errors = events.where("event_type = 'error' and value > 60")
    counted = errors.groupBy(F.col("user_id").cast("string").alias("su_id"), F.dayofmonth("ts").alias("year")).agg(F.count("*").alias("landslide_count"), F.count_if(F.col("value") > 80).alias("shallow_count"))
    return _balanced(events.select(F.col("user_id").cast("string").alias("su_id")).distinct(), DAYS, counted)


def annual_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.build_history(history.derive_response(annual_panel(spark, sf_dir)), MISSING)


def daily_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.build_history(history.derive_response(daily_panel(spark, sf_dir)), MISSING_DAYS)


def rainfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Covariates of each part and year: pieces shipped, and the dearest line; some pairs are missing."""
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").cast("string").alias("su_id"), F.year("l_shipdate").alias("year")).agg(F.sum("l_quantity").alias("monsoon_rainfall_mm"), F.max("l_extendedprice").alias("rx1day_mm"))


def daily_rainfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A covariate of each user and day: the sum of all events' values; days without events are missing."""
    events = table(spark, sf_dir, "events")
    return events.groupBy(F.col("user_id").cast("string").alias("su_id"), F.dayofmonth("ts").alias("year")).agg(F.sum("value").alias("monsoon_rainfall_mm"))


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("su_id"), F.col("p_size").cast("double").alias("slope_median_deg"), F.col("p_retailprice").alias("su_area_m2"))


def materials(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("su_id"), F.col("p_brand").alias("parent_material"))


def grid_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_partkey").cast("string").alias("su_id"), F.col("l_suppkey").cast("string").alias("grid_id")).agg(F.sum("l_quantity").alias("weight"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as events: the first two components, by label, in years from the id."""
    e = table(spark, sf_dir, "embeddings")
    raw = e.select(F.col("label").cast("string").alias("su_id"), (F.lit(2000) + F.col("vec_id") % 7).cast("int").alias("year"), F.col("vec_id").alias("source_event_index"), F.col("embedding")[0].cast("double").alias("x_m"), F.col("embedding")[1].cast("double").alias("y_m"))
    return with_keys(clean_events(raw, POINT_YEARS), TOLERANCE)


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event a location, with slot, its number."""
    return fixed_locations(points(spark, sf_dir)).withColumn("slot", F.col("source_event_index").cast("long"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History rows with last year's covariates and static ones, in test years or before; no crossing rows."""
    past = covariates.lagged(rainfall(spark, sf_dir), ["monsoon_rainfall_mm", "rx1day_mm"])
    rows = annual_history(spark, sf_dir).join(past, ["su_id", "year"], "left")
    return rows.join(covariates.static_features(terrain(spark, sf_dir), materials(spark, sf_dir)), "su_id", "left")


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed-coefficient scores of three models for the test years, as predictions to evaluate."""
    rows = features(spark, sf_dir).where(F.col("year").isin(*TEST_YEARS) & (F.col("history_crosses_missing_gap") == 0))
    size, before, rain = F.col("slope_median_deg") / 50, F.col("prior_active_years"), F.coalesce("monsoon_rainfall_mm_lag1", F.lit(0.0)) / 400
    score = {"P0": -2.2 + 0.5 * size, "P1": -2.2 + 0.5 * size + 0.3 * before, "P2": -2.4 + 0.5 * size + 0.3 * before + 0.6 * rain}
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.round(1 / (1 + F.exp(-s)), 6).alias("p")) for m, s in score.items()])).alias("m")
    return rows.select("su_id", F.col("year").alias("test_year"), F.col("active").alias("observed"), each).select("su_id", "test_year", "m.model", "observed", F.col("m.p").alias("predicted_probability"))


def _panel_sql(name: str, counted: str, units: str, years: list[int], missing: list[int]) -> str:
    listed = ", ".join(f"({y})" for y in years)
    crosses = lambda last: "CASE WHEN " + " OR ".join(f"({last} < {m} AND {m} < year)" for m in missing) + " THEN 1 ELSE 0 END"
    category = lambda gap: f"CASE WHEN {gap} IS NULL OR {gap} < 1 THEN NULL WHEN {gap} = 1 THEN '1_year' WHEN {gap} = 2 THEN '2_years' WHEN {gap} <= 5 THEN '3_5_years' WHEN {gap} <= 10 THEN '6_10_years' ELSE 'gt10_years' END"
    return f"""
{name}_c AS ({counted}),
{name}_p AS (
  SELECT u.su_id, y.year, CAST(coalesce(n, 0) AS DOUBLE) AS landslide_count, CAST(coalesce(s, 0) AS DOUBLE) AS shallow_count,
         CASE WHEN coalesce(n, 0) > 0 THEN 1 ELSE 0 END AS active, CASE WHEN coalesce(s, 0) > 0 THEN 1 ELSE 0 END AS shallow_active
  FROM ({units}) u CROSS JOIN (VALUES {listed}) y(year) LEFT JOIN {name}_c c ON c.su_id = u.su_id AND c.year = y.year),
{name}_w AS (
  SELECT *, coalesce(sum(landslide_count) OVER w, 0.0) AS prior_landslide_count, CAST(coalesce(sum(active) OVER w, 0) AS INTEGER) AS prior_active_years,
         CAST(max(CASE WHEN active = 1 THEN year END) OVER w AS INTEGER) AS last_active_year,
         coalesce(sum(shallow_count) OVER w, 0.0) AS prior_shallow_landslide_count, CAST(coalesce(sum(shallow_active) OVER w, 0) AS INTEGER) AS prior_shallow_active_years,
         CAST(max(CASE WHEN shallow_active = 1 THEN year END) OVER w AS INTEGER) AS last_shallow_active_year, min(year) OVER (PARTITION BY su_id) AS first_year
  FROM {name}_p WINDOW w AS (PARTITION BY su_id ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
{name} AS (
  SELECT * EXCLUDE (first_year), CASE WHEN prior_active_years > 0 THEN 1 ELSE 0 END AS prior_failure, CASE WHEN prior_shallow_active_years > 0 THEN 1 ELSE 0 END AS prior_shallow_failure,
         year - last_active_year AS years_since_last_activity, year - last_shallow_active_year AS years_since_last_shallow_activity,
         {crosses("last_active_year")} AS history_crosses_missing_gap, {crosses("last_shallow_active_year")} AS shallow_history_crosses_missing_gap,
         {category("(year - last_active_year)")} AS gap_time_category, {category("(year - last_shallow_active_year)")} AS gap_shallow_category,
         CASE WHEN prior_active_years > 0 THEN 'previously_active' ELSE 'never_previously_active' END AS previously_active_state,
         CASE WHEN active = 1 AND year = first_year THEN 'active_history_unknown' WHEN active = 1 AND prior_active_years = 0 THEN 'first_observed_activation' WHEN active = 1 THEN 'recurrent_activity' ELSE 'inactive' END AS activity_class,
         CASE WHEN prior_active_years = 1 THEN '1_prior_active_year' WHEN prior_active_years = 2 THEN '2_prior_active_years' WHEN prior_active_years >= 3 THEN '3plus_prior_active_years' END AS recurrence_stage
  FROM {name}_w)"""


ANNUAL_SQL = _panel_sql(
    "annual",
    "SELECT CAST(l_partkey AS VARCHAR) AS su_id, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (l_linestatus = 'F') AS s FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45 GROUP BY ALL",
    "SELECT CAST(p_partkey AS VARCHAR) AS su_id FROM part", YEARS, MISSING,
)
DAILY_SQL = _panel_sql(
    "daily",
    "SELECT CAST(user_id AS VARCHAR) AS su_id, CAST(day(ts) AS INTEGER) AS year, count(*) AS n, count(*) FILTER (value > 80) AS s FROM events WHERE event_type = 'error' AND value > 60 GROUP BY ALL",
    "SELECT DISTINCT CAST(user_id AS VARCHAR) AS su_id FROM events", DAYS, MISSING_DAYS,
)
RAIN_SQL = "rain AS (SELECT CAST(l_partkey AS VARCHAR) AS su_id, CAST(year(l_shipdate) AS INTEGER) AS year, sum(l_quantity) AS monsoon_rainfall_mm, max(l_extendedprice) AS rx1day_mm FROM lineitem GROUP BY ALL)"
POINTS_SQL = f"""points AS (
  SELECT CAST(label AS VARCHAR) AS su_id, CAST(2000 + vec_id % 7 AS INTEGER) AS year, vec_id AS i, CAST(embedding[1] AS DOUBLE) AS x_m, CAST(embedding[2] AS DOUBLE) AS y_m,
         CAST(round_even(CAST(embedding[1] AS DOUBLE) / {TOLERANCE}, 0) AS BIGINT) AS x_key, CAST(round_even(CAST(embedding[2] AS DOUBLE) / {TOLERANCE}, 0) AS BIGINT) AS y_key
  FROM embeddings WHERE 2000 + vec_id % 7 IN ({", ".join(map(str, POINT_YEARS))})),
locations AS (
  SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY su_id, x_key, y_key ORDER BY year, CAST(i AS VARCHAR)) AS k FROM points) WHERE k = 1)"""
PREDICTIONS_SQL = f"""{ANNUAL_SQL}, {RAIN_SQL},
scored AS (
  SELECT a.su_id, a.year AS test_year, active AS observed, p_size / 50.0::DOUBLE AS size, prior_active_years AS k, coalesce(monsoon_rainfall_mm, 0.0::DOUBLE) / 400 AS wet
  FROM annual a JOIN part ON su_id = CAST(p_partkey AS VARCHAR) LEFT JOIN rain r ON r.su_id = a.su_id AND r.year + 1 = a.year
  WHERE a.year IN ({", ".join(map(str, TEST_YEARS))}) AND history_crosses_missing_gap = 0),
predictions AS (
  SELECT su_id, test_year, 'P0' AS model, observed, round(1 / (1 + exp(-(-2.2::DOUBLE + 0.5::DOUBLE * size))), 6) AS predicted_probability FROM scored UNION ALL
  SELECT su_id, test_year, 'P1', observed, round(1 / (1 + exp(-(-2.2::DOUBLE + 0.5::DOUBLE * size + 0.3::DOUBLE * k))), 6) FROM scored UNION ALL
  SELECT su_id, test_year, 'P2', observed, round(1 / (1 + exp(-(-2.4::DOUBLE + 0.5::DOUBLE * size + 0.3::DOUBLE * k + 0.6::DOUBLE * wet))), 6) FROM scored)"""
