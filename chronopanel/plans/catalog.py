"""Every query over the driver's tables by name, with SQL for the same rows.

Doubles that come of sums, means or logarithms are rounded to 6 places in both, since engines add in different orders.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions import scalar
from chronopanel.operators import audit, covariates, effects, evaluate, forward, history, models, randomization, report, spatial, trades
from chronopanel.plans import panels, stages
from chronopanel.plans.panels import ANNUAL_SQL, DAILY_SQL, MISSING, POINT_MISSING, POINTS_SQL, PREDICTIONS_SQL, RAIN_SQL, TEST_YEARS, YEARS
from chronopanel.sources import contract
from chronopanel.sources.tables import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
SEED, PERMUTATIONS = 20240517, stages.Config("", "").permutations
FRACTIONS = [0.01, 0.02, 0.05, 0.1]
MATERIAL_GROUPS = {"Brand#11": "Brand#1", "Brand#12": "Brand#1"}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    # adding 0 turns a negative zero into a plain one
    return df.withColumns({c: F.round(F.col(c).cast("double"), places) + F.lit(0.0) for c in names})


_HISTORY = "su_id, year, landslide_count, shallow_count, active, shallow_active, prior_landslide_count, prior_active_years, prior_failure, last_active_year, years_since_last_activity, history_crosses_missing_gap, gap_time_category, prior_shallow_landslide_count, prior_shallow_active_years, prior_shallow_failure, last_shallow_active_year, years_since_last_shallow_activity, shallow_history_crosses_missing_gap, gap_shallow_category, previously_active_state, activity_class, recurrence_stage, round(ln(1 + prior_active_years), 6) + 0.0::DOUBLE AS prior_active_years_log1p, round(ln(1 + prior_landslide_count), 6) + 0.0::DOUBLE AS prior_landslide_count_log1p, round(ln(1 + prior_shallow_active_years), 6) + 0.0::DOUBLE AS prior_shallow_active_years_log1p"
_LOGS = ("prior_active_years_log1p", "prior_landslide_count_log1p", "prior_shallow_active_years_log1p")
_RISK = "prior_failure = 1 AND history_crosses_missing_gap = 0 AND gap_time_category IS NOT NULL"


@query(f"WITH {ANNUAL_SQL} SELECT {_HISTORY} FROM annual")
def history_panel(spark, d):
    return rounded(panels.annual_history(spark, d), *_LOGS)


@query(f"WITH {DAILY_SQL} SELECT {_HISTORY} FROM daily")
def history_panel_daily(spark, d):
    return rounded(panels.daily_history(spark, d), *_LOGS)


_SUPPORT = "SELECT gap_time_category, count(*) AS n_slope_unit_years, CAST(sum(active) AS BIGINT) AS active_outcomes, count(DISTINCT su_id) AS n_slope_units, round(sum(active) / count(*), 6) + 0.0::DOUBLE AS observed_rate FROM {} WHERE " + _RISK + " GROUP BY ALL"


@query(f"WITH {ANNUAL_SQL} {_SUPPORT.format('annual')}")
def recurrence_gap_support(spark, d):
    return rounded(history.risk_support(panels.annual_history(spark, d)), "observed_rate")


@query(f"WITH {DAILY_SQL} {_SUPPORT.format('daily')}")
def recurrence_gap_support_daily(spark, d):
    return rounded(history.risk_support(panels.daily_history(spark, d)), "observed_rate")


@query(f"WITH {ANNUAL_SQL} SELECT year, count(DISTINCT su_id) AS slope_units, CAST(sum(active) AS BIGINT) AS active_slope_units, CAST(sum(landslide_count) AS BIGINT) AS landslides, CAST(sum(shallow_active) AS BIGINT) AS shallow_active_slope_units, CAST(sum(shallow_count) AS BIGINT) AS shallow_landslides FROM annual GROUP BY year")
def panel_year_audit(spark, d):
    return history.year_audit(panels.annual_history(spark, d))


_EXCLUSIONS = f"""WITH {ANNUAL_SQL}, x AS (
  SELECT 'recurrence' AS analysis, year, prior_failure AS f, history_crosses_missing_gap AS c FROM annual UNION ALL
  SELECT 'rainfall_history', year, prior_shallow_failure, shallow_history_crosses_missing_gap FROM annual),
audit AS (
  SELECT analysis, year, count(*) AS slope_unit_years, count(*) FILTER (f = 0) AS pre_first_excluded, count(*) FILTER (f = 1 AND c = 1) AS gap_crossing_excluded_from_risk,
         count(*) FILTER (f = 1 AND c = 0) AS retained_risk_rows FROM x GROUP BY ALL)"""


@query(f"{_EXCLUSIONS} SELECT * FROM audit")
def history_exclusion_audit(spark, d):
    return history.exclusion_audit(panels.annual_history(spark, d))


_TESTED = ", ".join(map(str, TEST_YEARS))


@query(f"""{_EXCLUSIONS} SELECT analysis, CAST(sum(slope_unit_years) AS BIGINT) AS potential_slope_unit_years, CAST(sum(pre_first_excluded) AS BIGINT) AS pre_first_excluded, CAST(sum(gap_crossing_excluded_from_risk) AS BIGINT) AS gap_crossing_excluded, CAST(sum(retained_risk_rows) AS BIGINT) AS retained_risk_rows FROM audit GROUP BY analysis UNION ALL
SELECT 'forward_prediction_test_set', count(*), NULL, count(*) FILTER (history_crosses_missing_gap = 1), count(*) FILTER (history_crosses_missing_gap = 0) FROM annual WHERE year IN ({_TESTED})""")
def exclusion_summary(spark, d):
    h = panels.annual_history(spark, d)
    tested = audit.prediction_exclusions(h.where(F.col("year").isin(*TEST_YEARS)), [])
    return history.exclusion_summary(history.exclusion_audit(h), tested)


@query(f"WITH {ANNUAL_SQL} SELECT activity_class, recurrence_stage, previously_active_state, count(*) AS n FROM annual GROUP BY ALL")
def activity_class_counts(spark, d):
    return panels.annual_history(spark, d).groupBy("activity_class", "recurrence_stage", "previously_active_state").agg(F.count("*").alias("n"))


@query(f"WITH {ANNUAL_SQL} SELECT su_id, CAST(sum(CASE WHEN active = 1 THEN CASE year {' '.join(f'WHEN {y} THEN {1 << i}' for i, y in enumerate(YEARS))} END END) AS BIGINT) AS mask FROM annual WHERE active = 1 GROUP BY su_id")
def activity_matrix(spark, d):
    return history.activity_matrix(panels.annual_history(spark, d), YEARS)


@query(f"WITH {ANNUAL_SQL} SELECT su_id, {', '.join(f'CAST(max(CASE WHEN year = {y} THEN active ELSE 0 END) AS INTEGER) AS y{y}' for y in YEARS)} FROM annual GROUP BY su_id")
def activity_wide(spark, d):
    return history.wide_activity(panels.annual_history(spark, d), YEARS)


@query(f"WITH {ANNUAL_SQL} SELECT count(DISTINCT su_id) AS units, count(*) AS rows, TRUE AS balanced, list_sort(list(DISTINCT year)) = {YEARS} AS years_as_expected FROM annual")
def period_check(spark, d):
    return contract.period_check(panels.annual_panel(spark, d), YEARS)


_LINES = "SELECT CAST(l_partkey AS VARCHAR) AS su_id, CAST(year(l_shipdate) AS INTEGER) AS year, l_quantity, l_linestatus FROM lineitem"
_RESPONSE = "SELECT '{}' AS source, su_id, year, {} AS landslide_count, {} AS shallow_count, CAST({} > 0 AS INTEGER) AS active, CAST({} > 0 AS INTEGER) AS shallow_active FROM every LEFT JOIN {} USING (su_id, year)"


def _response(source: str, total: str, shallow: str, table: str) -> str:
    return _RESPONSE.format(source, total, shallow, total, shallow, table)


@query(f"""WITH lines AS ({_LINES}), every AS (SELECT CAST(p_partkey AS VARCHAR) AS su_id, unnest({YEARS}) AS year FROM part),
flags AS (SELECT su_id, year, max(l_quantity) - 40 AS f, min(l_quantity) - 10 AS g FROM lines GROUP BY ALL),
counts AS (SELECT su_id, year, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (l_linestatus = 'F') AS DOUBLE) AS k FROM lines GROUP BY ALL)
{_response("flags", "CASE WHEN f > 0 THEN 1.0::DOUBLE ELSE 0.0 END", "CASE WHEN g > 0 THEN 1.0::DOUBLE ELSE 0.0 END", "flags")}
UNION ALL {_response("events", "coalesce(n, 0.0)", "coalesce(k, 0.0)", "counts")}
UNION ALL {_response("events, not the flag", "coalesce(n, 0.0)", "CASE WHEN g > 0 THEN 1.0::DOUBLE ELSE 0.0 END", "(SELECT * FROM counts JOIN flags USING (su_id, year))")}""")
def response_sources(spark, d):
    """Responses from flags (null and negative ones too), from typed events, and from both: events go before a total's flag, a shallow flag before events."""
    lines = panels.table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("su_id"), F.year("l_shipdate").alias("year"), "l_quantity", F.when(F.col("l_linestatus") == "F", " Shallow ").otherwise("deep").alias("landslide_type"))
    every = panels.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("su_id"), F.explode(F.array(*[F.lit(y) for y in YEARS])).alias("year"))
    flags = lines.groupBy("su_id", "year").agg((F.max("l_quantity") - 40).alias("active"), (F.min("l_quantity") - 10).alias("shallow_active"))
    flagged = every.join(flags, ["su_id", "year"], "left")
    made = {"flags": history.derive_response(flagged), "events": history.derive_response(every, lines), "events, not the flag": history.derive_response(flagged, lines)}
    return reduce(DataFrame.unionByName, [df.withColumn("source", F.lit(k)) for k, df in made.items()])


@query("SELECT CAST(l_orderkey AS VARCHAR) AS su_id, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def repeated_keys(spark, d):
    keyed = panels.table(spark, d, "lineitem").select(F.col("l_orderkey").cast("string").alias("su_id"), F.year("l_shipdate").alias("year"))
    return contract.repeated_keys(keyed, ["su_id", "year"])


@query("SELECT 'lineitem' AS file, 'has rows' AS \"check\", count(*) > 0 AS passed, CAST(count(*) AS VARCHAR) AS detail FROM lineitem UNION ALL SELECT 'lineitem', 'has key', TRUE, 'l_orderkey' UNION ALL SELECT 'lineitem', 'has weight', FALSE, 'none of weight, overlap_weight'")
def contract_checks(spark, d):
    return contract.contract_checks(panels.table(spark, d, "lineitem"), {"key": ("L_ORDERKEY",), "weight": ("weight", "overlap_weight")}, "lineitem")


@query(f"WITH {RAIN_SQL} SELECT su_id, round(avg(monsoon_rainfall_mm), 6) + 0.0::DOUBLE AS unit_mean, round(stddev_samp(monsoon_rainfall_mm), 6) + 0.0::DOUBLE AS unit_sd FROM rain GROUP BY su_id")
def climatology(spark, d):
    return rounded(covariates.climatology(panels.rainfall(spark, d), "monsoon_rainfall_mm"), "unit_mean", "unit_sd")


@query(f"""WITH {ANNUAL_SQL}, {RAIN_SQL}, f AS (SELECT a.su_id, a.year, monsoon_rainfall_mm FROM annual a LEFT JOIN rain r ON a.su_id = r.su_id AND a.year = r.year WHERE {_RISK}),
u AS (SELECT su_id, avg(monsoon_rainfall_mm) AS m, stddev_samp(monsoon_rainfall_mm) AS s FROM rain GROUP BY su_id),
z AS (SELECT avg(m) AS mm, stddev_samp(m) AS ss FROM u WHERE su_id IN (SELECT su_id FROM f))
SELECT f.su_id, f.year, f.monsoon_rainfall_mm, round(CASE WHEN s > 0 THEN (monsoon_rainfall_mm - m) / s END, 6) + 0.0::DOUBLE AS monsoon_rainfall_mm_within_z, round(CASE WHEN ss > 0 THEN (m - mm) / ss END, 6) + 0.0::DOUBLE AS monsoon_rainfall_mm_between_z
FROM f LEFT JOIN u ON f.su_id = u.su_id CROSS JOIN z""")
def within_between(spark, d):
    rain = panels.rainfall(spark, d)
    frame = history.risk_set(panels.annual_history(spark, d)).select("su_id", "year").join(rain.drop("rx1day_mm"), ["su_id", "year"], "left")
    return rounded(covariates.within_between(frame, rain, "monsoon_rainfall_mm"), "monsoon_rainfall_mm_within_z", "monsoon_rainfall_mm_between_z")


@query("SELECT su_id, grid_id, weight FROM (SELECT *, row_number() OVER (PARTITION BY su_id ORDER BY weight DESC, grid_id) AS k FROM (SELECT CAST(l_partkey AS VARCHAR) AS su_id, CAST(l_suppkey AS VARCHAR) AS grid_id, sum(l_quantity) AS weight FROM lineitem GROUP BY ALL)) WHERE k = 1")
def dominant_grid(spark, d):
    return covariates.dominant_cell(panels.grid_weights(spark, d))


@query(f"WITH {RAIN_SQL} SELECT su_id, CAST(year + 1 AS INTEGER) AS year, year AS rainfall_source_year, monsoon_rainfall_mm AS monsoon_rainfall_mm_lag1, rx1day_mm AS rx1day_mm_lag1 FROM rain")
def lagged_covariates(spark, d):
    return covariates.lagged(panels.rainfall(spark, d), ["monsoon_rainfall_mm", "rx1day_mm"])


@query(f"""WITH {ANNUAL_SQL}, {RAIN_SQL}, u AS (SELECT su_id, avg(monsoon_rainfall_mm) AS unit_mean FROM rain GROUP BY su_id),
f AS (SELECT a.su_id, a.year, ln(1 + prior_active_years) AS b, monsoon_rainfall_mm - unit_mean AS m FROM annual a LEFT JOIN rain r ON a.su_id = r.su_id AND a.year = r.year LEFT JOIN u ON u.su_id = a.su_id WHERE {_RISK}),
z AS (SELECT avg(b) AS bm, stddev_samp(b) AS bs, avg(m) AS mm, stddev_samp(m) AS ms FROM f)
SELECT su_id, year, round((b - bm) / bs, 6) + 0.0::DOUBLE AS prior_active_years_z, round((m - mm) / ms, 6) + 0.0::DOUBLE AS monsoon_z FROM f CROSS JOIN z WHERE m IS NOT NULL""")
def risk_zscores(spark, d):
    """The mixed model's frame: rainfall less the unit's mean and active years before, standardised over the risk set first; then complete cases only."""
    rain = panels.rainfall(spark, d).drop("rx1day_mm")
    frame = effects.recurrence_frame(panels.annual_history(spark, d).join(rain, ["su_id", "year"], "left"), rain)
    return rounded(covariates.complete_cases(frame, effects.RECURRENCE_COLUMNS).select("su_id", "year", "prior_active_years_z", "monsoon_z"), "prior_active_years_z", "monsoon_z")


@query(f"""WITH {ANNUAL_SQL}, {RAIN_SQL}, f AS (SELECT gap_time_category AS g, monsoon_rainfall_mm AS m, rx1day_mm AS x FROM annual a LEFT JOIN rain r ON a.su_id = r.su_id AND a.year = r.year)
SELECT 'panel' AS analysis, 'gap_time_category' AS variable, count(*) FILTER (g IS NULL) AS missing_rows FROM f UNION ALL
SELECT 'panel', 'monsoon_rainfall_mm', count(*) FILTER (m IS NULL) FROM f UNION ALL SELECT 'panel', 'rx1day_mm', count(*) FILTER (x IS NULL) FROM f UNION ALL
SELECT 'panel', 'ANY_REQUIRED', count(*) FILTER (g IS NULL OR m IS NULL OR x IS NULL) FROM f""")
def complete_case_report(spark, d):
    frame = panels.annual_history(spark, d).join(panels.rainfall(spark, d), ["su_id", "year"], "left")
    return covariates.missing_report(frame, ["gap_time_category", "monsoon_rainfall_mm", "rx1day_mm"], "panel")


@query("SELECT CAST(p_partkey AS VARCHAR) AS su_id, CAST(p_size AS DOUBLE) AS slope_median_deg, p_retailprice AS su_area_m2, p_brand AS parent_material, round(ln(p_retailprice), 6) + 0.0::DOUBLE AS log_su_area FROM part")
def static_features(spark, d):
    return rounded(covariates.static_features(panels.terrain(spark, d), panels.materials(spark, d)), "log_su_area")


_GROUP = "CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 'Brand#1' ELSE p_brand END"


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS su_id, {_GROUP} AS parent_material, {_GROUP} || '__' || CAST(p_size AS VARCHAR) AS cluster_key FROM part")
def harmonised_materials(spark, d):
    m = panels.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("su_id"), scalar.harmonised(F.col("p_brand"), MATERIAL_GROUPS).alias("parent_material"), "p_size")
    return m.select("su_id", "parent_material", scalar.composite_key(F.col("parent_material"), F.col("p_size")).alias("cluster_key"))


@query(f"""WITH {ANNUAL_SQL}, f AS (SELECT a.su_id, active, p_brand IN ('Brand#13', 'Brand#21') AS gone FROM annual a JOIN part ON su_id = CAST(p_partkey AS VARCHAR))
SELECT 'before' AS stage, count(*) AS rows, count(DISTINCT su_id) AS units, CAST(coalesce(sum(active), 0) AS BIGINT) AS active FROM f UNION ALL
SELECT 'after', count(*), count(DISTINCT su_id), CAST(coalesce(sum(active), 0) AS BIGINT) FROM f WHERE NOT gone UNION ALL
SELECT 'removed', count(*), count(DISTINCT su_id), CAST(coalesce(sum(active), 0) AS BIGINT) FROM f WHERE gone""")
def material_exclusions(spark, d):
    return audit.material_exclusions(panels.annual_history(spark, d).join(panels.materials(spark, d), "su_id", "left"), ["Brand#13", "Brand#21"])


@query("SELECT p_brand AS parent_material, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def cluster_codes(spark, d):
    return covariates.cluster_codes(panels.materials(spark, d), "parent_material")


_RATES = f"""rates AS (
  SELECT c.gap_time_category, count(h.su_id) AS n_risk, CAST(coalesce(sum(h.active), 0) AS BIGINT) AS active, CASE WHEN count(h.su_id) > 0 THEN sum(h.active) / count(h.su_id) END AS rate
  FROM (VALUES ('1_year'), ('2_years'), ('3_5_years'), ('6_10_years'), ('gt10_years')) c(gap_time_category)
  LEFT JOIN (SELECT * FROM daily WHERE {_RISK}) h ON h.gap_time_category = c.gap_time_category GROUP BY c.gap_time_category)"""


@query(f"WITH {DAILY_SQL}, {_RATES} SELECT gap_time_category, n_risk, active, round(rate, 6) + 0.0::DOUBLE AS rate FROM rates")
def temporal_observed_gap_rates(spark, d):
    return rounded(randomization.observed_gap_rates(history.risk_set(panels.daily_history(spark, d))), "rate")


_SOME = lambda names: "CASE WHEN sum(n_risk) FILTER (gap_time_category IN ({0})) > 0 THEN sum(active) FILTER (gap_time_category IN ({0})) / sum(n_risk) FILTER (gap_time_category IN ({0})) END".format(", ".join(f"'{n}'" for n in names))  # noqa: E731, UP032
_STATS = f"""stats AS (SELECT {", ".join(f"{_SOME([c])} AS rate_{c}" for c in randomization.CATEGORIES)}, {_SOME(randomization.CATEGORIES[:3])} AS short_1_5_rate, {_SOME(randomization.CATEGORIES[3:])} AS long_gt5_rate FROM rates)"""
STATISTICS = [*[f"rate_{c}" for c in randomization.CATEGORIES], "short_1_5_rate", "long_gt5_rate", "short_vs_long_risk_ratio", "one_vs_gt10_risk_ratio"]


@query(f"WITH {DAILY_SQL}, {_RATES}, {_STATS}, r AS (SELECT *, CASE WHEN long_gt5_rate > 0 THEN short_1_5_rate / long_gt5_rate END AS short_vs_long_risk_ratio, CASE WHEN rate_gt10_years > 0 THEN rate_1_year / rate_gt10_years END AS one_vs_gt10_risk_ratio FROM stats) SELECT {', '.join(f'round({s}, 6) + 0.0::DOUBLE AS {s}' for s in STATISTICS)} FROM r")
def temporal_observed_statistics(spark, d):
    rates = randomization.observed_gap_rates(history.risk_set(panels.daily_history(spark, d)))
    return rounded(randomization.statistics(rates), *STATISTICS)


@query(f"WITH {POINTS_SQL} SELECT su_id, x_key, y_key, count(*) AS records, count(DISTINCT year) AS distinct_years, min(year) AS earliest_year, max(year) AS latest_year FROM points GROUP BY ALL")
def location_multiplicity(spark, d):
    return spatial.multiplicity(panels.points(spark, d))


@query(f"WITH {POINTS_SQL} SELECT su_id, x_key, y_key, year, CAST(i AS VARCHAR) AS source_event_index, x_m, y_m FROM locations")
def dedup_locations(spark, d):
    return spatial.fixed_locations(panels.points(spark, d))


_CATEGORY = "CASE WHEN g = 1 THEN '1_year' WHEN g = 2 THEN '2_years' WHEN g <= 5 THEN '3_5_years' WHEN g <= 10 THEN '6_10_years' ELSE 'gt10_years' END"
_NEAREST = f"""pairs AS (SELECT a.su_id, a.i, b.i AS j, sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2) AS dist FROM locations a JOIN locations b ON a.su_id = b.su_id AND a.i <> b.i),
nearest AS (
  SELECT p.perm, p.su_id, p.i AS slot, p.year AS target_year, max(q.year) AS last_prior_year, min(dist) AS m
  FROM pairs JOIN labels p ON pairs.su_id = p.su_id AND pairs.i = p.i JOIN labels q ON q.su_id = p.su_id AND q.i = pairs.j AND q.perm = p.perm WHERE q.year < p.year GROUP BY ALL),
found AS (SELECT *, target_year - last_prior_year AS g, {_CATEGORY} AS gap_model FROM (SELECT *, target_year - last_prior_year AS g FROM nearest WHERE NOT (last_prior_year < {POINT_MISSING[0]} AND {POINT_MISSING[0]} < target_year)))""".replace("SELECT *, target_year - last_prior_year AS g, CASE", "SELECT *, CASE")
_OBSERVED = "labels AS (SELECT 0 AS perm, su_id, i, year FROM locations)"
_MEDIANS = """names AS (SELECT * FROM (VALUES ('overall'), ('1_year'), ('2_years'), ('3_5_years'), ('6_10_years'), ('gt10_years')) v(gap_model)),
each AS (SELECT perm, 'overall' AS gap_model, m FROM found UNION ALL SELECT perm, gap_model, m FROM found),
summed AS (SELECT p.perm, n.gap_model, count(m) AS n, median(m) AS median_distance_m FROM (SELECT DISTINCT perm FROM found) p CROSS JOIN names n LEFT JOIN each e ON e.gap_model = n.gap_model AND e.perm = p.perm GROUP BY ALL)"""


def _observed(spark, d) -> DataFrame:
    return spatial.nearest_prior(panels.locations(spark, d), POINT_MISSING)


@query(f"WITH {POINTS_SQL}, {_OBSERVED}, {_NEAREST} SELECT su_id, slot, target_year, last_prior_year, target_year - last_prior_year AS gap_years, gap_model, round(m, 6) + 0.0::DOUBLE AS nearest_prior_distance_m FROM found")
def nearest_prior(spark, d):
    return rounded(_observed(spark, d), "nearest_prior_distance_m")


@query(f"WITH {POINTS_SQL}, {_OBSERVED}, {_NEAREST}, {_MEDIANS} SELECT gap_model, n, round(median_distance_m, 6) + 0.0::DOUBLE AS median_distance_m FROM summed")
def distance_summary(spark, d):
    return rounded(spatial.distance_summary(_observed(spark, d)), "median_distance_m")


@query(f"WITH {POINTS_SQL} SELECT year, coalesce(a, 0) AS raw_valid_event_rows, coalesce(b, 0) AS fixed_location_rows, coalesce(a, 0) - coalesce(b, 0) AS rows_removed_by_deduplication FROM (SELECT year, count(*) AS a FROM points GROUP BY year) FULL JOIN (SELECT year, count(*) AS b FROM locations GROUP BY year) USING (year)")
def year_counts_before_after(spark, d):
    rows = panels.points(spark, d)
    return spatial.year_counts(rows, spatial.fixed_locations(rows))


_DEALT = f"""perms AS (SELECT CAST(range AS INTEGER) AS perm FROM range({PERMUTATIONS})),
rows_ AS (SELECT perm, su_id, i, year, row_number() OVER (PARTITION BY perm, su_id ORDER BY i) AS place, row_number() OVER (PARTITION BY perm, su_id ORDER BY md5('{SEED}|' || perm || '|' || su_id || '|' || i)) AS at FROM locations CROSS JOIN perms),
labels AS (SELECT a.perm, a.su_id, a.i, b.year FROM rows_ a JOIN rows_ b ON a.perm = b.perm AND a.su_id = b.su_id AND a.place = b.at)"""


def _draws(spark, d) -> DataFrame:
    """Distances of as many permutations as the surveyed operator takes."""
    return spatial.distance_summary(spatial.permuted_nearest(panels.locations(spark, d), PERMUTATIONS, SEED, POINT_MISSING), ["perm"])


@query(f"WITH {POINTS_SQL}, {_DEALT}, {_NEAREST}, {_MEDIANS} SELECT perm, gap_model, n, round(median_distance_m, 6) + 0.0::DOUBLE AS median_distance_m FROM summed")
def spatial_null_draws(spark, d):
    return rounded(_draws(spark, d), "median_distance_m")


@query(f"""WITH {POINTS_SQL}, {_DEALT}, {_NEAREST}, {_MEDIANS},
obs_pairs AS (SELECT a.su_id, a.i, a.year AS target_year, max(b.year) AS last_prior_year, min(sqrt((a.x_m - b.x_m) ** 2 + (a.y_m - b.y_m) ** 2)) AS m FROM locations a JOIN locations b ON a.su_id = b.su_id AND b.year < a.year GROUP BY ALL),
obs_found AS (SELECT m, {_CATEGORY} AS gap_model FROM (SELECT *, target_year - last_prior_year AS g FROM obs_pairs WHERE NOT (last_prior_year < {POINT_MISSING[0]} AND {POINT_MISSING[0]} < target_year))),
obs AS (SELECT n.gap_model, count(m) AS observed_n, median(m) AS observed_median_m FROM names n LEFT JOIN (SELECT 'overall' AS gap_model, m FROM obs_found UNION ALL SELECT gap_model, m FROM obs_found) e ON e.gap_model = n.gap_model GROUP BY n.gap_model),
nine AS (SELECT perm, gap_model, round(median_distance_m, 9) AS median_distance_m FROM summed),
obs9 AS (SELECT gap_model, observed_n, round(observed_median_m, 9) AS observed_median_m FROM obs),
s AS (SELECT gap_model, observed_n, observed_median_m, median(median_distance_m) AS nm, quantile_cont(median_distance_m, 0.025) AS lo, quantile_cont(median_distance_m, 0.975) AS hi, count(median_distance_m) AS k, count(*) FILTER (median_distance_m <= observed_median_m) AS below FROM nine JOIN obs9 USING (gap_model) GROUP BY ALL)
SELECT gap_model, observed_n, round(observed_median_m, 6) + 0.0::DOUBLE AS observed_median_m, round(nm, 6) + 0.0::DOUBLE AS null_median_m, round(lo, 6) + 0.0::DOUBLE AS null_CI_low_m, round(hi, 6) + 0.0::DOUBLE AS null_CI_high_m, k AS n_permutations, below AS n_null_at_or_below_observed,
       round(CASE WHEN nm > 0 THEN observed_median_m / nm END, 6) + 0.0::DOUBLE AS observed_null_ratio, round(100 * (1 - CASE WHEN nm > 0 THEN observed_median_m / nm END), 6) + 0.0::DOUBLE AS percent_shorter_than_null, round((below + 1) / (k + 1), 6) + 0.0::DOUBLE AS empirical_p_one_sided FROM s""")
def spatial_null_summary(spark, d):
    draws = _draws(spark, d)
    nine = lambda df: df.withColumn("median_distance_m", F.round("median_distance_m", 9))
    out = spatial.null_summary(nine(spatial.distance_summary(_observed(spark, d))), nine(draws))
    return rounded(out, "observed_median_m", "null_median_m", "null_CI_low_m", "null_CI_high_m", "observed_null_ratio", "percent_shorter_than_null", "empirical_p_one_sided")


@query(f"WITH {POINTS_SQL}, {_DEALT} SELECT su_id, year, count(*) // {PERMUTATIONS} AS per_draw, count(*) % {PERMUTATIONS} AS rest FROM labels GROUP BY ALL")
def permuted_label_counts(spark, d):
    """Every draw deals each unit its own years."""
    labels = spatial.permuted_years(panels.locations(spark, d), PERMUTATIONS, SEED)
    n = labels.groupBy("su_id", "year").agg(F.count("*").alias("n"))
    return n.select("su_id", "year", F.floor(F.col("n") / PERMUTATIONS).alias("per_draw"), (F.col("n") % PERMUTATIONS).alias("rest"))


@query(f"""WITH {POINTS_SQL}, perms AS (SELECT CAST(range AS INTEGER) AS perm FROM range(3)),
rows_ AS (SELECT perm, su_id, i, year, row_number() OVER (PARTITION BY perm ORDER BY su_id, i) AS place, row_number() OVER (PARTITION BY perm ORDER BY md5('{SEED}|' || perm || '|' || su_id || '|' || i)) AS at FROM locations CROSS JOIN perms)
SELECT a.perm, a.su_id, a.i AS slot, b.year FROM rows_ a JOIN rows_ b ON a.perm = b.perm AND a.place = b.at""")
def permuted_years_global(spark, d):
    """Years dealt anew over all locations, three times."""
    return spatial.permuted_years(panels.locations(spark, d), 3, SEED, "global").select("perm", "su_id", "slot", "year")


_VALUES = "values_ AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS statistic, CAST(o_orderkey % 4 AS INTEGER) AS chain, o_orderkey AS draw, o_totalprice AS value FROM orders)"


def _values(spark, d) -> DataFrame:
    o = panels.table(spark, d, "orders")
    name = F.when(F.col("o_orderkey") % 3 == 0, "a").when(F.col("o_orderkey") % 3 == 1, "b").otherwise("c")
    return o.select(name.alias("statistic"), (F.col("o_orderkey") % 4).cast("int").alias("chain"), F.col("o_orderkey").alias("draw"), F.col("o_totalprice").alias("value"))


@query(f"""WITH {_VALUES}, o AS (SELECT statistic, median(value) AS v FROM values_ WHERE chain = 0 GROUP BY statistic)
SELECT statistic, round(v, 6) + 0.0::DOUBLE AS observed, round(median(value), 6) + 0.0::DOUBLE AS null_median, round(quantile_cont(value, 0.025), 6) + 0.0::DOUBLE AS null_q025, round(quantile_cont(value, 0.975), 6) + 0.0::DOUBLE AS null_q975,
  round((count(*) FILTER (value <= v) + 1) / (count(*) + 1), 6) + 0.0::DOUBLE AS p_lower, round((count(*) FILTER (value >= v) + 1) / (count(*) + 1), 6) + 0.0::DOUBLE AS p_upper, count(*) AS n_permutations,
  round(least(1.0::DOUBLE, 2 * least((count(*) FILTER (value <= v) + 1) / (count(*) + 1), (count(*) FILTER (value >= v) + 1) / (count(*) + 1))), 6) + 0.0::DOUBLE AS p_two_sided
FROM values_ JOIN o USING (statistic) GROUP BY statistic, v""")
def empirical_summary(spark, d):
    values = _values(spark, d)
    observed = values.where("chain = 0").groupBy("statistic").agg(F.median("value").alias("value"))
    return rounded(randomization.empirical_summary(values.select("statistic", "value"), observed), "observed", "null_median", "null_q025", "null_q975", "p_lower", "p_upper", "p_two_sided")


@query(f"""WITH {_VALUES}, r AS (SELECT *, lag(value) OVER o AS before, row_number() OVER o AS i, count(*) OVER (PARTITION BY statistic, chain) AS n FROM values_ WINDOW o AS (PARTITION BY statistic, chain ORDER BY draw)),
c AS (SELECT statistic, chain, CASE WHEN count(*) >= 2 THEN corr(value, before) END AS r FROM r WHERE before IS NOT NULL GROUP BY ALL),
l AS (SELECT statistic, avg(r) AS m FROM c GROUP BY statistic),
h AS (SELECT statistic, chain, i > n // 2 AS half, avg(value) AS m, var_samp(value) AS v, count(*) AS k FROM r WHERE i <= n // 2 OR i > n - n // 2 GROUP BY ALL),
b AS (SELECT statistic, avg(v) AS w, var_samp(m) AS b, min(k) AS k FROM h GROUP BY statistic)
SELECT t.statistic, t.retained_draws, round(sqrt(((k - 1) / k * w + b) / w), 6) + 0.0::DOUBLE AS split_rhat, round(l.m, 6) + 0.0::DOUBLE AS mean_chain_lag1_autocorrelation, round(least(CAST(retained_draws AS DOUBLE), retained_draws * (1 - l.m) / (1 + l.m)), 6) + 0.0::DOUBLE AS approximate_ess_from_lag1
FROM (SELECT statistic, count(*) AS retained_draws FROM values_ GROUP BY statistic) t JOIN l ON l.statistic = t.statistic JOIN b ON b.statistic = t.statistic""")
def mixing_diagnostics(spark, d):
    return rounded(randomization.mixing(_values(spark, d)), "split_rhat", "mean_chain_lag1_autocorrelation", "approximate_ess_from_lag1")


@query(f"WITH {DAILY_SQL}, m AS (SELECT count(DISTINCT su_id) AS units, count(*) AS ones FROM daily WHERE active = 1) SELECT v.*, units, ones FROM m CROSS JOIN (VALUES (0, CAST(11 AS BIGINT), 34), (1, 12, 33), (2, 13, 33)) v(chain, seed, n_draws)")
def chain_schedule(spark, d):
    """How draws are dealt to the chains that start on the panel's matrix."""
    starts = randomization.chain_starts(history.activity_matrix(panels.daily_history(spark, d), panels.DAYS), randomization.schedule(spark, 100, [11, 12, 13]))
    ones = history.activity_matrix(panels.daily_history(spark, d), panels.DAYS).agg(F.sum(F.bit_count("mask")).cast("long").alias("ones"))
    return starts.select("chain", "seed", "n_draws", (F.octet_length("start") / 8).cast("long").alias("units")).join(F.broadcast(ones))


@query(f"SELECT CAST(p_partkey AS VARCHAR) AS su_id FROM part ORDER BY md5('{SEED}|' || p_partkey), su_id LIMIT 100")
def standardization_sample(spark, d):
    return randomization.seeded_sample(panels.terrain(spark, d).select("su_id"), 100, SEED, "su_id")


_CURVE = """each AS (SELECT {by}, predicted_probability AS p, count(*) AS n, sum(observed) AS h FROM predictions GROUP BY ALL),
curve AS (SELECT *, sum(n) OVER w AS selected, sum(h) OVER w AS captured, sum(h) OVER (PARTITION BY {by}) AS pos, sum(n) OVER (PARTITION BY {by}) AS total FROM each WINDOW w AS (PARTITION BY {by} ORDER BY p DESC)),
metrics AS (
  SELECT * FROM (SELECT {by}, max(total) AS n, max(pos) AS positives, sum(h / pos * (captured / selected)) AS ap, sum(h * (total - selected - (pos - captured) + (n - h) / 2)) / max(pos) / (max(total) - max(pos)) AS auc FROM curve GROUP BY ALL)
  JOIN (SELECT {by}, avg((predicted_probability - observed) ** 2) AS brier, avg(-(observed * ln(predicted_probability) + (1 - observed) * ln(1 - predicted_probability))) AS loss FROM predictions GROUP BY ALL) USING ({by}))"""
_METRICS = "SELECT {by}, CAST(n AS BIGINT) AS n, CAST(positives AS BIGINT) AS positives, round(positives / n, 6) + 0.0::DOUBLE AS prevalence, round(ap, 6) + 0.0::DOUBLE AS average_precision, round(auc, 6) + 0.0::DOUBLE AS roc_auc, round(brier, 6) + 0.0::DOUBLE AS brier_score, round(loss, 6) + 0.0::DOUBLE AS log_loss FROM metrics"
_MEASURES = ("prevalence", "average_precision", "roc_auc", "brier_score", "log_loss")


@query(f"WITH {PREDICTIONS_SQL}, {_CURVE.format(by='model, test_year')} {_METRICS.format(by='model, test_year')}")
def metrics_by_year(spark, d):
    return rounded(evaluate.metrics(_predictions(spark, d), ["model", "test_year"]), *_MEASURES)


@query(f"WITH {PREDICTIONS_SQL}, {_CURVE.format(by='model')} {_METRICS.format(by='model')}")
def pooled_metrics(spark, d):
    return rounded(evaluate.metrics(_predictions(spark, d), ["model"]), *_MEASURES)


@query(f"WITH {PREDICTIONS_SQL}, {_CURVE.format(by='model')} SELECT model, p AS score, CAST(selected AS BIGINT) AS selected, CAST(captured AS BIGINT) AS captured, round(captured / selected, 6) + 0.0::DOUBLE AS precision, round(captured / pos, 6) + 0.0::DOUBLE AS recall FROM curve")
def pr_curve(spark, d):
    return rounded(evaluate.curve(panels.predictions(spark, d), ["model"]).select("model", "score", "selected", "captured", "precision", "recall"), "precision", "recall")


_TOP = """ranked AS (SELECT *, row_number() OVER (PARTITION BY model, test_year ORDER BY predicted_probability DESC, su_id) AS place, count(*) OVER (PARTITION BY model, test_year) AS total, sum(observed) OVER (PARTITION BY model, test_year) AS pos FROM predictions),
top AS (SELECT model, test_year, f AS top_fraction, count(*) AS selected_rows, CAST(sum(observed) AS BIGINT) AS captured_positives, CAST(max(pos) AS BIGINT) AS total_positives FROM ranked CROSS JOIN ({fractions}) WHERE place <= greatest(1, ceil(total * f)) GROUP BY ALL),
budget AS (SELECT model, top_fraction, CAST(sum(selected_rows) AS BIGINT) AS selected_rows, CAST(sum(captured_positives) AS BIGINT) AS captured_positives, CAST(sum(total_positives) AS BIGINT) AS total_positives FROM top GROUP BY ALL)"""
_FRACTIONS = "SELECT unnest([" + ", ".join(f"{f}::DOUBLE" for f in FRACTIONS) + "]) AS f"
_SHARES = "round(CASE WHEN total_positives > 0 THEN captured_positives / total_positives END, 6) + 0.0::DOUBLE AS positive_capture_rate, round(captured_positives / selected_rows, 6) + 0.0::DOUBLE AS precision_at_fraction"


def _predictions(spark, d) -> DataFrame:
    """The predictions, stored as the stage stores them, since evaluation reads them more than once."""
    return written(panels.predictions(spark, d), "predictions", keep=True)


@query(f"WITH {PREDICTIONS_SQL}, {_TOP.format(fractions=_FRACTIONS)} SELECT *, {_SHARES} FROM top")
def top_fraction(spark, d):
    return rounded(evaluate.top_fractions(_predictions(spark, d), ["model", "test_year"], FRACTIONS), "positive_capture_rate", "precision_at_fraction")


@query(f"WITH {PREDICTIONS_SQL}, {_TOP.format(fractions=_FRACTIONS)} SELECT *, {_SHARES}, 'top fraction selected independently within each held-out year, then counts pooled' AS budget_definition FROM budget")
def annual_budget(spark, d):
    return rounded(evaluate.annual_budget(_predictions(spark, d), FRACTIONS), "positive_capture_rate", "precision_at_fraction")


@query(f"WITH {PREDICTIONS_SQL}, {_TOP.format(fractions='SELECT i / 1000.0::DOUBLE AS f FROM range(1, 201) r(i)')} SELECT *, {_SHARES}, 'top fraction selected independently within each held-out year, then counts pooled' AS budget_definition FROM budget")
def capture_curve(spark, d):
    return rounded(evaluate.annual_budget(_predictions(spark, d), [i / 1000 for i in range(1, 201)]), "positive_capture_rate", "precision_at_fraction")


_BINS = """edges AS (SELECT model, test_year, list_distinct(quantile_cont(predicted_probability, [""" + ", ".join(f"{i / 10}::DOUBLE" for i in range(11)) + """])) AS e FROM predictions GROUP BY ALL),
binned AS (SELECT model, test_year, CAST(greatest(0, len(list_filter(e, lambda x: x < predicted_probability)) - 1) AS INTEGER) AS calibration_bin, count(*) AS n, sum(CAST(round(predicted_probability, 12) AS DECIMAL(14, 12))) AS s, sum(observed) AS h FROM predictions JOIN edges USING (model, test_year) GROUP BY ALL)"""


# sums are decimals, alike in any order, and divided once: nothing is rounded
@query(f"WITH {PREDICTIONS_SQL}, {_BINS} SELECT model, test_year, calibration_bin, n, CAST(s AS DOUBLE) / n AS mean_predicted, CAST(h AS DOUBLE) / n AS observed_rate FROM binned")
def calibration_bins(spark, d):
    return evaluate.calibration(_predictions(spark, d))


@query(f"WITH {PREDICTIONS_SQL}, {_BINS} SELECT model, calibration_bin, CAST(sum(n) AS BIGINT) AS n, CAST(sum(s) AS DOUBLE) / sum(n) AS mean_predicted, CAST(sum(h) AS DOUBLE) / sum(n) AS observed_rate FROM binned GROUP BY ALL")
def pooled_calibration(spark, d):
    return evaluate.pooled_calibration(_predictions(spark, d))


_PAIRS = [("P1", "P0"), ("P2", "P1"), ("P2", "P0")]
_LONG = " UNION ALL ".join(f"SELECT model, '{name}' AS metric, {c} AS v FROM metrics" for name, c in (("average_precision", "ap"), ("roc_auc", "auc"), ("brier_score", "brier"), ("log_loss", "loss")))


@query(f"WITH {PREDICTIONS_SQL}, {_CURVE.format(by='model')}, long AS ({_LONG}) SELECT a.model AS richer_model, b.model AS simpler_model, metric, round(a.v - b.v, 6) + 0.0::DOUBLE AS difference_richer_minus_simpler FROM long a JOIN long b USING (metric) WHERE (a.model, b.model) IN (('P1', 'P0'), ('P2', 'P1'), ('P2', 'P0'))")
def metric_increments(spark, d):
    return rounded(evaluate.increments(evaluate.metrics(_predictions(spark, d), ["model"]), _PAIRS, list(_MEASURES[1:])), "difference_richer_minus_simpler")


@query(f"""WITH {ANNUAL_SQL}, {RAIN_SQL}, f AS (SELECT a.*, r.su_id IS NULL AS bare FROM annual a LEFT JOIN rain r ON r.su_id = a.su_id AND r.year + 1 = a.year WHERE a.year IN ({_TESTED}))
SELECT year AS test_year, count(*) AS potential_slope_unit_years, count(*) FILTER (history_crosses_missing_gap = 1) AS excluded_history_crosses_gap, count(*) FILTER (history_crosses_missing_gap = 0) AS retained_prediction_rows,
       count(DISTINCT CASE WHEN history_crosses_missing_gap = 0 THEN su_id END) AS retained_slope_units, count(*) FILTER (history_crosses_missing_gap = 0 AND bare) AS missing_lagged_rainfall_rows FROM f GROUP BY year""")
def prediction_exclusions(spark, d):
    return audit.prediction_exclusions(panels.features(spark, d).where(F.col("year").isin(*TEST_YEARS)), ["monsoon_rainfall_mm_lag1", "rx1day_mm_lag1"])


_TRAINED = f"""f AS (SELECT a.year, a.su_id, r.year AS source FROM annual a LEFT JOIN rain r ON r.su_id = a.su_id AND r.year + 1 = a.year WHERE history_crosses_missing_gap = 0),
t AS (SELECT year AS test, source, (SELECT max(year) FROM annual b WHERE b.year < f.year AND b.history_crosses_missing_gap = 0) AS sound, (SELECT max(year) FROM annual b WHERE b.year <= f.year AND b.history_crosses_missing_gap = 0) AS leaky FROM f WHERE year IN ({_TESTED}))"""
_LEAKS = " UNION ALL ".join(
    f"""SELECT '{case}' AS "case", "check", n = 0 AS passed, CASE WHEN "check" LIKE 'no_%' THEN '{leak}' ELSE n || ' rows against it' END AS detail FROM (
  SELECT 'all_max_training_year_before_test_year' AS "check", count(*) FILTER (NOT {case} < test) AS n FROM t UNION ALL
  SELECT 'first_test_year_uses_previous_year_as_latest_training_year', count(*) FILTER (test = {min(TEST_YEARS)} AND {case} <> test - 1) FROM t UNION ALL
  SELECT 'all_nonmissing_rainfall_sources_are_t_minus_1', count(*) FILTER (source {shift} <> test - 1) FROM t UNION ALL SELECT 'no_current_year_rainfall_in_feature_sets', {len(leak.split())})"""
    for case, shift, leak in (("sound", "", ""), ("leaky", "+ 1", "rx1day_mm"))
)


@query(f"WITH {ANNUAL_SQL}, {RAIN_SQL}, {_TRAINED} {_LEAKS}")
def leakage_checks(spark, d):
    """The checks on sound rows, and on rows that leak: trained on the test year, with rainfall of the year itself."""
    f = panels.features(spark, d).where("history_crosses_missing_gap = 0").select("year", "rainfall_source_year")
    years = f.select("year").distinct()
    last = lambda inside: years.alias("a").join(years.alias("b"), F.col("b.year") <= F.col("a.year") if inside else F.col("b.year") < F.col("a.year")).groupBy(F.col("a.year").alias("year")).agg(F.max("b.year").alias("max_training_year"))
    tested = f.where(F.col("year").isin(*TEST_YEARS))
    out = []
    for case, inside, feature in (("sound", False, "monsoon_rainfall_mm_lag1"), ("leaky", True, "rx1day_mm")):
        rows = tested.join(F.broadcast(last(inside)), "year").select(F.col("year").alias("test_year"), "max_training_year", F.when(F.col("rainfall_source_year").isNotNull(), F.col("year") if inside else F.col("rainfall_source_year")).alias("rainfall_source_year"))
        out.append(audit.leakage_checks(rows, ["slope_median_deg", feature], ["monsoon_rainfall_mm", "rx1day_mm"]).withColumn("case", F.lit(case)))
    return out[0].unionByName(out[1])


_P = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS family, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE (p_partkey * 37 % 1000) / 20000.0::DOUBLE END AS p FROM part)"


@query(f"WITH {_P} SELECT id, family, p, round(least(1.0::DOUBLE, max(s) OVER (PARTITION BY family ORDER BY p, id ROWS UNBOUNDED PRECEDING)), 6) + 0.0::DOUBLE AS p_holm FROM (SELECT *, (count(*) OVER (PARTITION BY family) - row_number() OVER (PARTITION BY family ORDER BY p, id) + 1) * p AS s FROM p WHERE p IS NOT NULL) UNION ALL SELECT id, family, p, NULL FROM p WHERE p IS NULL")
def holm_adjusted(spark, d):
    part = panels.table(spark, d, "part")
    p = part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("family"), F.when(F.col("p_partkey") % 7 != 0, (F.col("p_partkey") * 37 % 1000) / 20000.0).alias("p"))
    return rounded(scalar.holm(p, "p", ["family"], ["id"]), "p_holm")


@query("""SELECT 'columns' AS "check", 'different' AS status, 'log_su_area' AS detail UNION ALL SELECT 'only_left', CASE WHEN count(*) FILTER (p_size = 1) = 0 THEN 'equal' ELSE 'different' END, CAST(count(*) FILTER (p_size = 1) AS VARCHAR) FROM part UNION ALL
SELECT 'only_right', 'equal', '0' UNION ALL SELECT 'values:slope_median_deg', 'equal', '0' UNION ALL SELECT 'values:su_area_m2', CASE WHEN count(*) FILTER (p_size = 2) = 0 THEN 'equal' ELSE 'different' END, CAST(count(*) FILTER (p_size = 2) AS VARCHAR) FROM part UNION ALL SELECT 'values:parent_material', 'equal', '0'""")
def table_comparison(spark, d):
    left = covariates.static_features(panels.terrain(spark, d), panels.materials(spark, d))
    right = left.where("slope_median_deg <> 1").withColumn("su_area_m2", F.when(F.col("slope_median_deg") == 2, F.col("su_area_m2") + 1).otherwise(F.col("su_area_m2"))).drop("log_su_area")
    return audit.compare_tables(left, right, ["su_id"])


@query(f"""WITH {ANNUAL_SQL}, m AS (SELECT 'rows' AS c, CAST(count(*) AS VARCHAR) AS v FROM annual UNION ALL SELECT 'years', CAST(count(DISTINCT year) AS VARCHAR) FROM annual UNION ALL SELECT 'units', CAST(count(DISTINCT su_id) AS VARCHAR) FROM annual)
SELECT 'panel' AS section, coalesce(e.c, m.c) AS "check", e.x IS NULL OR coalesce(m.v = e.x, FALSE) AS passed, e.x IS NOT NULL AS blocking, coalesce(m.v, 'missing') AS observed, e.x AS requirement
FROM (VALUES ('rows', '1'), ('years', '6'), ('absent', '0')) e(c, x) FULL JOIN m ON m.c = e.c""")
def publication_checks(spark, d):
    text = lambda c, name: c.cast("string").alias(name)
    h = panels.annual_history(spark, d).agg(text(F.count("*"), "rows"), text(F.count_distinct("year"), "years"), text(F.count_distinct("su_id"), "units"))
    expected = spark.createDataFrame([("panel", "rows", "1"), ("panel", "years", "6"), ("panel", "absent", "0")], "section string, check string, requirement string")
    return audit.publication_checks(h.unpivot([], ["rows", "years", "units"], "check", "observed").withColumn("section", F.lit("panel")), expected)


@query(f"""WITH {ANNUAL_SQL}, {_SUPPORT.format('annual').replace('SELECT', 's AS (SELECT', 1)})
SELECT 'recurrence' AS analysis, 'rate ' || CASE gap_time_category WHEN '1_year' THEN '1 year' WHEN '2_years' THEN '2 years' ELSE '3–5 years' END AS metric, observed_rate AS estimate, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper, CAST(NULL AS DOUBLE) AS p_value, 'share of unit-years' AS units FROM s UNION ALL
SELECT 'panel', 'active unit-years', CAST(sum(active) AS DOUBLE), 0, CAST(count(*) AS DOUBLE), NULL, 'unit-years' FROM annual""")
def main_results(spark, d):
    h = panels.annual_history(spark, d)
    rates = rounded(history.risk_support(h), "observed_rate")
    rates = rates.select(F.concat(F.lit("rate "), scalar.labelled(F.col("gap_time_category"), effects.GAP_LABELS)).alias("metric"), F.col("observed_rate").alias("estimate"))
    whole = h.agg(F.sum("active").alias("estimate"), F.lit(0).alias("lower"), F.count("*").alias("upper")).withColumn("metric", F.lit("active unit-years"))
    return report.main_results(("recurrence", "share of unit-years", rates), ("panel", "unit-years", whole))


@query(f"""WITH {_VALUES}, o AS (SELECT statistic, median(value) AS v FROM values_ WHERE chain = 0 GROUP BY statistic), n AS (SELECT statistic, median(value) AS m FROM values_ GROUP BY statistic)
SELECT statistic, round(100 * (v - m), 4) + 0.0::DOUBLE AS departure, printf('%.1f', round(v, 1)) AS shown FROM o JOIN n USING (statistic)""")
def figure_departures(spark, d):
    """Observed less null median, in hundredths, and its label."""
    values = _values(spark, d)
    observed = values.where("chain = 0").groupBy("statistic").agg(F.median("value").alias("value"))
    s = randomization.empirical_summary(values.select("statistic", "value"), observed)
    return s.select("statistic", (F.round(100 * (F.col("observed") - F.col("null_median")), 4) + F.lit(0.0)).alias("departure"), F.format_string("%.1f", F.round("observed", 1)).alias("shown"))


@query("""SELECT 'slope_median_deg' AS variable, 'static numeric predictor' AS role, 'terrain' AS source, 'z-score of the training fold in prediction; z-score over the model''s sample in rainfall models' AS transformation, 'degrees' AS units UNION ALL
SELECT 'parent_material', 'static categorical predictor', 'parent_material', 'source codes in prediction; harmonised in rainfall models only', 'categorical class' UNION ALL
SELECT 'prior_failure', 'pre-target history predictor', 'history_panel', 'from activity strictly before the target year', 'binary (0/1)' UNION ALL
SELECT 'rx10day_mm_lag1', 'pre-season lagged rainfall predictor', 'rainfall', 'source year = target year - 1; imputed and scaled by the training fold', 'mm'""")
def predictor_dictionary(spark, d):
    return report.predictor_dictionary(spark, ["slope_median_deg"], "parent_material", ["prior_failure"], ["rx10day_mm"], ["slope_median_deg"])


@query(f"""WITH {ANNUAL_SQL}, {RAIN_SQL}
SELECT 'slope_median_deg' AS variable, 'median of slope in the unit' AS scientific_definition, 'elevation model' AS source_product, '30 m' AS native_resolution_or_map_scale, 'degrees' AS units, 'median of the cells in the unit' AS slope_unit_aggregation,
       'z-score of the training fold in prediction; z-score over the model''s sample in rainfall models' AS transformation, 'static numeric predictor' AS analysis_role, 'survey' AS source_reference,
       count(*) AS n_rows, count(*) - count(p_size) AS n_missing, CAST(min(p_size) AS DOUBLE) AS minimum, CAST(max(p_size) AS DOUBLE) AS maximum FROM part UNION ALL
SELECT 'parent_material', 'dominant class of parent material in the unit', 'parent_material', NULL, 'categorical class', 'class of the largest share of area', 'source codes in prediction; harmonised in rainfall models only', 'static categorical predictor', NULL, count(*), count(*) - count(p_brand), NULL, NULL FROM part UNION ALL
SELECT 'prior_failure', 'whether any earlier year was active', 'history_panel', NULL, 'binary (0/1)', 'earlier observed years of the unit', 'from activity strictly before the target year', 'pre-target history predictor', NULL, count(*), 0, min(CAST(prior_failure AS DOUBLE)), max(CAST(prior_failure AS DOUBLE)) FROM annual UNION ALL
SELECT 'rx1day_mm_lag1', 'largest rainfall of a year over 1-day windows, of the calendar year before', 'rainfall', NULL, 'mm', 'mean of daily cells weighted by their area in the unit', 'source year = target year - 1; imputed and scaled by the training fold', 'pre-season lagged rainfall predictor', NULL, count(*), count(*) - count(rx1day_mm), min(rx1day_mm), max(rx1day_mm) FROM rain UNION ALL
SELECT 'rx3day_mm', 'largest rainfall of a year over 3-day windows', 'rainfall', NULL, 'mm', 'mean of daily cells weighted by their area in the unit', 'within and between units', 'rainfall exposure', NULL, NULL, NULL, NULL, NULL""")
def predictor_provenance(spark, d):
    """Where predictors come from and how many rows of the panels hold them; of one, none does."""
    words = report.predictor_dictionary(spark, ["slope_median_deg"], "parent_material", ["prior_failure"], ["rx1day_mm"], ["slope_median_deg"])
    tables = [panels.terrain(spark, d), panels.materials(spark, d), panels.annual_history(spark, d), covariates.lagged(panels.rainfall(spark, d), ["rx1day_mm"])]
    terms = [("rx3day_mm", "rainfall exposure", "rainfall", "within and between units", "mm")]
    return report.predictor_provenance(words, tables, {"terrain": {"product": "elevation model", "resolution": "30 m", "reference": "survey"}}, terms)


@query("SELECT * EXCLUDE (place) FROM (SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place, (SELECT count(*) FROM orders) AS n FROM orders) WHERE place IN (SELECT i * ((SELECT count(*) FROM orders) - 1) // 99 FROM range(100) r(i))")
def thinned_rows(spark, d):
    """A hundred orders at even distances."""
    o = panels.table(spark, d, "orders")
    n = o.count()
    return randomization.thinned(o.select("o_orderkey"), "o_orderkey", 100).withColumn("n", F.lit(n).cast("long"))


@query("SELECT n_name AS item, CAST(n_nationkey AS VARCHAR) AS file, CASE WHEN EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey) THEN 'included' ELSE 'not_generated' END AS status FROM nation")
def supplement_index(spark, d):
    """An index of wanted items joined to what's there: nations, and those of suppliers."""
    wanted = panels.table(spark, d, "nation").select(F.col("n_name").alias("item"), F.col("n_nationkey").cast("string").alias("file"))
    return report.supplement_index(wanted, panels.table(spark, d, "supplier").select(F.col("s_nationkey").cast("string").alias("file")))


@query(f"WITH {DAILY_SQL}, {_RATES} SELECT CASE gap_time_category WHEN '1_year' THEN '1 year' WHEN '2_years' THEN '2 years' WHEN '3_5_years' THEN '3–5 years' WHEN '6_10_years' THEN '6–10 years' ELSE '>10 years' END AS gap_time_category, n_risk, active, CASE WHEN rate IS NOT NULL THEN printf('%.1f', round(rate, 4) * 100) END AS rate FROM rates")
def presentation_table(spark, d):
    rates = randomization.observed_gap_rates(history.risk_set(panels.daily_history(spark, d))).withColumn("rate", F.round("rate", 4))
    return report.presentation(rates, "gap_time_category", ["rate"], 1)


_EFFECTS = "e AS (SELECT p_brand AS row_, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS col, max(p_retailprice) - 1500 AS v, max(p_retailprice) - 1600 AS low, max(p_retailprice) - 1400 AS high, min(p_size) / 50.0::DOUBLE AS p FROM part GROUP BY ALL)"


@query(f"WITH {_EFFECTS}, m AS (SELECT *, CASE WHEN p < 0.05 THEN '*' ELSE '' END || CASE WHEN low > 0 OR high < 0 THEN '†' ELSE '' END AS mark FROM e) SELECT row_ AS parent_material, " + ", ".join(f"round(max(CASE WHEN col = '{c}' THEN v END), 6) + 0.0::DOUBLE AS {c}, max(CASE WHEN col = '{c}' THEN mark END) AS {c}_mark" for c in "abc") + " FROM m GROUP BY row_")
def figure_heatmap(spark, d):
    """Effects by two dimensions, pivoted with their marks."""
    part = panels.table(spark, d, "part")
    col = F.when(F.col("p_size") % 3 == 0, "a").when(F.col("p_size") % 3 == 1, "b").otherwise("c")
    most = F.max("p_retailprice")
    e = part.groupBy(F.col("p_brand").alias("parent_material"), col.alias("col")).agg((most - 1500).alias("v"), (most - 1600).alias("low"), (most - 1400).alias("high"), (F.min("p_size") / 50.0).alias("p_holm"))
    return rounded(report.heatmap(e, "parent_material", "col", "v", ["a", "b", "c"]), "a", "b", "c")


@query(f"""WITH {ANNUAL_SQL}, a AS (SELECT su_id, year FROM annual WHERE active = 1), b AS (SELECT su_id, CASE WHEN year = 1995 THEN 1996 ELSE year END AS year FROM a),
x AS (SELECT year, count(*) AS n FROM a GROUP BY year), y AS (SELECT year, count(*) AS n FROM b GROUP BY year)
SELECT 'su_id' AS margin, CAST(0 AS BIGINT) AS differing UNION ALL SELECT 'year', count(*) FROM x FULL JOIN y ON x.year = y.year WHERE x.n IS DISTINCT FROM y.n""")
def margin_differences(spark, d):
    """Sums of rows and columns of the activity matrix against those of one whose first year is moved to the second."""
    before = panels.annual_history(spark, d).where("active = 1").select("su_id", "year")
    after = before.withColumn("year", F.when(F.col("year") == 1995, 1996).otherwise(F.col("year")))
    return audit.margins_kept(before, after)


@query()
def calibration_lines(spark, d):
    """Intercept and slope of the outcome on each model's log odds."""
    return models.calibration_lines(panels.predictions(spark, d), ["model"])


# models: what they fit has no SQL, but their design and marginal effects at given coefficients have
_STATIC = ["slope_median_deg", "log_su_area"]
_DESIGN = f"""f AS (
  SELECT a.su_id, a.year, shallow_active AS y, gap_shallow_category AS g, rx1day_mm AS x, {_GROUP} AS material, ln(1 + prior_shallow_active_years) AS b, CAST(p_size AS DOUBLE) AS s, ln(p_retailprice) AS l
  FROM annual a LEFT JOIN rain r ON a.su_id = r.su_id AND a.year = r.year JOIN part ON a.su_id = CAST(p_partkey AS VARCHAR)
  WHERE prior_shallow_failure = 1 AND shallow_history_crosses_missing_gap = 0 AND gap_shallow_category IS NOT NULL),
u AS (SELECT su_id, avg(rx1day_mm) AS um, stddev_samp(rx1day_mm) AS us FROM rain GROUP BY su_id),
w AS (SELECT avg(um) AS wm, stddev_samp(um) AS ws FROM u WHERE su_id IN (SELECT su_id FROM f)),
z AS (SELECT avg(b) AS bm, stddev_samp(b) AS bs, avg(s) AS sm, stddev_samp(s) AS ss, avg(l) AS lm, stddev_samp(l) AS ls FROM f),
design AS (
  SELECT f.su_id, f.year, y, g, material, (x - um) / us AS rx, (um - wm) / ws AS btw, (b - bm) / bs AS bz, (s - sm) / ss AS sz, (l - lm) / ls AS lz
  FROM f JOIN u ON f.su_id = u.su_id CROSS JOIN w CROSS JOIN z WHERE x IS NOT NULL AND us IS NOT NULL)"""


def _rain_frame(spark, d) -> tuple[DataFrame, DataFrame]:
    """The base of the rainfall models, and rainfall. The risk set is written with what is joined to it, so that its scores and users read it and not all lines."""
    rain = panels.rainfall(spark, d)
    static = covariates.static_features(panels.terrain(spark, d), panels.materials(spark, d))
    cells = covariates.dominant_cell(panels.grid_weights(spark, d)).select("su_id", "grid_id")
    risk = history.risk_set(panels.annual_history(spark, d), "shallow_")
    frame = written(risk.join(rain, ["su_id", "year"], "left").join(static, "su_id", "left").join(cells, "su_id", "left"), "rainfall-risk")
    return effects.rainfall_base(frame, _STATIC, MATERIAL_GROUPS, [])[0], rain


@query(f"WITH {ANNUAL_SQL}, {RAIN_SQL}, {_DESIGN} SELECT su_id, year, y AS shallow_active, g AS gap_shallow_category, material AS parent_material, " + ", ".join(f"round({a}, 6) + 0.0::DOUBLE AS {b}" for a, b in (("rx", "rx_z"), ("btw", "rx_between_z"), ("bz", "prior_shallow_active_years_z"), ("sz", "slope_median_deg_z"), ("lz", "log_su_area_z"), ("CASE WHEN g = '1_year' THEN rx ELSE 0 END", "rx_z_1_year"))) + " FROM design")
def rainfall_design(spark, d):
    """The complete cases of a rainfall model with its scores, and an interaction."""
    base, rain = _rain_frame(spark, d)
    own = effects.rainfall_design(base, rain, "rx1day_mm", _STATIC, "3_5_years")[0]
    scores = ["rx_z", "rx_between_z", "prior_shallow_active_years_z", *[f"{c}_z" for c in _STATIC]]
    out = own.select("su_id", "year", "shallow_active", "gap_shallow_category", "parent_material", *scores, models.term("rx_z:gap=1_year").alias("rx_z_1_year"))
    return rounded(out, *scores, "rx_z_1_year")


_BETA = {"Intercept": -1.5, "gap=1_year": 0.3, "gap=2_years": 0.2, "rx_z": 0.1, "rx_z:gap=1_year": 0.05, "rx_z:gap=2_years": -0.05, "rx_between_z": 0.07, "prior_shallow_active_years_z": 0.2, "slope_median_deg_z": -0.1, "log_su_area_z": 0.15}


def _beta(term: str) -> float:
    """The given coefficient of a term; those of materials and years follow from their names."""
    kind, _, level = term.partition("=")
    if kind == "material":
        return 0.01 * (int(level.partition("#")[2]) % 7)
    return 0.02 * (int(level) - 1998) if kind == "year" else _BETA[term]


def _effects_sql() -> str:
    rest = "-1.5::DOUBLE + 0.07::DOUBLE * btw + 0.2::DOUBLE * bz - 0.1::DOUBLE * sz + 0.15::DOUBLE * lz + CASE WHEN material = (SELECT min(material) FROM design) THEN 0 ELSE 0.01::DOUBLE * (CAST(split_part(material, '#', 2) AS INTEGER) % 7) END + CASE WHEN year = (SELECT min(year) FROM design) THEN 0 ELSE 0.02::DOUBLE * (year - 1998) END"
    p = lambda x, a, b: f"1 / (1 + exp(-(r + 0.3::DOUBLE * {a} + 0.2::DOUBLE * {b} + 0.1::DOUBLE * {x} + 0.05::DOUBLE * {x} * {a} - 0.05::DOUBLE * {x} * {b})))"
    rows = " UNION ALL ".join(f"SELECT '{name}' AS state, round(avg({p('(rx + 1)', a, b)} - {p('rx', a, b)}), 6) + 0.0::DOUBLE AS effect FROM m" for name, a, b in (("1_year", 1, 0), ("2_years", 0, 1), ("3_5_years", 0, 0)))
    return f"WITH {ANNUAL_SQL}, {RAIN_SQL}, {_DESIGN}, m AS (SELECT *, {rest} AS r FROM design) {rows}"


@query(_effects_sql())
def rainfall_ame_fixed_beta(spark, d):
    """Marginal effects of the whole formula at given coefficients."""
    base, rain = _rain_frame(spark, d)
    own, _, terms, gaps = effects.rainfall_design(base, rain, "rx1day_mm", _STATIC, "3_5_years")
    fit = models.Fit(terms, np.array([_beta(t) for t in terms]), np.eye(len(terms)), 0, 0)
    found = models.marginal_effects(own, fit, {c: {f"gap={g}": float(g == c) for g in gaps} for c in [*gaps, "3_5_years"]}, "rx_z")
    return spark.createDataFrame([(k, round(e, 6) + 0.0) for k, (e, _) in found.items()], "state string, effect double")


def _rain_effects(spark, d) -> dict[str, DataFrame]:
    base, rain = _rain_frame(spark, d)
    return effects.rainfall_effects(written(base, "rainfall-base"), rain, {1: "rx1day_mm"}, _STATIC, "3_5_years", seed=SEED)[0]


@query()
def rainfall_glm(spark, d):
    """Coefficients of the whole formula with two-way clustered errors."""
    return _rain_effects(spark, d)["coefficients"]


@query()
def rainfall_ame(spark, d):
    """Contrasts of marginal effects with delta-method errors, with Holm's p-values, and the joint test."""
    made = _rain_effects(spark, d)
    return made["multiplicity"].join(made["contrasts"].select("history_state", "duration_days", "AME_contrast_probability", "SE_contrast_two_way", "CI95_low_probability", "CI95_high_probability"), ["history_state", "duration_days"], "left")


@query()
def forward_prediction(spark, d):
    """Penalised fits on all years before each test year, for three sets of features; all held-out rows."""
    rows = written(panels.features(spark, d).where("history_crosses_missing_gap = 0"), "prediction-frame")
    sets = {"P0_static": [*_STATIC]}
    sets["P1_history"] = [*sets["P0_static"], *stages.HISTORY]
    sets["P2_history_lagged_rain"] = [*sets["P1_history"], "monsoon_rainfall_mm_lag1", "rx1day_mm_lag1"]
    return forward.forward_predictions(rows, TEST_YEARS, sets, "parent_material")["predictions"]


@query()
def recurrence_vb(spark, d):
    """Odds ratios of elapsed time, burden, rainfall and day from the mixed model, with approximate intervals."""
    rain = panels.daily_rainfall(spark, d)
    frame = effects.recurrence_frame(panels.daily_history(spark, d).join(rain, ["su_id", "year"], "left"), rain)
    complete = written(covariates.complete_cases(frame, effects.RECURRENCE_COLUMNS), "recurrence-frame")
    return effects.recurrence_model(complete)[0]["coefficients"]


def _chain_draws(spark, d) -> DataFrame:
    matrix = history.activity_matrix(panels.annual_history(spark, d), YEARS)
    full = stages.Config("", "")
    return randomization.swap_chains(matrix, randomization.schedule(spark, full.draws, full.seeds), YEARS, MISSING, full.burn_in, full.thin)


@query()
def swap_chain_draws(spark, d):
    """Gap rates of retained draws of three chains with fixed margins."""
    return _chain_draws(spark, d)


@query()
def chain_diagnostics(spark, d):
    return randomization.chain_diagnostics(_chain_draws(spark, d))


@query()
def swap_chain_statistics(spark, d):
    """The statistics of each draw."""
    return randomization.statistics(_chain_draws(spark, d), ["chain", "draw"])


#: Rounds before the first draw, between draws, rows of a block and draws of each chain; SQL spells every round out.
_TRADES = {"burn_in": 2, "thin": 2, "block_rows": 32, "draws": 2}


def _trades_sql() -> str:
    """Every round as a table of its own, then each draw's matrix as rows of (unit, column) with the column before."""
    width, (burn_in, thin, block_rows, draws) = len(panels.DAYS), _TRADES.values()
    key = "md5(seed || '|{k}|' || su_id)"
    turn = """r{n} AS (
  SELECT su_id, chain, seed, size, met + CAST(o IS NOT NULL AS INT) AS met, moved + CAST(o IS NOT NULL AND now <> mask AS INT) AS moved, CASE WHEN o IS NULL THEN mask ELSE now END AS mask FROM (
    SELECT *, (mask & o) | CASE WHEN f THEN taken ELSE xor(xor(mask, o), taken) END AS now FROM (
      SELECT *, CAST(coalesce(list_sum(list_transform(list_sort(list_transform(list_filter(range({width}), lambda c: (xor(mask, o) >> c) & 1 = 1), lambda c: struct_pack(h := md5(seed || '|{k}|' || CASE WHEN f THEN su_id ELSE oid END || '|' || (CAST(1 AS BIGINT) << c)), b := CAST(1 AS BIGINT) << c)))
          [1:CAST(bit_count(CASE WHEN f THEN mask ELSE o END) - bit_count(mask & o) AS BIGINT)], lambda x: x.b)), 0) AS BIGINT) AS taken FROM (
        SELECT *, CASE WHEN f THEN lead(mask) OVER w ELSE lag(mask) OVER w END AS o, CASE WHEN f THEN lead(su_id) OVER w ELSE lag(su_id) OVER w END AS oid FROM (
          SELECT *, row_number() OVER w % 2 = 1 AS f FROM (SELECT r{k}.*, {key} AS key, left({key}, d) AS block FROM r{k} CROSS JOIN depth) WINDOW w AS (PARTITION BY chain, block ORDER BY key, su_id)
        ) WINDOW w AS (PARTITION BY chain, block ORDER BY key, su_id)))))"""
    rounds = [turn.format(n=k + 1, k=k, width=width, key=key.format(k=k)) for k in range(burn_in + thin * draws)]
    place = "CASE " + " ".join(f"WHEN i = {i} THEN {y}" for i, y in enumerate(panels.DAYS)) + " END"
    drawn = " UNION ALL ".join(f"SELECT {t} AS draw, * FROM r{burn_in + thin * (t + 1)}" for t in range(draws))
    gap = "CASE WHEN last IS NULL OR last < 11 AND year > 11 OR last < 12 AND year > 12 THEN NULL WHEN year - last <= 1 THEN '1_year' WHEN year - last <= 2 THEN '2_years' WHEN year - last <= 5 THEN '3_5_years' WHEN year - last <= 10 THEN '6_10_years' ELSE 'gt10_years' END"
    bit = " + ".join(f"CASE WHEN year = {y} THEN {1 << i} ELSE 0 END" for i, y in enumerate(panels.DAYS))
    return f"""WITH {DAILY_SQL},
r0 AS (SELECT su_id, mask, bit_count(mask) AS size, chain, seed, 0 AS met, 0 AS moved FROM (SELECT su_id, CAST(sum({bit}) AS BIGINT) AS mask FROM daily WHERE active = 1 GROUP BY su_id) CROSS JOIN (VALUES (0, 11), (1, 12)) v(chain, seed)),
depth AS (SELECT min(d) AS d FROM range(8) t(d) CROSS JOIN (SELECT count(*) AS n FROM r0 WHERE chain = 0) WHERE n <= {block_rows} * 16 ** d),
{", ".join(rounds)},
drawn AS ({drawn}),
cells AS (SELECT *, (mask >> i) & 1 AS hit, {place} AS year FROM drawn CROSS JOIN range({width}) t(i)),
gaps AS (SELECT *, max(CASE WHEN hit = 1 THEN year END) OVER (PARTITION BY chain, draw, su_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM cells),
named AS (SELECT *, {gap} AS gap_time_category FROM gaps),
kept AS (SELECT chain, draw, bool_and(ones = was) AS margins_kept FROM (SELECT chain, draw, i, sum(hit) AS ones FROM cells GROUP BY ALL) JOIN (SELECT i, sum((mask >> i) & 1) AS was FROM r0 CROSS JOIN range({width}) t(i) WHERE chain = 0 GROUP BY i) USING (i) GROUP BY ALL),
tried AS (SELECT chain, draw, CAST(sum(met) // 2 AS BIGINT) AS attempted, CAST(sum(moved) // 2 AS BIGINT) AS accepted, bool_and(bit_count(mask) = size) AS sizes FROM drawn GROUP BY ALL)
SELECT chain, draw, v.gap_time_category, CAST(count(n.su_id) AS BIGINT) AS n_risk, CAST(coalesce(sum(hit), 0) AS BIGINT) AS active, attempted, accepted, margins_kept AND sizes AS margins_kept
FROM tried JOIN kept USING (chain, draw) CROSS JOIN (VALUES ('1_year'), ('2_years'), ('3_5_years'), ('6_10_years'), ('gt10_years')) v(gap_time_category) LEFT JOIN named n USING (chain, draw, gap_time_category) GROUP BY ALL"""


@query(_trades_sql())
def trade_chain_draws(spark, d):
    """Gap rates of draws of two chains of trades on the daily panel's whole matrix; rounds are few since SQL spells them out."""
    matrix = history.activity_matrix(panels.daily_history(spark, d), panels.DAYS)
    plan = randomization.schedule(spark, 2 * _TRADES["draws"], [11, 12])
    return trades.traded_chains(matrix, plan, panels.DAYS, panels.MISSING_DAYS, _TRADES["burn_in"], _TRADES["thin"], _TRADES["block_rows"])
