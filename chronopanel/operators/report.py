"""Tables for reports: dictionaries, indexes, presentation tables, results, and the sources of figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions.scalar import gap_ordinal, labelled
from chronopanel.operators.effects import GAP_LABELS

# Units of the predictors.
UNITS = {
    "elev_min_m": "m", "elev_max_m": "m", "elev_std_m": "m", "elev_median_m": "m", "relief_m": "m", "slope_median_deg": "degrees", "slope_std_deg": "degrees", "slope_p90_deg": "degrees",
    "twi_median": "dimensionless index", "tri_median": "m", "distance_stream_median_m": "m", "plan_curvature_median": "m^-1", "profile_curvature_median": "m^-1",
    "northness_mean": "dimensionless (-1 to 1)", "eastness_mean": "dimensionless (-1 to 1)", "log_su_area": "log(m^2)",
    "prior_failure": "binary (0/1)", "prior_active_years_log1p": "log(1 + active years)", "prior_landslide_count_log1p": "log(1 + landslide count)",
}


def predictor_dictionary(spark: SparkSession, static: list[str], category: str, history: list[str], lagged: list[str], in_rainfall: list[str]) -> DataFrame:
    """(variable, role, source, transformation, units) of every predictor of the forward models."""
    rows = []
    for v in static:
        start = "natural logarithm of the area, then " if v == "log_su_area" else ""
        also = "; z-score over the model's sample in rainfall models" if v in in_rainfall else ""
        rows.append((v, "static numeric predictor", "slope_units" if v == "log_su_area" else "terrain", f"{start}z-score of the training fold in prediction{also}", UNITS.get(v)))
    rows.append((category, "static categorical predictor", "parent_material", "source codes in prediction; harmonised in rainfall models only", "categorical class"))
    rows += [(v, "pre-target history predictor", "history_panel", "from activity strictly before the target year", UNITS.get(v)) for v in history]
    rows += [(f"{v}_lag1", "pre-season lagged rainfall predictor", "rainfall", "source year = target year - 1; imputed and scaled by the training fold", "mm") for v in lagged]
    return spark.createDataFrame(rows, "variable string, role string, source string, transformation string, units string")


# Words for statistics in the names of terrain columns.
STATISTICS = {"min": "minimum", "max": "maximum", "std": "standard deviation", "median": "median", "mean": "mean", "p90": "90th percentile"}


def _defined(variable: str, source: str) -> tuple[str, str]:
    """What a predictor is, and how it comes to be one number of a unit, told by its name and source."""
    parts = variable.split("_")
    if source == "slope_units":
        return "natural logarithm of the unit's area", "area of the projected polygon"
    if source == "parent_material":
        return "dominant class of parent material in the unit", "class of the largest share of area"
    if source == "history_panel":
        known = {"prior_failure": "whether any earlier year was active", "prior_active_years_log1p": "log(1 + earlier active years)", "prior_landslide_count_log1p": "log(1 + earlier events)"}
        return known.get(variable, "time since the last active year" if variable.startswith("gap_") else "activity before the target year"), "earlier observed years of the unit"
    if source == "rainfall":
        what = f"largest rainfall of a year over {parts[0][2:-3]}-day windows" if parts[0].startswith("rx") else f"{parts[0]} rainfall"
        changed = ", of the calendar year before" if variable.endswith("_lag1") else ", less the unit's own mean" if variable.endswith("_within_z") else ""
        return what + changed, "mean of daily cells weighted by their area in the unit"
    found = [x for x in parts if x in STATISTICS]
    if not found:
        return variable.replace("_", " "), "difference of maximum and minimum" if variable.startswith("relief") else "given by unit"
    base = " ".join(x for x in parts if x not in STATISTICS and x not in ("m", "deg"))
    return f"{STATISTICS[found[0]]} of {base} in the unit", f"{STATISTICS[found[0]]} of the cells in the unit"


def coverage(tables: list[DataFrame], variables: list[str]) -> DataFrame:
    """(variable, n_rows, n_missing, minimum, maximum) of those variables that the tables have, each from the first that has it; one pass a table.

    NaN is missing; a variable that isn't numeric has neither minimum nor maximum.
    """
    parts, left = [], list(dict.fromkeys(variables))
    for table in tables:
        own = [v for v in left if v in table.columns]
        left = [v for v in left if v not in own]
        if not own:
            continue
        kinds = dict(table.dtypes)
        numeric = lambda v: kinds[v].startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))  # noqa: E731, B023
        value = {v: F.nanvl(F.col(f"`{v}`").cast("double"), F.lit(None).cast("double")) if numeric(v) else F.col(f"`{v}`") for v in own}
        none = F.lit(None).cast("double")
        told = [F.struct(F.lit(v).alias("variable"), F.count("*").alias("n_rows"), (F.count("*") - F.count(value[v])).alias("n_missing"),
                         (F.min(value[v]) if numeric(v) else none).alias("minimum"), (F.max(value[v]) if numeric(v) else none).alias("maximum")) for v in own]
        parts.append(table.agg(F.array(*told).alias("told")).select(F.inline("told")))
    if not parts:
        return tables[0].sparkSession.createDataFrame([], "variable string, n_rows long, n_missing long, minimum double, maximum double")
    return reduce(DataFrame.unionAll, parts)


def predictor_provenance(dictionary: DataFrame, tables: list[DataFrame], products: dict[str, dict[str, str]], model_terms: list[tuple[str, str, str, str, str]] = ()) -> DataFrame:
    """The dictionary of predictors, and rows of its columns for terms of models only, with where each comes from and what the tables hold of it.

    products gives, by source, ``product``, ``resolution`` and ``reference``; without them the source itself is the product. A
    predictor that no table has keeps its row, without counts.
    """
    spark = dictionary.sparkSession
    rows = [tuple(r) for r in dictionary.select("variable", "role", "source", "transformation", "units").collect()] + list(model_terms)
    out = []
    for variable, role, source, transformation, units in rows:
        product = products.get(source, {})
        out.append((variable, _defined(variable, source)[0], product.get("product", source), product.get("resolution"), units, _defined(variable, source)[1], transformation, role, product.get("reference")))
    # Names of the columns.
    schema = "variable string, scientific_definition string, source_product string, native_resolution_or_map_scale string, units string, slope_unit_aggregation string, transformation string, analysis_role string, source_reference string"
    return spark.createDataFrame(out, schema).join(coverage(tables, [r[0] for r in rows]), "variable", "left")


def supplement_index(wanted: DataFrame, made: DataFrame) -> DataFrame:
    """wanted (…, file) with status: included where made (file) has it, not_generated elsewhere."""
    there = made.select("file").distinct().withColumn("_there", F.lit(True))
    return wanted.join(there, "file", "left").select(*wanted.columns, F.when(F.col("_there"), "included").otherwise("not_generated").alias("status"))


def presentation(table: DataFrame, category: str, shares: list[str], decimals: int = 2) -> DataFrame:
    """A table to print: categories by name and in order, shares as percentages in text."""
    out = table.withColumn("_order", gap_ordinal(F.col(category))).withColumn(category, labelled(F.col(category), GAP_LABELS))
    out = out.withColumns({c: F.when(F.col(c).isNotNull(), F.format_string(f"%.{decimals}f", F.col(c) * 100)) for c in shares})
    return out.orderBy("_order").drop("_order")


def with_state(table: DataFrame, category: str) -> DataFrame:
    """table with history_state, the label of its category, in their order."""
    label = labelled(F.col(category), GAP_LABELS | {"overall": "Overall"})
    return table.withColumn("history_state", label).orderBy(F.coalesce(gap_ordinal(F.col(category)), F.lit(0)))


def support_table(support: DataFrame) -> DataFrame:
    """Rows, active ones, units and rate in percent of each state."""
    return with_state(support, "gap_time_category").select("history_state", "n", "active", "slope_units", (100 * F.col("rate")).alias("observed_rate_percent"))


def focal_table(focal: DataFrame) -> DataFrame:
    """Odds ratios and their intervals as text beside the numbers."""
    shown = F.format_string("%.2f", "odds_ratio"), F.format_string("%.2f–%.2f", "interval_low", "interval_high")
    return focal.select(F.col("display_term").alias("effect"), "log_odds_mean", "posterior_sd", "odds_ratio", "interval_low", "interval_high", shown[0].alias("odds_ratio_display"), shown[1].alias("approx_95_posterior_CI"))


def effects_table(effects: DataFrame) -> DataFrame:
    return effects.select("duration_days", "history_label", "AME_percentage_points", "CI95_low_percentage_points", "CI95_high_percentage_points", "p_AME", "n_rows_model", "n_SU_clusters", "n_grid_year_clusters")


def contrasts_table(contrasts: DataFrame, multiplicity: DataFrame) -> DataFrame:
    own = multiplicity.where("history_state <> 'all interactions'").select("duration_days", "history_state", "p_holm")
    return contrasts.join(own, ["duration_days", "history_state"], "left").select("duration_days", "history_label", "AME_contrast_percentage_points", "CI95_low_percentage_points", "CI95_high_percentage_points", "p_contrast", "p_holm")


def joint_table(joint: DataFrame, multiplicity: DataFrame) -> DataFrame:
    return joint.join(multiplicity.where("history_state = 'all interactions'").select("duration_days", "p_holm"), "duration_days", "left")


def performance_table(pooled: DataFrame, budget: DataFrame, fraction: float = 0.05) -> DataFrame:
    """Pooled metrics of each model with what the top fraction of each year captures."""
    top = budget.where(F.abs(F.col("top_fraction") - fraction) < 1e-9).select("model", "selected_rows", "captured_positives", F.col("positive_capture_rate").alias("top5_capture_rate"), F.col("precision_at_fraction").alias("top5_precision"))
    return pooled.join(top, "model", "left")


def heatmap(contrasts: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """Contrasts pivoted, with marks: * where Holm's p is below 0.05, † where the interval leaves out 0."""
    mark = F.concat(F.when(F.coalesce(F.col("p_holm") < 0.05, F.lit(False)), "*").otherwise(""), F.when((F.col("low") > 0) | (F.col("high") < 0), "†").otherwise(""))
    marked = contrasts.withColumn("_mark", mark)
    pick = lambda c, of: F.max(F.when(F.col(column) == c, F.col(of)))
    return marked.groupBy(row).agg(*[x for c in columns for x in (pick(c, value).alias(c), pick(c, "_mark").alias(f"{c}_mark"))])


def departures(summary: DataFrame) -> DataFrame:
    """Observed statistics less the null's median and quantiles, times 100."""
    less = lambda c: 100 * (F.col("observed") - F.col(c))
    return summary.select("statistic", less("null_median").alias("departure"), less("null_q975").alias("departure_low"), less("null_q025").alias("departure_high"), "p_upper")


def distance_reduction(summary: DataFrame) -> DataFrame:
    """How much shorter observed distances are than the null's, in percent, with the null's interval about its median."""
    share = lambda c: 100 * (1 - F.col(c) / F.col("null_median_m"))
    return with_state(summary, "gap_model").select("gap_model", "history_state", "percent_shorter_than_null", share("null_CI_high_m").alias("null_low_percent"), share("null_CI_low_m").alias("null_high_percent"), "empirical_p_one_sided")


def main_results(*parts: tuple[str, str, DataFrame]) -> DataFrame:
    """(analysis, metric, estimate, lower, upper, p_value, units) of several tables (metric, estimate and whatever of the rest they have)."""
    out = []
    for analysis, units, df in parts:
        column = lambda c, df=df: F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        out.append(df.select(F.lit(analysis).alias("analysis"), F.col("metric"), *[column(c).alias(c) for c in ("estimate", "lower", "upper", "p_value")], F.lit(units).alias("units")))
    return reduce(DataFrame.unionByName, out)
