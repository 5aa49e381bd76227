"""The two regressions on elapsed time: recurrence by a mixed model, and extreme rainfall by elapsed time as marginal effects."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.scalar import GAP_CATEGORIES, Z95, composite_key, harmonised, holm, zscored
from chronopanel.operators import covariates, history, mixed, models, randomization
from chronopanel.sources.tables import temporary, written

ORDER = [c for c, _ in GAP_CATEGORIES]
# How categories and effects read in tables.
GAP_LABELS = {"1_year": "1 year", "2_years": "2 years", "3_5_years": "3–5 years", "6_10_years": "6–10 years", "gt10_years": ">10 years"}
BURDEN_LABEL = "Prior active-year burden (1 SD in log[1 + prior active years])"
MONSOON_LABEL = "Within-slope-unit monsoon rainfall (1 SD)"


def _gap_levels(frame: DataFrame, gap: str, reference: str) -> list[str]:
    """Categories with rows, in order, but for the reference, which must have some."""
    (found,) = models.levels_of(frame, gap)
    if reference not in found:
        raise ValueError(f"no rows of the reference category {reference}")
    return sorted(set(found) - {reference}, key=ORDER.index)


# recurrence


def recurrence_frame(panel: DataFrame, rain: DataFrame) -> DataFrame:
    """The recurrence risk set with prior_active_years_z and monsoon_z, standardised over it before any row is left out.

    panel is a history panel with monsoon_rainfall_mm beside it; rain has all years of it, for the units' means.
    """
    data = covariates.centred(panel, rain, "monsoon_rainfall_mm", "monsoon_within")
    risk = history.risk_set(data)
    return zscored(risk, {"prior_active_years_log1p": "prior_active_years_z", "monsoon_within": "monsoon_z"})


RECURRENCE_COLUMNS = ["active", "gap_time_category", "prior_active_years_z", "monsoon_z", "year", "su_id"]


def recurrence_model(complete: DataFrame, reference: str = "gt10_years", year_effects: bool = True, **settings) -> tuple[dict[str, DataFrame], dict]:
    """Tables coefficients, focal and support, and the fit's record: active by elapsed time, burden, rainfall and year with an intercept for each unit."""
    spark = complete.sparkSession
    gaps = _gap_levels(complete, "gap_time_category", reference)
    years = models.levels_of(complete, "year")[0][1:] if year_effects else []
    marks = models.marks("gap_time_category", gaps, "gap:T.") | models.marks("year", years, "year:T.")
    frame = complete.withColumns({"Intercept": F.lit(1.0), **marks})
    fit = mixed.variational_mixed_logit(frame, ["Intercept", *marks, "prior_active_years_z", "monsoon_z"], **settings)
    shown = {f"gap:T.{c}": f"{GAP_LABELS[c]} vs {GAP_LABELS[reference]}" for c in gaps} | {"prior_active_years_z": BURDEN_LABEL, "monsoon_z": MONSOON_LABEL}
    kind = "approximate 95% posterior credible interval"
    rows = [(t, *[float(fit[k][i]) for k in ("log_odds_mean", "posterior_sd", "odds_ratio", "interval_low", "interval_high")], kind) for i, t in enumerate(fit["terms"])]
    schema = "term string, log_odds_mean double, posterior_sd double, odds_ratio double, interval_low double, interval_high double, interval_type string"
    focal = [(*r, shown[r[0]]) for r in rows if r[0] in shown]
    support = complete.groupBy("gap_time_category").agg(F.count("*").alias("n"), F.sum("active").cast("long").alias("active"), F.count_distinct("su_id").alias("slope_units")).withColumn("rate", F.col("active") / F.col("n"))
    record = {k: fit[k] for k in ("terms", "random_sd", "bound", "iterations", "evaluations", "success", "message", "units", "rows")}
    record |= {"random_log_sd": float(np.log(fit["random_sd"])), "random_variance": fit["random_sd"] ** 2, "reference": reference, "year_effects": year_effects}
    return {"coefficients": spark.createDataFrame(rows, schema), "focal": spark.createDataFrame(focal, f"{schema}, display_term string"), "support": support}, record


# rainfall


def rainfall_base(frame: DataFrame, static: list[str], groups: dict[str, str], excluded: list[str]) -> tuple[DataFrame, DataFrame]:
    """The shallow risk set with harmonised materials, burden and static z-scores over it; and counts before and after materials are left out.

    frame is a history panel with rainfall, static attributes, parent_material and grid_id beside it.
    """
    if missing := [c for c in static if c not in frame.columns]:
        raise ValueError(f"missing static predictors: {', '.join(missing)}")
    risk = history.risk_set(frame, "shallow_").withColumn("parent_material", harmonised(F.col("parent_material").cast("string"), groups))
    gone = F.coalesce(F.col("parent_material").isin(*excluded), F.lit(False)) if excluded else F.lit(False)
    counts = lambda df, stage: df.agg(F.count("*").alias("rows"), F.count_distinct("su_id").alias("slope_units"), F.coalesce(F.sum("shallow_active"), F.lit(0)).cast("long").alias("events")).withColumn("stage", F.lit(stage))
    audit = reduce(DataFrame.unionByName, [counts(risk, "before_parent_material_exclusion"), counts(risk.where(~gone), "after_parent_material_exclusion")])
    base = zscored(risk.where(~gone), {"prior_shallow_active_years_log1p": "prior_shallow_active_years_z", **{c: f"{c}_z" for c in static}})
    cell = composite_key(F.coalesce(F.col("grid_id").cast("string"), F.lit("nan")), F.col("year"))
    return base.withColumn("grid_year", cell), audit


def rainfall_design(base: DataFrame, rain: DataFrame, measure: str, static: list[str], reference: str) -> tuple[DataFrame, DataFrame, list[str], list[str]]:
    """Complete cases with a column for each term, the report of what's missing, the terms, and the gap categories but for the reference.

    The formula is rx_z by gap, and rx_between_z, the burden, static z-scores, material and year; the first level of each is its reference.
    Complete cases are written to the shared folder: each level that is looked for, and each user of them, would join and shuffle everything again.
    """
    data = covariates.within_between(base, rain, measure).withColumnsRenamed({f"{measure}_within_z": "rx_z", f"{measure}_between_z": "rx_between_z"})
    numbers = ["rx_between_z", "prior_shallow_active_years_z", *[f"{c}_z" for c in static]]
    required = ["shallow_active", "rx_z", *numbers, "gap_shallow_category", "parent_material", "year", "su_id", "grid_year"]
    missing = covariates.missing_report(data, required, f"rainfall_history_{measure}")
    own = written(covariates.complete_cases(data.select(*required), required), "rainfall-complete")
    gaps = _gap_levels(own, "gap_shallow_category", reference)
    materials, years = models.levels_of(own, "parent_material", "year")
    gap_marks = models.marks("gap_shallow_category", gaps, "gap=")
    others = models.marks("parent_material", materials[1:], "material=") | models.marks("year", years[1:], "year=")
    own = own.withColumns({"Intercept": F.lit(1.0), **gap_marks, **others}).withColumns({f"rx_z:{g}": F.col("rx_z") * models.term(g) for g in gap_marks})
    return own, missing, ["Intercept", *gap_marks, *others, "rx_z", *[f"rx_z:{g}" for g in gap_marks], *numbers], gaps


def rainfall_effects(base: DataFrame, rain: DataFrame, measures: dict[int, str], static: list[str], reference: str = "gt10_years", sample: int | None = 5000, seed: int = 0, correction: bool = True) -> tuple[dict[str, DataFrame], list[dict]]:
    """Tables effects, contrasts, joint_tests, multiplicity, coefficients, missingness and support over all measures (by duration), and a record of each fit.

    Each measure has its own binomial fit of shallow activity (:func:`rainfall_design`), errors clustered by unit and by cell and year, and
    marginal effects of one deviation more of rainfall averaged over a seeded sample of its rows.
    """
    spark, label = base.sparkSession, "shallow_active"
    effects, contrasts, joint, coefficients, missing, support, records = [], [], [], [], [], [], []
    for days, measure in measures.items():
        # complete cases of a measure go before the next one's are written
        with temporary(spark):
            own, report, terms, gaps = rainfall_design(base, rain, measure, static, reference)
            missing.append(report.withColumn("duration_days", F.lit(days)))
            own = own.persist()
            try:
                fit = models.binomial(own, terms, label)
                units, cells = models.two_way_covariance(own, fit, "su_id", "grid_year", label, correction)
                rows = own.withColumn("_id", F.concat_ws("|", "su_id", "year"))
                rows = randomization.seeded_sample(rows, sample, seed, "_id") if sample is not None and sample < fit.n else rows
                settings = {c: {f"gap={g}": float(g == c) for g in gaps} for c in [*gaps, reference]}
                found = models.marginal_effects(rows, fit, settings, "rx_z")
                held = own.groupBy(F.col("gap_shallow_category").alias("history_state")).agg(F.count("*").alias("n_rows"), F.sum(label).cast("long").alias("active_outcomes"), F.count_distinct("su_id").alias("n_slope_units")).collect()
            finally:
                own.unpersist()
        support += [(measure, days, *r, r["active_outcomes"] / r["n_rows"]) for r in sorted(held, key=lambda r: ORDER.index(r["history_state"]))]
        n = min(fit.n, sample) if sample is not None else fit.n
        own_effects, own_contrasts = models.effect_rows(fit, found, reference)
        for state, e, se, low, high, p in own_effects:
            effects.append((measure, days, state, GAP_LABELS[state], n, e, 100 * e, se, low, high, 100 * low, 100 * high, p, fit.n, units, cells))
        for state, e, se, low, high, p in own_contrasts:
            contrasts.append((measure, days, state, GAP_LABELS[state], reference, e, 100 * e, se, low, high, 100 * low, 100 * high, p))
        if gaps:
            w, df, p = models.joint_test(fit, [f"rx_z:gap={g}" for g in gaps])
            joint.append((measure, days, w, df, p, fit.n, units, cells))
        errors = np.sqrt(np.maximum(np.diag(fit.covariance), 0))
        coefficients += [(t, float(b), float(s), measure, days) for t, b, s in zip(terms, fit.beta, errors, strict=True)]
        records.append({"duration_days": days, "rainfall": measure, "terms": terms, "n_rows": fit.n, "n_standardization_rows": n, "iterations": fit.iterations, "covariance": "two-way cluster inclusion-exclusion covariance", "interval": f"estimate +- {Z95} standard errors"})
    interval = "CI95_low_probability double, CI95_high_probability double, CI95_low_percentage_points double, CI95_high_percentage_points double"
    key = "rainfall string, duration_days int, history_state string, history_label string"
    contrasts_df = spark.createDataFrame(contrasts, f"{key}, reference_state string, AME_contrast_probability double, AME_contrast_percentage_points double, SE_contrast_two_way double, {interval}, p_contrast double")
    joint_df = spark.createDataFrame(joint, "rainfall string, duration_days int, joint_interaction_wald_two_way double, df int, p_two_way double, n_rows long, n_SU_clusters long, n_grid_year_clusters long")
    tests = contrasts_df.select("rainfall", "duration_days", "history_state", F.col("p_contrast").alias("p_pointwise"), F.lit("AME contrast vs >10 years").alias("test_family"))
    tests = tests.unionByName(joint_df.select("rainfall", "duration_days", F.lit("all interactions").alias("history_state"), F.col("p_two_way").alias("p_pointwise"), F.lit("duration-level joint interaction").alias("test_family")))
    tables = {
        "effects": spark.createDataFrame(effects, f"{key}, n_standardized long, AME_probability double, AME_percentage_points double, SE_probability_two_way double, {interval}, p_AME double, n_rows_model long, n_SU_clusters long, n_grid_year_clusters long"),
        "contrasts": contrasts_df,
        "joint_tests": joint_df,
        "multiplicity": holm(tests, "p_pointwise", ["test_family"], ["duration_days", "history_state"]),
        "coefficients": spark.createDataFrame(coefficients, "term string, estimate double, se_two_way_cluster double, rainfall string, duration_days int"),
        "missingness": reduce(DataFrame.unionByName, missing),
        "support": spark.createDataFrame(support, "rainfall string, duration_days int, history_state string, n_rows long, active_outcomes long, n_slope_units long, observed_rate double"),
    }
    return tables, records
