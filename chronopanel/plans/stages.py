"""Stages from input tables to report tables, and a command that runs them.

``python -m chronopanel.plans.stages --config run.toml [--stage NAME] [--quick]``: the file names the fields of :class:`Config`. The
input folder holds response_panel, events, rainfall, terrain, parent_material, grid_weights and slope_units, as Parquet, CSV or GeoPackage, in
any file system that Spark reads; files may have other names (``files``). Tables go to the output folder (``_quick`` added
for quick runs), with a specification for each model and a manifest for each stage, also where it fails.
"""

from __future__ import annotations

import argparse
import tomllib
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronopanel.functions import scalar
from chronopanel.operators import audit, covariates, effects, evaluate, forward, history, models, randomization, report, spatial, trades
from chronopanel.sources import contract, files, sinks
from chronopanel.sources.tables import temporary

SUFFIXES = ("parquet", "csv", "gpkg")
KINDS = {"response_panel": "response", "events": "events", "rainfall": "rainfall", "terrain": "terrain", "parent_material": "parent_material", "grid_weights": "grid_weights", "slope_units": "slope_units"}
DURATIONS = {n: f"rx{n}day_mm" for n in (1, 3, 5, 7, 10, 15, 30)}
SCORES = ["average_precision", "roc_auc", "brier_score", "log_loss"]
PAIRS = [("P1_history", "P0_static"), ("P2_history_lagged_rain", "P1_history"), ("P2_history_lagged_rain", "P0_static")]
# The predictors of the models.
STATIC = [
    "elev_min_m", "elev_max_m", "elev_std_m", "elev_median_m", "relief_m", "slope_median_deg", "slope_std_deg", "slope_p90_deg", "twi_median", "tri_median",
    "distance_stream_median_m", "plan_curvature_median", "profile_curvature_median", "northness_mean", "eastness_mean", "log_su_area",
]
RAINFALL_STATIC = ["log_su_area", "slope_median_deg", "elev_median_m", "relief_m", "twi_median", "distance_stream_median_m", "northness_mean", "eastness_mean"]
HISTORY = ["prior_failure", "prior_active_years_log1p", "prior_landslide_count_log1p"]


@dataclass
class Config:
    """What a run needs to know; quick() makes the small version."""

    input: str
    output: str
    observed_years: list[int] = field(default_factory=list)
    missing_years: list[int] = field(default_factory=list)
    files: dict[str, str] = field(default_factory=dict)
    strict_units: int | None = None
    # EPSG number of the system, in metres, that points and areas are taken to; None takes metres as they are
    projected_crs: int | str | None = None
    seed: int = 20240517
    # the mixed model
    year_effects: bool = True
    vcp_p: float = 0.5
    fe_p: float = 2.0
    maxiter: int = 1500
    gtol: float = 1e-5
    # swap chains
    seeds: list[int] = field(default_factory=lambda: [11, 12, 13])
    draws: int = 9999
    burn_in: int = 100_000
    thin: int = 10_000
    # swaps: a chain is a sequence in one task; trades: rounds of pairs as Spark stages, for any number of units
    chain_method: str = "swaps"
    burn_in_rounds: int = 100
    thin_rounds: int = 10
    checkpoint_draws: int = 500
    # permutations
    permutations: int = 9999
    permutation_scope: str = "within_slope_unit"
    tolerance_m: float = 0.01
    # prediction
    first_training_year: int | None = None
    test_years: list[int] = field(default_factory=list)
    lagged: list[str] = field(default_factory=lambda: ["monsoon_rainfall_mm", "rx10day_mm", "rx30day_mm"])
    static_predictors: list[str] = field(default_factory=lambda: list(STATIC))
    c: float = 1.0
    fractions: list[float] = field(default_factory=lambda: [0.01, 0.02, 0.05, 0.1])
    # rainfall
    durations: list[int] = field(default_factory=lambda: list(DURATIONS))
    rainfall_static: list[str] = field(default_factory=lambda: list(RAINFALL_STATIC))
    standardization_rows: int | None = 5000
    material_groups: dict[str, str] = field(default_factory=lambda: {"UF1": "UF", "UF2": "UF"})
    excluded_materials: list[str] = field(default_factory=list)
    small_sample_correction: bool = True
    # product, resolution and reference of each source: terrain, slope_units, parent_material, history_panel, rainfall
    provenance: dict[str, dict[str, str]] = field(default_factory=dict)
    # the audit's own expectations, by "section: check"
    expected: dict[str, str] = field(default_factory=dict)
    is_quick: bool = False

    def quick(self) -> Config:
        rows = 1000 if self.standardization_rows is None else min(1000, self.standardization_rows)
        return replace(self, output=f"{self.output}_quick", draws=99, burn_in=1000, thin=100, burn_in_rounds=10, thin_rounds=2, permutations=99, test_years=self.test_years[:2], durations=[7, 15], standardization_rows=rows, is_quick=True)

    @classmethod
    def load(cls, path: str) -> Config:
        """From a TOML file; relative folders are those beside it."""
        text = tomllib.loads(Path(path).read_text())
        beside = lambda p: p if "://" in p else str((Path(path).parent / p).resolve())
        return cls(**text | {k: beside(text[k]) for k in ("input", "output")})


class Context:
    def __init__(self, spark: SparkSession, config: Config):
        self.spark, self.config = spark, config

    def source(self, name: str) -> str:
        given = self.config.files.get(name)
        return contract.one_of(self.spark, self.config.input, [given] if given else [f"{name}.{s}" for s in SUFFIXES])

    def has(self, name: str) -> bool:
        try:
            return bool(self.source(name))
        except contract.ContractError:
            return False

    def read(self, name: str, required: tuple[str, ...] = ("su_id", "year")) -> DataFrame:
        return contract.read_table(self.spark, self.source(name), required, crs=self.config.projected_crs)

    def rainfall(self, measures: list[str]) -> DataFrame:
        """Units, years and these measures, one row a unit and year."""
        fields = ("su_id", "year", *measures)
        return contract.keyed(self.read("rainfall", fields).select(*fields), ["su_id", "year"], "rainfall")

    def static(self) -> DataFrame:
        """Terrain, material and area of each unit; materials under their source codes."""
        materials = contract.keyed(self.read("parent_material", ("su_id", "parent_material")), ["su_id"], "parent_material")
        area = [c for c in ("su_area_m2",) if c in materials.columns]
        terrain = contract.keyed(self.read("terrain", ("su_id",)), ["su_id"], "terrain")
        areas = None
        if not area and "su_area_m2" not in terrain.columns:
            areas = contract.keyed(self.read("slope_units", ("su_id", "su_area_m2")), ["su_id"], "slope_units")
        named = materials.select("su_id", scalar.trimmed(F.col("parent_material")).alias("parent_material"), *area)
        return covariates.static_features(terrain.drop("parent_material", *area), named, areas=areas)

    def cells(self) -> DataFrame:
        weights = contract.read_table(self.spark, self.source("grid_weights"), ("su_id", "grid_id", "weight"))
        return covariates.dominant_cell(weights.withColumns({"weight": F.col("weight").cast("double"), "grid_id": F.col("grid_id").cast("string")})).select("su_id", "grid_id")

    def path(self, kind: str, name: str) -> str:
        return f"{self.config.output.rstrip('/')}/{kind}/{name}"

    def stored(self, name: str) -> DataFrame:
        """A table of an earlier stage."""
        at = self.path("data", f"{name}.parquet")
        if not files.exists(self.spark, at):
            raise contract.ContractError(f"{name} isn't there; run its stage first")
        return self.spark.read.parquet(at)

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path("data", f"{name}.parquet"))
        return self.stored(name)

    def resumed(self, kind: str, digest: str, step: int, build: Callable[[], DataFrame]) -> DataFrame:
        """A step of a long stage: as an earlier run with the same digest left it, else built and stored now."""
        name = f"{kind}_{digest}_{step:06d}"
        if not files.exists(self.spark, self.path("data", f"{name}.parquet/_SUCCESS")):
            return self.store(build(), name)
        return self.stored(name)

    def forget(self, kind: str, digest: str) -> None:
        """Delete the steps that runs on other inputs or settings left."""
        for path in files.listed(self.spark, self.path("data", f"{kind}_*")):
            if not path.rpartition("/")[2].startswith(f"{kind}_{digest}_"):
                files.remove(self.spark, path)

    def specify(self, name: str, record: dict) -> None:
        """What a model was, for the record."""
        sinks.write_json(self.spark, self.path("models", f"{name}_specification.json"), record | {"quick_mode": self.config.is_quick})


def validate(c: Context) -> dict[str, DataFrame]:
    """The input contract of every input; inputs that aren't there fail it."""
    absent = [(n, "exists", False, "missing") for n in KINDS if not c.has(n)]
    checks = [c.spark.createDataFrame(absent, contract.CHECKS_SCHEMA)]
    manifests = []
    for name, kind in KINDS.items():
        if any(name == a[0] for a in absent):
            continue
        path = c.source(name)
        df = contract.raw_table(c.spark, path, crs=c.config.projected_crs)
        checks.append(contract.input_checks(df, kind, name, [x for x in c.config.static_predictors if x != "log_su_area"], c.has("events")))
        sizes = files.hashes(c.spark, [path]).agg(F.sum("bytes").alias("bytes"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list("sha256"))), 256).alias("sha256"))
        rows = df.agg(F.count("*").alias("rows"))
        manifests.append(sizes.crossJoin(rows).select(F.lit(name).alias("file"), F.lit(path).alias("path"), "bytes", "sha256", "rows", F.lit("|".join(df.columns)).alias("columns")))
    if c.has("response_panel"):
        panel = c.read("response_panel")
        found = contract.period_check(panel, c.config.observed_years)
        row = lambda check, passed, *detail: found.select(F.lit("response_panel").alias("file"), F.lit(check).alias("check"), passed.alias("passed"), F.concat_ws(" ", *detail).alias("detail"))
        checks.append(row("balanced over the expected years", F.col("balanced") & F.col("years_as_expected"), "units", "rows"))
        if c.config.strict_units is not None:
            checks.append(row("number of units", F.col("units") == c.config.strict_units, "units"))
    out = {"input_contract": reduce(DataFrame.unionByName, checks)}
    return out | ({"input_manifest": reduce(DataFrame.unionByName, manifests)} if manifests else {})


def build_history(c: Context) -> dict[str, DataFrame]:
    panel = contract.keyed(c.read("response_panel"), ["su_id", "year"], "response_panel")
    found = contract.period_check(panel, c.config.observed_years).first()
    if not found["balanced"] or not found["years_as_expected"]:
        raise contract.ContractError(f"response_panel isn't balanced over the observed years {c.config.observed_years}")
    if c.config.strict_units is not None and found["units"] != c.config.strict_units:
        raise contract.ContractError(f"{found['units']} units, {c.config.strict_units} expected")
    events = c.read("events") if c.has("events") else None
    built = c.store(history.build_history(history.derive_response(panel, events), c.config.missing_years), "history_panel")
    return {"panel_year_audit": history.year_audit(built), "history_exclusion_audit": history.exclusion_audit(built), "recurrence_risk_support": history.risk_support(built)}


def recurrence(c: Context) -> dict[str, DataFrame]:
    """The mixed model of recurrence by elapsed time."""
    rain = c.rainfall(["monsoon_rainfall_mm"])
    panel = contract.checked_join(c.stored("history_panel"), rain, ["su_id", "year"], "rainfall", one_to_one=True)
    frame = effects.recurrence_frame(panel, rain)
    missing = covariates.missing_report(frame, effects.RECURRENCE_COLUMNS, "recurrence_mixed_effects")
    complete = c.store(covariates.complete_cases(frame, effects.RECURRENCE_COLUMNS), "recurrence_model_dataset")
    tables, record = effects.recurrence_model(complete, year_effects=c.config.year_effects, prior_log_sd=c.config.vcp_p, prior_fixed=c.config.fe_p, most=c.config.maxiter, tolerance=c.config.gtol)
    c.specify("recurrence_model", record | {"estimator": "variational Bayes, independent Gaussians", "vcp_p": c.config.vcp_p, "fe_p": c.config.fe_p, "active_outcomes": complete.agg(F.sum("active")).first()[0], "interpretation": "intervals are approximate posterior credible intervals"})
    return {"recurrence_missingness": missing, "recurrence_all_coefficients": tables["coefficients"], "recurrence_focal_effects": tables["focal"], "recurrence_gap_support": tables["support"], "climatology": covariates.climatology(rain, "monsoon_rainfall_mm")}


def _swapped(c: Context, matrix: DataFrame, plan: DataFrame) -> tuple[list[DataFrame], Callable[[], None], dict]:
    """Draws of swap chains by batches, what forgets the steps of other inputs, and the record of the method."""
    k = c.config
    most = plan.agg(F.max("n_draws")).first()[0]
    # steps belong to the very matrix, years and settings that they came from
    digest = files.digest(matrix, k.observed_years, k.missing_years, k.seeds, k.draws, k.burn_in, k.thin, k.checkpoint_draws)
    start = c.store(randomization.chain_starts(matrix, plan), "temporal_start")
    chains, parts = start, []
    for first in range(0, most, k.checkpoint_draws):
        batch = F.greatest(F.lit(0), F.least(F.lit(k.checkpoint_draws), F.col("whole") - first)).cast("int")
        now = chains.drop("n_draws").join(plan.select("chain", F.col("n_draws").alias("whole")), "chain").withColumn("n_draws", batch).drop("whole")
        parts.append(c.resumed("temporal_steps", digest, first, lambda now=now: randomization.chain_steps(now, k.observed_years, k.missing_years, k.burn_in, k.thin)))
        chains = randomization.chain_after(start, parts[-1], 0)
    how = {"algorithm": "uniform proposals of two rows and two years; checkerboards are swapped, other proposals keep the state", "burn_in_attempted_swaps": k.burn_in, "thinning_attempted_swaps": k.thin}
    return [p.where("gap_time_category is not null").drop("masks", "generator") for p in parts], lambda: c.forget("temporal_steps", digest), how


def _traded(c: Context, matrix: DataFrame, plan: DataFrame) -> tuple[list[DataFrame], Callable[[], None], dict]:
    """As :func:`_swapped` by rounds of trades; a batch leaves its draws and the state after them, on which the next one goes on."""
    k = c.config
    most = plan.agg(F.max("n_draws")).first()[0]
    digest = files.digest(matrix, k.observed_years, k.missing_years, k.seeds, k.draws, k.burn_in_rounds, k.thin_rounds, k.checkpoint_draws)
    traders = trades.Traders(matrix, plan, k.observed_years, k.missing_years, k.burn_in_rounds, k.thin_rounds)
    state, parts = None, []
    for first in range(0, most, k.checkpoint_draws):
        made = cache(lambda first=first, state=state: traders.take(first, min(k.checkpoint_draws, most - first), state))
        with temporary(c.spark):
            # a run that was stopped between the two makes the batch again, which gives the same
            parts.append(c.resumed("temporal_trades", digest, first, lambda made=made: made()[0]))
            state = c.resumed("temporal_state", digest, first, lambda made=made: made()[1])

    def forget() -> None:
        c.forget("temporal_trades", digest)
        c.forget("temporal_state", digest)

    how = {"algorithm": "rounds of random pairs of rows; each pair deals anew the years that only one of them has", "burn_in_rounds": k.burn_in_rounds, "thinning_rounds": k.thin_rounds}
    return parts, forget, how


def temporal(c: Context) -> dict[str, DataFrame]:
    """Chains of swaps or of trades, stored and resumed by batches of draws."""
    built, k = c.stored("history_panel"), c.config
    rates = randomization.observed_gap_rates(history.risk_set(built))
    plan = randomization.schedule(c.spark, k.draws, k.seeds)
    matrix = history.activity_matrix(built, k.observed_years)
    parts, forget, how = {"swaps": _swapped, "trades": _traded}[k.chain_method](c, matrix, plan)
    draws = c.store(reduce(DataFrame.unionByName, parts), "temporal_draws")
    if not draws.agg(F.bool_and("margins_kept")).first()[0]:
        raise contract.ContractError("a draw doesn't keep the margins")
    forget()
    drawn = randomization.statistics(draws, ["chain", "draw"])
    names = [x for x in drawn.columns if x not in ("chain", "draw")]
    drawn = c.store(drawn, "temporal_fixed_margin_null")
    long = drawn.unpivot(["chain", "draw"], names, "statistic", "value")
    observed = randomization.statistics(rates)
    c.specify("temporal_randomization", how | {"chains": len(k.seeds), "seeds": k.seeds, "retained_draws": k.draws})
    return {"temporal_observed_gap_rates": rates, "temporal_observed_statistics": observed, "temporal_fixed_margin_summary": randomization.empirical_summary(long.select("statistic", "value"), observed.unpivot([], names, "statistic", "value")), "temporal_chain_diagnostics": randomization.chain_diagnostics(draws), "temporal_chain_mixing_diagnostics": randomization.mixing(long)}


def spatial_stage(c: Context) -> dict[str, DataFrame]:
    """Distances to the nearest earlier location against permuted years."""
    k = c.config
    events = spatial.event_identity(c.read("events"))
    raw = spatial.with_keys(spatial.clean_events(events, k.observed_years), k.tolerance_m)
    at = c.store(spatial.fixed_locations(raw).withColumn("slot", F.col("source_event_index")), "fixed_locations")
    found = c.store(spatial.nearest_prior(at, k.missing_years), "observed_recurrent_distances_distinct")
    observed = spatial.distance_summary(found)
    # permutations by hundreds bound what a shuffle holds at once
    digest = files.digest(at, k.missing_years, k.permutation_scope, k.seed, k.permutations)

    def drawn(first: int) -> DataFrame:
        n = min(100, k.permutations - first)
        if k.permutation_scope == "within_slope_unit":
            one = spatial.permuted_nearest(at, n, k.seed, k.missing_years, first)
        else:
            one = spatial.nearest_prior(spatial.permuted_years(at, n, k.seed, k.permutation_scope, first), k.missing_years, ["perm"])
        return spatial.distance_summary(one, ["perm"])

    parts = [c.resumed("spatial_draws", digest, first, lambda first=first: drawn(first)) for first in range(0, k.permutations, 100)]
    draws = c.store(reduce(DataFrame.unionByName, parts), "time_label_permutation_null")
    c.forget("spatial_draws", digest)
    c.specify("spatial_randomization", {"input_event_rows": events.count(), "valid_observed_event_rows": raw.count(), "fixed_location_rows": at.count(), "time_label_shuffle_scope": k.permutation_scope, "coordinate_tolerance_m": k.tolerance_m, "seed": k.seed, "permutations": k.permutations, "coordinates": "points, a point inside polygons", "distance_crs": str(k.projected_crs or "as given"), "distance_units": "metres"})
    return {"spatial_location_multiplicity": spatial.multiplicity(raw), "spatial_year_counts_before_after_dedup": spatial.year_counts(raw, at), "observed_distinct_location_summary": observed, "observed_vs_time_permutation": spatial.null_summary(observed, draws)}


def rainfall(c: Context) -> dict[str, DataFrame]:
    """Marginal effects of rainfall extremes by elapsed time, for each duration."""
    k = c.config
    measures = {n: DURATIONS[n] for n in k.durations}
    rain = c.rainfall(list(measures.values()))
    panel = contract.checked_join(c.stored("history_panel"), rain, ["su_id", "year"], "rainfall", one_to_one=True)
    frame = contract.checked_join(contract.checked_join(panel, c.static(), ["su_id"], "static"), c.cells(), ["su_id"], "grid cells")
    base, exclusions = effects.rainfall_base(frame, k.rainfall_static, k.material_groups, k.excluded_materials)
    base = c.store(base, "rainfall_model_dataset")
    scaling = base.agg(*[x for s in k.rainfall_static for x in (F.avg(s).alias(f"mean:{s}"), F.stddev_samp(s).alias(f"sd:{s}"))])
    long = scaling.unpivot([], scaling.columns, "name", "value").select(F.split("name", ":")[1].alias("variable"), F.split("name", ":")[0].alias("kind"), "value")
    scaled = long.groupBy("variable").agg(F.max(F.when(F.col("kind") == "mean", F.col("value"))).alias("mean"), F.max(F.when(F.col("kind") == "sd", F.col("value"))).alias("sd"))
    tables, records = effects.rainfall_effects(base, rain, measures, k.rainfall_static, sample=k.standardization_rows, seed=k.seed, correction=k.small_sample_correction)
    c.specify("rainfall_history_model", {"models": records, "AME_definition": "mean over the standardization rows of p(rx_z + 1, history=h) - p(rx_z, history=h)", "cluster_1": "slope unit", "cluster_2": "dominant rainfall grid cell crossed with year", "parent_material_code_map": k.material_groups, "excluded_parent_material_codes": k.excluded_materials})
    return {"rainfall_parent_material_exclusion": exclusions, "rainfall_history_static_scaling": scaled, **{f"rainfall_{name}": df for name, df in tables.items()}}


def prediction_sets(k: Config) -> dict[str, list[str]]:
    """The three sets of features by model."""
    past = [f"{v}_lag1" for v in k.lagged]
    return {"P0_static": list(k.static_predictors), "P1_history": [*k.static_predictors, *HISTORY], "P2_history_lagged_rain": [*k.static_predictors, *HISTORY, *past]}


def prediction(c: Context) -> dict[str, DataFrame]:
    """Expanding-window predictions of three sets of features, and their evaluation."""
    k, sets = c.config, prediction_sets(c.config)
    past = covariates.lagged(c.rainfall(k.lagged), k.lagged)
    current = [x for x in contract.RAINFALL if x in c.stored("history_panel").columns]
    rows = contract.checked_join(c.stored("history_panel").drop(*current), c.static(), ["su_id"], "static")
    rows = contract.checked_join(rows, past, ["su_id", "year"], "lagged rainfall", one_to_one=True)
    if k.first_training_year is not None:
        rows = rows.where(F.col("year") >= k.first_training_year)
    rows = c.store(rows, "prediction_frame")
    made = forward.forward_predictions(rows.where("history_crosses_missing_gap = 0"), k.test_years, sets, "parent_material", c=k.c)
    predicted = c.store(made["predictions"], "forward_predictions")
    features = [x for names in sets.values() for x in names]
    leaks = audit.leakage_checks(predicted.select("test_year", "max_training_year", "rainfall_source_year"), features, list(contract.RAINFALL))
    if failed := [r["check"] for r in leaks.where("not passed").collect()]:
        raise contract.ContractError(f"leakage: {', '.join(failed)}")
    measured = lambda by: c.store(evaluate.metrics(predicted, by).join(models.calibration_lines(predicted, by), by, "left"), f"prediction_metrics_by_{'_'.join(by)}")
    pooled, yearly = measured(["model"]), measured(["model", "test_year"])
    c.specify("forward_prediction", {"estimator": "logistic regression, L2", "C": k.c, "test_years": k.test_years, "first_training_year": k.first_training_year, "feature_sets": sets, "category": "parent_material", "removed_current_year_rainfall": current, "numeric_preprocessing": "median of the training fold, then its mean and population deviation", "risk_set_rule": "all units, but for rows whose history crosses a missing year"})
    return {
        "prediction_leakage_checks": leaks, "prediction_sample_exclusions": audit.prediction_exclusions(rows.where(F.col("year").isin(*k.test_years)), [f"{v}_lag1" for v in k.lagged]), "forward_metrics_pooled": pooled,
        "forward_metrics_by_year": yearly, "top_fraction_performance": evaluate.top_fractions(predicted, ["model", "test_year"], k.fractions),
        "top_fraction_performance_pooled_annual_budget": evaluate.annual_budget(predicted, k.fractions), "calibration_data": evaluate.calibration(predicted), "pooled_calibration": evaluate.pooled_calibration(predicted),
        "incremental_performance": evaluate.increments(pooled, PAIRS, SCORES), "prediction_fold_coefficients": made["coefficients"],
    }


def _tables(c: Context) -> dict[str, DataFrame]:
    """Report tables of earlier stages by name."""
    found = files.listed(c.spark, c.path("tables", "*.csv"))
    return {at.rpartition("/")[2].removesuffix(".csv"): c.spark.read.option("header", True).option("inferSchema", True).csv(at) for at in found}


def publication_audit(c: Context) -> dict[str, DataFrame]:
    """Whether everything that the configuration asks for is there, and the main results in one table. It reports; it doesn't stop a run."""
    k, t = c.config, _tables(c)
    n_chains, sets = len(k.seeds), prediction_sets(k)
    want = {("recurrence", "focal effects with rainfall and burden"): "6", ("temporal", "retained fixed-margin draws"): str(k.draws), ("temporal", "balanced chains"): ",".join(str(k.draws // n_chains + (i < k.draws % n_chains)) for i in range(n_chains)), ("temporal", "mixing diagnostics of seven statistics or more"): "7"}
    want |= {("rainfall", "durations"): ",".join(map(str, sorted(k.durations))), ("rainfall", "AME contrast table"): str(4 * len(k.durations)), ("rainfall", "joint interaction tests"): str(len(k.durations))}
    want |= {("spatial", "permutations in each of six categories"): ",".join([str(k.permutations)] * 6), ("spatial", "specification"): "True"}
    want |= {("prediction", "predictor sets"): ",".join(sorted(sets)), ("prediction", "held-out years"): ",".join(map(str, sorted(k.test_years))), ("prediction", "leakage checks passed"): "4"}
    want |= {tuple(x.split(": ", 1)): str(v) for x, v in k.expected.items()}
    got: list[tuple[str, str, str]] = []

    def measure(section: str, check: str, table: str, *aggregates, stored: bool = False, where: str = "true") -> None:
        """Adds what an aggregate finds in a table that is there, as text."""
        there = files.exists(c.spark, c.path("data", f"{table}.parquet")) if stored else table in t
        if there:
            row = (c.stored(table) if stored else t[table]).where(where).agg(*aggregates).first()
            got.append((section, check, str(row[0])))

    listed = lambda x: F.concat_ws(",", F.array_sort(F.collect_set(x)))
    measure("recurrence", "focal effects with rainfall and burden", "recurrence_focal_effects", F.count("interval_low"))
    measure("temporal", "retained fixed-margin draws", "temporal_fixed_margin_null", F.count("*"), stored=True)
    measure("temporal", "balanced chains", "temporal_chain_diagnostics", F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("chain", "retained_draws"))), lambda x: x["retained_draws"].cast("string"))))
    measure("temporal", "mixing diagnostics of seven statistics or more", "temporal_chain_mixing_diagnostics", F.least(F.lit(7), F.count("*")))
    measure("rainfall", "durations", "rainfall_effects", F.concat_ws(",", F.transform(F.array_sort(F.collect_set("duration_days")), lambda x: x.cast("string"))))
    measure("rainfall", "AME contrast table", "rainfall_contrasts", F.count("*"))
    measure("rainfall", "joint interaction tests", "rainfall_joint_tests", F.count("*"))
    if files.exists(c.spark, c.path("data", "time_label_permutation_null.parquet")):
        sizes = c.stored("time_label_permutation_null").groupBy("gap_model").agg(F.count_distinct("perm").cast("string").alias("n"))
        got.append(("spatial", "permutations in each of six categories", sizes.agg(F.concat_ws(",", F.collect_list("n"))).first()[0]))
    got.append(("spatial", "specification", str(files.exists(c.spark, c.path("models", "spatial_randomization_specification.json")))))
    measure("prediction", "predictor sets", "forward_metrics_pooled", listed("model"))
    measure("prediction", "held-out years", "forward_metrics_by_year", listed(F.col("test_year").cast("string")))
    measure("prediction", "leakage checks passed", "prediction_leakage_checks", F.count_if("passed"))
    measure("prediction", "held-out rows of each model", "forward_metrics_pooled", listed(F.col("n").cast("string")))
    measure("prediction", "positives of each model", "forward_metrics_pooled", listed(F.col("positives").cast("string")))
    spark = c.spark
    wanted = spark.createDataFrame([(*x, v) for x, v in want.items()], "section string, check string, requirement string")
    checks = audit.publication_checks(spark.createDataFrame(got, "section string, check string, observed string"), wanted)
    failed = [f"{r['section']}: {r['check']}" for r in checks.where("blocking and not passed").orderBy("section", "check").collect()]
    sinks.write_json(spark, c.path("tables", "publication_readiness_summary.json"), {"publication_outputs_complete": not failed, "blocking_checks_failed": len(failed), "blocking_check_names": failed, "quick_mode": k.is_quick})
    parts = []

    def results(analysis: str, units: str, table: str, pick) -> None:
        if table in t:
            parts.append((analysis, units, pick(t[table])))

    named = lambda df, **columns: df.select(*[(F.col(v) if isinstance(v, str) else v).alias(n) for n, v in columns.items()])
    results("recurrence", "odds ratio", "recurrence_focal_effects", lambda d: named(d, metric="display_term", estimate="odds_ratio", lower="interval_low", upper="interval_high"))
    results("temporal fixed-margin null", "probability or risk ratio; interval is null 95% interval", "temporal_fixed_margin_summary", lambda d: named(d, metric="statistic", estimate="observed", lower="null_q025", upper="null_q975", p_value="p_upper"))
    results("rainfall-history interaction", "percentage-point AME contrast per +1 local-SD rainfall", "rainfall_contrasts", lambda d: named(d.where("duration_days = 10"), metric=F.concat(F.lit("Rx10 "), "history_state", F.lit(" vs >10 years")), estimate="AME_contrast_percentage_points", lower="CI95_low_percentage_points", upper="CI95_high_percentage_points", p_value="p_contrast"))
    results("spatial chronology null", "metres; interval is null 95% interval", "observed_vs_time_permutation", lambda d: named(d, metric="gap_model", estimate="observed_median_m", lower="null_CI_low_m", upper="null_CI_high_m", p_value="empirical_p_one_sided"))
    results("forward prediction", "average precision", "forward_metrics_pooled", lambda d: named(d, metric=F.concat("model", F.lit(" pooled average precision")), estimate="average_precision"))
    results("forward prediction", "percent of held-out active slope-unit years captured", "top_fraction_performance_pooled_annual_budget", lambda d: named(d.where("abs(top_fraction - 0.05) < 1e-9"), metric=F.concat("model", F.lit(" annual-budget top-5% capture")), estimate=100 * F.col("positive_capture_rate")))
    return {"publication_readiness_checks": checks} | ({"main_text_numerical_results": report.main_results(*parts)} if parts else {})


def _predictors(c: Context) -> DataFrame:
    """Where the predictors of all models come from, by the configuration, and what the inputs and the history panel hold of them."""
    k, measures = c.config, [DURATIONS[n] for n in c.config.durations]
    words = report.predictor_dictionary(c.spark, k.static_predictors, "parent_material", HISTORY, k.lagged, k.rainfall_static)
    terms = [
        ("gap_time_category", "state in recurrence and rainfall models", "history_panel", "five categories, the longest the reference; rows across missing years left out", "categorical years"),
        ("monsoon_within_z", "covariate of the recurrence model", "rainfall", "z-score over the model's risk set", "SD units"),
        *[(v, "exposure of a rainfall model of its own", "rainfall", "a part within and a part between units", "mm") for v in measures],
    ]
    there = [c.stored("history_panel")] if files.exists(c.spark, c.path("data", "history_panel.parquet")) else []
    tables = [c.static(), *there, c.rainfall(measures), covariates.lagged(c.rainfall(k.lagged), k.lagged)]
    return report.predictor_provenance(words, tables, k.provenance, terms).orderBy("analysis_role", "variable")


def presentation(c: Context) -> dict[str, DataFrame]:
    """Tables to print and the sources of figures, of whatever earlier stages left."""
    k, t = c.config, _tables(c)
    made = {"TableS1_predictors": lambda: _predictors(c)}

    def when(name: str, needs: list[str], make: Callable) -> None:
        if all(n in t for n in needs):
            made[name] = lambda: make(*[t[n] for n in needs])

    same = lambda d: d
    when("TableS2A_annual_panel_support", ["panel_year_audit"], same)
    when("TableS2B_recurrence_history_state_support", ["recurrence_gap_support"], report.support_table)
    when("TableS2C_analysis_exclusion_summary", ["history_exclusion_audit", "prediction_sample_exclusions"], history.exclusion_summary)
    when("TableS2D_prediction_exclusions_by_year", ["prediction_sample_exclusions"], same)
    when("TableS3A_recurrence_focal_effects", ["recurrence_focal_effects"], report.focal_table)
    when("TableS3B_recurrence_all_fixed_effect_coefficients", ["recurrence_all_coefficients"], same)
    when("TableS4A_temporal_fixed_margin_results", ["temporal_fixed_margin_summary"], same)
    when("TableS4B_temporal_chain_settings_and_margin_checks", ["temporal_chain_diagnostics"], same)
    when("TableS4C_temporal_chain_mixing_diagnostics", ["temporal_chain_mixing_diagnostics"], same)
    when("TableS5A_state_specific_average_marginal_effects", ["rainfall_effects"], report.effects_table)
    when("TableS5B_AME_contrasts_vs_gt10", ["rainfall_contrasts", "rainfall_multiplicity"], report.contrasts_table)
    when("TableS5C_joint_rainfall_history_interaction_tests", ["rainfall_joint_tests", "rainfall_multiplicity"], report.joint_table)
    when("TableS6_spatial_chronology_randomization_results", ["observed_vs_time_permutation"], lambda d: report.with_state(d, "gap_model"))
    when("TableS7A_pooled_forward_prediction_performance", ["forward_metrics_pooled", "top_fraction_performance_pooled_annual_budget"], report.performance_table)
    when("TableS7B_forward_prediction_performance_by_year", ["forward_metrics_by_year"], same)
    when("TableS7C_incremental_forward_prediction_performance", ["incremental_performance"], same)
    when("Figure_recurrence_forest", ["recurrence_focal_effects"], report.focal_table)
    when("Figure_temporal_departures", ["temporal_fixed_margin_summary"], report.departures)
    when("Figure_spatial_reduction", ["observed_vs_time_permutation"], report.distance_reduction)
    when("Figure_yearly_average_precision", ["forward_metrics_by_year"], lambda d: d.select("model", "test_year", "average_precision", "prevalence"))
    if {"rainfall_contrasts", "rainfall_multiplicity"} <= set(t):
        joined = report.contrasts_table(t["rainfall_contrasts"], t["rainfall_multiplicity"]).withColumnsRenamed({"CI95_low_percentage_points": "low", "CI95_high_percentage_points": "high"})
        labels = [effects.GAP_LABELS[x] for x in effects.ORDER[:-1]]
        made["Figure_rainfall_heatmap"] = lambda: report.heatmap(joined, "duration_days", "history_label", "AME_contrast_percentage_points", labels)
    if files.exists(c.spark, c.path("data", "forward_predictions.parquet")):
        predicted = c.stored("forward_predictions")
        made["Figure_precision_recall"] = lambda: evaluate.curve(predicted, ["model"]).select("model", "score", "precision", "recall")
        made["Figure_capture_curve"] = lambda: evaluate.annual_budget(predicted, [i / 1000 for i in range(1, 201)])
        made["Figure_calibration"] = lambda: evaluate.pooled_calibration(predicted)
    return {name: make() for name, make in made.items()}


def supplement(c: Context) -> dict[str, DataFrame]:
    """Tables and specifications of all stages copied into one folder, with an index of what's there and the hashes of figures' sources."""
    spark, wanted = c.spark, []
    for stage, names in OUTPUTS.items():
        wanted += [(stage, f"tables/{n}.csv") for n in names]
    wanted += [("specifications", f"models/{n}_specification.json") for n in ("recurrence_model", "temporal_randomization", "rainfall_history_model", "spatial_randomization", "forward_prediction")]
    numbered = [(f"S{i:02d}", stage, f) for i, (stage, f) in enumerate(wanted, 1)]
    there = [f for _, _, f in numbered if files.exists(spark, c.path(*f.split("/")))]
    for number, _, f in numbered:
        if f in there:
            kind, name = f.split("/")
            files.copy(spark, c.path(kind, name), c.path("supplement", f"{number}_{name}"))
    index = report.supplement_index(spark.createDataFrame(numbered, "supplement_number string, stage string, file string"), spark.createDataFrame([(f,) for f in there], "file string"))
    figures = files.listed(spark, c.path("tables", "Figure_*.csv"))
    out = {"Supplementary_File_Index": index.orderBy("supplement_number")}
    return out | ({"figure_manifest": files.hashes(spark, figures)} if figures else {})


#: Tables that the index lists, by stage.
OUTPUTS = {
    "validate": ["input_contract", "input_manifest"],
    "history": ["panel_year_audit", "history_exclusion_audit", "recurrence_risk_support"],
    "recurrence": ["recurrence_missingness", "recurrence_gap_support", "recurrence_focal_effects", "recurrence_all_coefficients"],
    "temporal": ["temporal_observed_gap_rates", "temporal_observed_statistics", "temporal_chain_diagnostics", "temporal_chain_mixing_diagnostics", "temporal_fixed_margin_summary"],
    "rainfall": ["rainfall_parent_material_exclusion", "rainfall_support", "rainfall_missingness", "rainfall_effects", "rainfall_contrasts", "rainfall_joint_tests", "rainfall_multiplicity", "rainfall_coefficients"],
    "spatial": ["spatial_location_multiplicity", "spatial_year_counts_before_after_dedup", "observed_distinct_location_summary", "observed_vs_time_permutation"],
    "prediction": ["prediction_sample_exclusions", "prediction_leakage_checks", "forward_metrics_by_year", "forward_metrics_pooled", "incremental_performance", "top_fraction_performance", "top_fraction_performance_pooled_annual_budget", "calibration_data", "prediction_fold_coefficients"],
    "publication_audit": ["publication_readiness_checks", "main_text_numerical_results"],
    "presentation": ["TableS1_predictors"],
}

STAGES: dict[str, Callable[[Context], dict[str, DataFrame]]] = {"validate": validate, "history": build_history, "recurrence": recurrence, "rainfall": rainfall, "prediction": prediction, "temporal": temporal, "spatial": spatial_stage, "publication_audit": publication_audit, "presentation": presentation, "supplement": supplement}


def run(spark: SparkSession, config: Config, names: list[str]) -> None:
    """Run stages in order, each with its tables and a manifest."""
    context = Context(spark, config)
    inputs = sinks.file_hashes(spark, [context.source(n) for n in KINDS if context.has(n)])
    code = {str(p): sinks.local_hash(p) for p in sorted(Path(__file__).parent.parent.rglob("*.py"))}
    for name in names:
        status = "failed"
        try:
            tables = STAGES[name](context)
            for table, df in tables.items():
                sinks.write_table(df, context.path("tables", f"{table}.csv"))
            if "input_contract" in tables:
                contract.assert_passed(spark.read.option("header", True).schema(contract.CHECKS_SCHEMA).csv(context.path("tables", "input_contract.csv")))
            status = "complete"
        finally:
            sinks.write_json(spark, context.path("manifests", f"{name}.json"), sinks.manifest(spark, name, status, inputs, code, asdict(config)))


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--config", required=True, help="a TOML file with the fields of Config")
    p.add_argument("--stage", action="append", choices=list(STAGES))
    p.add_argument("--quick", action="store_true")
    a = p.parse_args(args)
    config = Config.load(a.config)
    spark = SparkSession.builder.appName("chronopanel").getOrCreate()
    try:
        run(spark, config.quick() if a.quick else config, a.stage or list(STAGES))
    except Exception as e:  # the manifest has been written
        print(f"failed: {e}")
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
