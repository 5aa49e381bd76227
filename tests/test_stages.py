"""The command, from tables to reports, on a small panel."""

import csv
import json
import random

import pytest

from chronopanel.plans import stages
from chronopanel.sources import contract

YEARS = [y for y in range(1990, 2010) if y != 1991]


@pytest.fixture
def folder(tmp_path):
    rng = random.Random(1)
    units = [f"u{i}" for i in range(40)]
    active = {(u, y): rng.random() < (0.35, 0.08)[int(u[1:]) % 2] for u in units for y in YEARS}

    def table(name, header, rows):
        with (tmp_path / name).open("w", newline="") as f:
            csv.writer(f).writerows([header, *rows])

    table("response_panel.csv", ("SUID", "year", "count"), [(u, y, int(a)) for (u, y), a in active.items()])
    table("events.csv", ("su_id", "year_original", "type", "x_m", "y_m"), [(u, y, "shallow", int(u[1:]) * 10 + rng.random() * 9, rng.random() * 9) for (u, y), a in active.items() if a])
    rain = ("su_id", "year", "monsoon_mm", "rx1", "rx3", "rx5", "Rx7day", "rx10day_mm", "rx15day_mm", "rx30day_mm")
    table("rainfall.csv", rain, [(u, y, *[rng.random() * 9 for _ in range(8)]) for u in units for y in range(1989, 2010)])
    static = [x for x in stages.STATIC if x != "log_su_area"]
    table("terrain.csv", ("su_id", *static), [(u, *[rng.randrange(50) for _ in static]) for u in units])  # whole numbers are numbers too
    table("parent_material.csv", ("su_id", "lithology"), [(u, ["UF1", "UF2", "GN"][i % 3]) for i, u in enumerate(units)])
    table("weights.csv", ("su_id", "cell_id", "overlap_area"), [(u, f"g{i % 5}", 1.5) for i, u in enumerate(units)])
    table("slope_units.csv", ("su_id", "x_m", "y_m", "su_area_m2"), [(u, i, i, 100.0 + i) for i, u in enumerate(units)])
    (tmp_path / "run.toml").write_text(f"""
input = "."
output = "out"
observed_years = {YEARS}
missing_years = [1991]
files = {{grid_weights = "weights.csv"}}
test_years = [2007, 2008, 2009]
first_training_year = 1992
provenance = {{rainfall = {{product = "daily grid", resolution = "3 km", reference = "survey"}}}}
""")
    return tmp_path


def test_run(spark, folder):
    config = stages.Config.load(str(folder / "run.toml")).quick()
    config.draws, config.permutations, config.burn_in, config.thin, config.checkpoint_draws = 6, 3, 20, 5, 1
    stages.run(spark, config, list(stages.STAGES))
    out = folder / "out_quick"
    read = lambda name: list(csv.DictReader((out / f"tables/{name}.csv").open()))
    assert {json.loads((out / f"manifests/{s}.json").read_text())["status"] for s in stages.STAGES} == {"complete"}
    assert len(json.loads((out / "manifests/validate.json").read_text())["inputs"]) == 7
    assert {r["model"] for r in read("forward_metrics_pooled")} == set(stages.prediction_sets(config)) and read("forward_metrics_pooled")[0]["calibration_slope"]
    assert len(read("forward_metrics_by_year")) == 6 and {"numeric__prior_failure", "categorical__parent_material_UF1"} <= {r["feature"] for r in read("prediction_fold_coefficients")}
    assert {r["duration_days"] for r in read("rainfall_contrasts")} == {"7", "15"} and len(read("rainfall_contrasts")) == 8
    terms = {r["term"] for r in read("rainfall_coefficients")}
    assert {"rx_between_z", "prior_shallow_active_years_z", "log_su_area_z", "material=UF", "year=2001", "rx_z:gap=1_year"} <= terms and "material=UF1" not in terms
    assert len(read("recurrence_focal_effects")) == 6 and any(r["term"].startswith("year:") for r in read("recurrence_all_coefficients"))
    assert len(read("observed_vs_time_permutation")) == 6 and len(read("TableS7A_pooled_forward_prediction_performance")) == 3
    checks = {(r["section"], r["check"]): r for r in read("publication_readiness_checks")}
    assert {r["passed"] for r in checks.values()} == {"true"} and checks["rainfall", "durations"]["observed"] == "7,15"
    assert {r["analysis"] for r in read("main_text_numerical_results")} == {"recurrence", "temporal fixed-margin null", "spatial chronology null", "forward prediction"}
    predictors = {r["variable"]: r for r in read("TableS1_predictors")}
    assert {"gap_time_category", "monsoon_within_z", "rx7day_mm", "rx15day_mm", "rx10day_mm_lag1", "log_su_area", "parent_material"} <= set(predictors)
    assert predictors["rx7day_mm"]["source_product"] == "daily grid" and predictors["rx7day_mm"]["native_resolution_or_map_scale"] == "3 km" and not predictors["monsoon_within_z"]["n_rows"]
    assert int(predictors["gap_time_category"]["n_missing"]) > 0 and predictors["prior_failure"]["maximum"] == "1.0" and not predictors["parent_material"]["minimum"]
    index = read("Supplementary_File_Index")
    assert {r["status"] for r in index} == {"included"} and (out / "supplement" / f"{index[0]['supplement_number']}_{index[0]['file'].split('/')[1]}").exists()
    assert len(read("figure_manifest")) > 5 and json.loads((out / "models/forward_prediction_specification.json").read_text())["quick_mode"]
    # a stage whose table is gone is told by the audit
    (out / "tables/rainfall_contrasts.csv").unlink()
    config.expected = {"prediction: held-out rows of each model": "1"}
    stages.run(spark, config, ["publication_audit"])
    summary = json.loads((out / "tables/publication_readiness_summary.json").read_text())
    assert summary["blocking_check_names"] == ["prediction: held-out rows of each model", "rainfall: AME contrast table"]


def test_stopped_stages_go_on_with_their_own_steps(spark, folder, monkeypatch):
    """A run that was stopped is resumed; after a change of the panel or events in the same folder the draws are those of a fresh run."""
    from chronopanel.operators import randomization, spatial

    def config(output):
        k = stages.Config.load(str(folder / "run.toml"))
        k.draws, k.burn_in, k.thin, k.checkpoint_draws, k.permutations = 27, 20, 5, 2, 250
        return stages.replace(k, output=str(folder / output))

    tables = ("temporal_fixed_margin_summary", "observed_vs_time_permutation")
    result = lambda output: [(folder / output / f"tables/{t}.csv").read_text() for t in tables]
    steps = lambda: {p: p.stat().st_mtime_ns for kind in ("temporal_steps", "spatial_draws") for p in (folder / "out/data").glob(f"{kind}_*")}
    for module, name, stage in ((randomization, "chain_steps", "temporal"), (spatial, "permuted_nearest", "spatial")):
        whole, calls = getattr(module, name), []

        def stopped(*args, whole=whole, calls=calls):
            calls.append(1)
            if len(calls) == 3:
                raise KeyboardInterrupt
            return whole(*args)

        with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
            m.setattr(module, name, stopped)
            stages.run(spark, config("out"), ["history", stage])
    before = steps()
    assert len(before) == 4
    stages.run(spark, config("out"), ["history", "temporal", "spatial"])
    assert before.items() <= steps().items() and len(steps()) == 5 + 3  # what was there wasn't made again
    first = result("out")
    stages.run(spark, config("fresh"), ["history", "temporal", "spatial"])
    assert result("fresh") == first
    # one cell of the panel and one event change
    rows = list(csv.reader((folder / "response_panel.csv").open()))
    at = next(i for i, r in enumerate(rows) if r[2] == "0" and i > 50)
    rows[at][2] = "1"
    events = list(csv.reader((folder / "events.csv").open()))
    events[1][3] = str(float(events[1][3]) + 3)
    for name, new in (("response_panel.csv", rows), ("events.csv", events)):
        with (folder / name).open("w", newline="") as f:
            csv.writer(f).writerows(new)
    stages.run(spark, config("out"), ["history", "temporal", "spatial"])
    assert not before.keys() & steps().keys() and len(steps()) == 5 + 3
    stages.run(spark, config("fresh2"), ["history", "temporal", "spatial"])
    again = result("out")
    assert again == result("fresh2") and all(a != b for a, b in zip(again, first, strict=True))


def test_chains_of_trades_go_on_where_a_run_stopped(spark, folder, monkeypatch):
    from chronopanel.operators import trades

    def config(output):
        k = stages.Config.load(str(folder / "run.toml"))
        k.draws, k.burn_in_rounds, k.thin_rounds, k.checkpoint_draws, k.chain_method = 9, 3, 1, 1, "trades"
        return stages.replace(k, output=str(folder / output))

    whole, calls = trades.Traders.take, []

    def stopped(self, *args):
        calls.append(args[0])
        if len(calls) == 3:
            raise KeyboardInterrupt
        return whole(self, *args)

    with monkeypatch.context() as m, pytest.raises(KeyboardInterrupt):
        m.setattr(trades.Traders, "take", stopped)
        stages.run(spark, config("traded"), ["history", "temporal"])
    with monkeypatch.context() as m:
        m.setattr(trades.Traders, "take", lambda self, *args: calls.append(args[0]) or whole(self, *args))
        stages.run(spark, config("traded"), ["history", "temporal"])
    assert calls == [0, 1, 2, 2]  # the first two batches were there
    stages.run(spark, config("traded_fresh"), ["history", "temporal"])
    result = lambda output: [(folder / output / f"tables/{t}.csv").read_text() for t in ("temporal_fixed_margin_summary", "temporal_chain_diagnostics")]
    assert result("traded") == result("traded_fresh")
    assert json.loads((folder / "traded/models/temporal_randomization_specification.json").read_text())["thinning_rounds"] == 1


def test_failed_stages_leave_their_manifest(spark, folder):
    config = stages.Config.load(str(folder / "run.toml"))
    config.observed_years = [1999]
    for stage in ("validate", "history"):
        with pytest.raises(ValueError):
            stages.run(spark, config, [stage])
        assert json.loads((folder / f"out/manifests/{stage}.json").read_text())["status"] == "failed"
    config = stages.Config.load(str(folder / "run.toml"))
    (folder / "terrain.csv").unlink()
    with pytest.raises(contract.ContractError, match="terrain: exists"):
        stages.run(spark, config, ["validate"])
    assert "terrain,exists,false,missing" in (folder / "out/tables/input_contract.csv").read_text()
    config.lagged = ["rx2day_mm"]
    with pytest.raises(contract.ContractError, match="rx2day_mm"):
        stages.prediction(stages.Context(spark, config))
