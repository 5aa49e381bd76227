"""Operators against small literals and NumPy."""

import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.functions import projection, scalar
from chronopanel.operators import audit, covariates, effects, evaluate, forward, mixed, models, ordered, randomization, report, spatial, tiles
from chronopanel.sources import contract, geopackage, sinks


def test_nearest_prior(spark):
    at = spark.createDataFrame([("u", 1, 0.0, 0.0, 1992), ("u", 2, 3.0, 4.0, 1993), ("u", 3, 0.0, 1.0, 1998), ("u", 4, 6.0, 8.0, 1999)], "su_id string, slot long, x_m double, y_m double, year int")
    found = spatial.nearest_prior(at, [1994, 1995])
    assert {r["slot"]: (r["gap_years"], r["nearest_prior_distance_m"]) for r in found.collect()} == {2: (1, 5.0), 4: (1, 5.0)}
    summary = {r["gap_model"]: (r["n"], r["median_distance_m"]) for r in spatial.distance_summary(found).collect()}
    assert summary["overall"] == (2, 5.0) and summary["gt10_years"] == (0, None) and len(summary) == 6


@pytest.mark.parametrize(("piece", "pairs"), [(4096, 2_000_000), (7, 50)])
def test_nearest_prior_in_slices(spark, monkeypatch, piece, pairs):
    monkeypatch.setattr(tiles, "SLICE", piece)
    monkeypatch.setattr(tiles, "PAIRS", pairs)
    monkeypatch.setattr(tiles, "VISITORS", piece)
    rng = np.random.default_rng(6)
    rows = [(str(u), i, *map(float, rng.random(2)), int(rng.integers(2000, 2006))) for u in range(3) for i in range((40, 1, 90)[u])]
    got = {(r["su_id"], r["slot"]): (r["last_prior_year"], r["nearest_prior_distance_m"]) for r in spatial.nearest_prior(spark.createDataFrame(rows, "su_id string, slot long, x_m double, y_m double, year int"), [2003]).collect()}
    want = {}
    for u, i, x, y, t in rows:
        before = [(q, math.hypot(x - a, y - b)) for v, _, a, b, q in rows if v == u and q < t]
        if before and not (last := max(q for q, _ in before)) < 2003 < t:
            want[u, i] = (last, pytest.approx(min(d for _, d in before)))
    assert got == want
    assert spatial.nearest_prior(spark.createDataFrame([], "su_id string, slot long, x_m double, y_m double, year int"), []).count() == 0


@pytest.mark.parametrize(("piece", "list_"), [(4096, 2), (10, 8)])
def test_permutations_by_lists_are_those_by_labels(spark, monkeypatch, piece, list_):
    """Units of one year, of equal places, of one location, and such as go by tiles."""
    monkeypatch.setattr(tiles, "SLICE", piece)
    monkeypatch.setattr(spatial, "NEIGHBOURS", list_)
    monkeypatch.setattr(spatial, "BLOCK", 3)
    rng = np.random.default_rng(9)
    rows = [(str(u), i, float(rng.integers(0, 6)), float(rng.random()) if u else 0.0, int(rng.integers(2000, 2006)) if u != 2 else 2001) for u in range(4) for i in range((9, 40, 5, 1)[u])]
    at = spark.createDataFrame(rows, "su_id string, slot long, x_m double, y_m double, year int")
    plain = lambda df: sorted((r["perm"], r["su_id"], r["slot"], r["target_year"], r["last_prior_year"], round(r["nearest_prior_distance_m"], 9)) for r in df.collect())
    got = plain(spatial.permuted_nearest(at, 5, 1, [2003], first=2))
    labels = spatial.permuted_years(at, 5, 1, first=2).collect()
    want = []
    for a in labels:
        before = [b for b in labels if (b["perm"], b["su_id"]) == (a["perm"], a["su_id"]) and b["year"] < a["year"]]
        if before and not (last := max(b["year"] for b in before)) < 2003 < a["year"]:
            want.append((a["perm"], a["su_id"], a["slot"], a["year"], last, round(min(math.hypot(a["x_m"] - b["x_m"], a["y_m"] - b["y_m"]) for b in before), 9)))
    assert got == sorted(want)


def test_event_identity_does_not_depend_on_partitions(spark):
    rows = spark.createDataFrame([("u", 2000, 1.0), ("u", 2000, 1.0), ("v", 2001, None), ("w", None, 2.0)], "su_id string, year int, x_m double")
    ids = lambda df: sorted(r["source_event_index"] for r in spatial.event_identity(df).collect())
    assert ids(rows) == ids(rows.repartition(3)) and len(set(ids(rows))) == 4
    assert {r["source_event_index"] for r in spatial.event_identity(rows.withColumn("fid", F.lit(7))).collect()} == {"7"}


@pytest.mark.parametrize("slices", [2, 64])
def test_prefix_sums_and_quantiles(spark, monkeypatch, slices):
    monkeypatch.setattr(ordered, "SLICES", slices)
    rng = np.random.default_rng(8)
    data = pd.DataFrame({"g": rng.choice(["a", "b"], 300), "v": rng.integers(0, 40, 300) / 4, "w": rng.integers(0, 5, 300), "id": np.arange(300)})
    df = spark.createDataFrame(data)
    got = ordered.prefix_sums(df, ["g"], F.col("v"), [F.col("id")], {"s": F.col("w")}, descending=True).toPandas().set_index("id")["s"]
    want = data.sort_values(["g", "v", "id"], ascending=[True, False, True]).assign(s=lambda d: d.groupby("g")["w"].cumsum()).set_index("id")["s"]
    assert (got.sort_index() == want.sort_index()).all()
    shares = [0, 0.1, 0.5, 0.9, 1]
    for by in (["g"], []):
        for r in ordered.quantiles(df, by, "v", shares).collect():
            own = data[data["g"] == r["g"]]["v"] if by else data["v"]
            assert r["quantiles"] == pytest.approx(np.quantile(own, shares))
    names = spark.createDataFrame([("b",), ("a",), ("aaaaaaaaz",), ("aaaaaaaab",), ("é",)], "k string")
    assert {r["k"]: r["code"] for r in covariates.cluster_codes(names, "k").collect()} == {"a": 0, "aaaaaaaab": 1, "aaaaaaaaz": 2, "b": 3, "é": 4}


def test_order_keys_are_in_the_order_of_doubles(spark):
    rng = np.random.default_rng(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0**-1022, 2.0**-1022 - 5e-324, 1.0, 1 - 2.0**-53, 1 + 2.0**-52, 2.0**1023, 1.7976931348623157e308, float("inf"), -float("inf"), 0.1, 0.3, -0.1, *[2.0**i for i in range(-1074, 1024, 41)], *[math.nextafter(2.0**i, 0) for i in range(-1021, 1024, 37)], *map(float, rng.normal(size=200) * 10.0 ** rng.integers(-300, 300, 200))]
    got = {r["x"]: r["k"] for r in spark.createDataFrame([(v,) for v in values], "x double").select("x", ordered.order_key(F.col("x")).alias("k")).collect()}
    ordered_values = sorted(got)
    assert [got[v] for v in ordered_values] == sorted(got.values()) and len(set(got.values())) == len(got)
    bits = lambda v: int(np.float64(abs(v)).view(np.int64)) * (-1 if v < 0 else 1)
    assert all(got[v] == bits(v) for v in values)
    nan = spark.createDataFrame([(float("nan"),)], "x double").select(ordered.order_key(F.col("x"))).first()[0]
    assert nan > max(got.values())


def test_rows_at_ranks(spark):
    """Groups of one key, of near ones, and weights, against a sorted list."""
    rng = np.random.default_rng(4)
    rows = [("a", float(v), i, int(rng.integers(1, 4))) for i, v in enumerate(rng.normal(size=200))] + [("b", 1.0, i, 2) for i in range(9)] + [("c", 1 + i * 2.0**-52, i, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "g string, v double, id long, w long").withColumn("k", ordered.order_key(F.col("v")))
    asked = {"a": [1, 7, 8, 250], "b": [1, 2, 3, 18], "c": [30, 1, 17]}
    wanted = spark.createDataFrame(list(asked.items()), "g string, ranks array<long>")
    got = {(r["g"], r["rank"]): (r["id"], r["before_w"], r["before_id"]) for r in ordered.at_ranks(df, ["g"], "k", ["id"], "w", ["id"], wanted).collect()}
    want = {}
    for g, ranks in asked.items():
        at, ids = 0, 0
        for _, _, i, w in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2])):
            want |= {(g, r): (i, at, ids) for r in ranks if at < r <= at + w}
            at, ids = at + w, ids + i
    assert got == want


@pytest.mark.parametrize("names", ["{:03d}", "unit-with-a-long-name-{:05d}", "é{}"])
def test_top_fractions_break_ties_by_name(spark, names):
    rng = np.random.default_rng(5)
    data = [(m, names.format(i), float(p), int(rng.random() < 0.3)) for m, scores in (("flat", [0.5] * 60), ("few", rng.integers(0, 3, 80) / 4), ("all", rng.random(50))) for i, p in enumerate(scores)]
    frame = spark.createDataFrame(data, "model string, su_id string, predicted_probability double, observed int")
    fractions = [0.001, 0.01, 0.1, 0.35, 0.5, 1.0]
    got = {(r["model"], r["top_fraction"]): (r["selected_rows"], r["captured_positives"], r["total_positives"]) for r in evaluate.top_fractions(frame, ["model"], fractions).collect()}
    want = {}
    for m in ("flat", "few", "all"):
        own = sorted((r for r in data if r[0] == m), key=lambda r: (-r[2], r[1].encode()))
        for f in fractions:
            k = max(1, math.ceil(len(own) * f))
            want[m, f] = (k, sum(r[3] for r in own[:k]), sum(r[3] for r in own))
    assert got == want


@pytest.mark.parametrize(("n", "most"), [(11, 4), (5, 9), (100, 7), (10, 1), (9, 9), (30, 29)])
def test_thinning(spark, n, most):
    got = sorted(r["k"] for r in randomization.thinned(spark.range(n).withColumnRenamed("id", "k"), "k", most).collect())
    assert got == sorted({i * (n - 1) // (most - 1) if most > 1 else 0 for i in range(most)} if n > most else range(n))


def test_no_spread_raises(spark):
    flat = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 2.0), ("a", 2, 2.0)], "su_id string, year int, x double")
    for df in (scalar.zscored(flat, {"x": "z"}), covariates.within_between(flat, flat, "x")):
        with pytest.raises(Exception, match="no spread"):
            df.collect()


def test_rounding_is_half_even(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "x double")
    assert [r[0] for r in df.select(scalar.quantised(F.col("x"), 1.0)).collect()] == [0, 2, 2]


def test_permutations_keep_each_units_years(spark):
    at = spark.createDataFrame([("u", i, 1990 + i % 3) for i in range(7)] + [("v", i, 2000 + i) for i in range(3)], "su_id string, slot long, year int").withColumns({"x_m": F.lit(0.0), "y_m": F.lit(0.0)})
    for r in spatial.permuted_years(at, 5, 1).groupBy("perm", "su_id").agg(F.sort_array(F.collect_list("year")).alias("y")).collect():
        assert r["y"] == sorted([1990 + i % 3 for i in range(7)] if r["su_id"] == "u" else [2000, 2001, 2002])
    everywhere = spatial.permuted_years(at, 3, 1, scope="global").groupBy("perm").agg(F.count("*").alias("n"), F.sum("year").alias("s")).collect()
    assert {(r["n"], r["s"]) for r in everywhere} == {(10, at.agg(F.sum("year")).first()[0])}


def test_within_between(spark):
    x = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 3.0), ("B", 1, 4.0), ("B", 2, 4.0), ("B", 3, 10.0)], "su_id string, year int, x double")
    got = covariates.within_between(x, x, "x").orderBy("su_id", "year").collect()
    assert [r["x_within_z"] for r in got] == pytest.approx([-1, 0, 1, -0.5773502, -0.5773502, 1.1547005])
    assert [got[0]["x_between_z"], got[5]["x_between_z"]] == pytest.approx([-0.7071067, 0.7071067])


def test_dominant_cell_ties(spark):
    w = spark.createDataFrame([("u1", "g2", 0.5), ("u1", "g1", 0.5), ("u1", "g3", 0.1)], "su_id string, grid_id string, weight double")
    assert covariates.dominant_cell(w).first()["grid_id"] == "g1"


def test_holm(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", None)], "k string, p double").withColumn("f", F.lit(1))
    assert {r["k"]: r["p_holm"] for r in scalar.holm(p, "p", ["f"], ["k"]).collect()} == {"a": pytest.approx(0.03), "b": pytest.approx(0.06), "c": pytest.approx(0.06), "d": None}


def test_empirical_summary(spark):
    draws = spark.createDataFrame([("s", float(x)) for x in (1, 2, 3, 4)], "statistic string, value double")
    r = randomization.empirical_summary(draws, spark.createDataFrame([("s", 4.0)], "statistic string, value double")).first()
    assert (r["null_median"], r["null_q025"], r["null_q975"], r["p_lower"], r["p_upper"], r["p_two_sided"]) == pytest.approx((2.5, 1.075, 3.925, 1, 0.4, 0.8))


@pytest.fixture
def scores(spark):
    return spark.createDataFrame([("a", 0.9, 1), ("b", 0.5, 0), ("c", 0.5, 1), ("d", 0.1, 0)], "su_id string, predicted_probability double, observed int").withColumns({"model": F.lit("m"), "test_year": F.lit(1)})


def test_metrics(scores):
    r = evaluate.metrics(scores, ["model"]).first()
    assert (r["average_precision"], r["roc_auc"], r["brier_score"], r["prevalence"]) == pytest.approx((5 / 6, 0.875, 0.13, 0.5))


def test_top_fraction(spark):
    p = spark.createDataFrame([("a", 0.9), ("c", 0.5), ("b", 0.5), ("d", 0.5), ("e", 0.1)], "su_id string, predicted_probability double").withColumns({"observed": (F.col("su_id").isin("a", "b")).cast("int"), "model": F.lit("m"), "test_year": F.lit(1)})
    r = evaluate.top_fractions(p, ["model"], [0.4]).first()
    assert (r["selected_rows"], r["captured_positives"]) == (2, 2)


def test_calibration_bins_follow_quantile_cuts(spark):
    rng = np.random.default_rng(3)
    p = np.round(rng.random(400), 2)
    df = spark.createDataFrame(pd.DataFrame({"model": "m", "test_year": 1, "predicted_probability": p, "observed": (rng.random(400) < p).astype(int)}))
    got = {r["calibration_bin"]: r["n"] for r in evaluate.calibration(df).collect()}
    want = pd.Series(pd.qcut(p, 10, labels=False, duplicates="drop")).value_counts().to_dict()
    assert got == want


def _newton(x, y, penalty=0.0):
    b, free = np.zeros(x.shape[1]), np.array([0.0] + [penalty] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ b))
        b = b + np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(free), x.T @ (y - p) - free * b)
    return b


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(1)
    x = np.column_stack([np.ones(600), rng.normal(size=(600, 2))])
    y = (rng.random(600) < 1 / (1 + np.exp(-x @ [-0.5, 1.0, -0.7]))).astype(int)
    data = pd.DataFrame(x, columns=["one", "u", "v"]).assign(active=y, a=rng.integers(0, 40, 600).astype(str), b=rng.integers(0, 25, 600).astype(str))
    return data, spark.createDataFrame(data)


def test_binomial_and_cluster_covariance(regression):
    data, df = regression
    x, y = data[["one", "u", "v"]].to_numpy(), data["active"].to_numpy()
    fit = models.binomial(df, ["one", "u", "v"])
    assert fit.beta == pytest.approx(_newton(x, y), abs=1e-8)
    p = 1 / (1 + np.exp(-x @ fit.beta))
    score, bread = (y - p)[:, None] * x, np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x)

    def one(codes):
        s = pd.DataFrame(score).groupby(codes).sum().to_numpy()
        g = len(s)
        return g / (g - 1) * 599 / 597 * bread @ s.T @ s @ bread

    want = one(data["a"].to_numpy()) + one(data["b"].to_numpy()) - one((data["a"] + "|" + data["b"]).to_numpy())
    assert models.two_way_covariance(df, fit, "a", "b") == (40, 25)
    assert fit.covariance == pytest.approx(want, abs=1e-10)
    w, k, tail = models.joint_test(fit, ["u", "v"])
    assert k == 2 and tail == pytest.approx(math.exp(-w / 2))
    (effect, gradient), = models.marginal_effects(df, fit, {"all": {}}, "u").values()
    moved = x + [0, 1, 0]
    q = 1 / (1 + np.exp(-moved @ fit.beta))
    assert effect == pytest.approx((q - p).mean())
    assert gradient == pytest.approx(((q * (1 - q))[:, None] * moved - (p * (1 - p))[:, None] * x).mean(0))


def gathered_mixed_fit(data, terms, prior_log_sd=0.5, prior_fixed=2.0):
    """The same bound by another optimiser: all rows and all units' numbers at once, by quasi-Newton steps. Means and deviations, and the bound."""
    x, y = data[terms].to_numpy(float), data["active"].to_numpy(float)
    names, group = np.unique(data["su_id"].to_numpy(), return_inverse=True)
    k, m = len(terms), len(names)
    varied = x.std(0) > 1e-8
    scale = np.where(varied, x.std(0), 1.0)
    xs = (x - np.where(varied, x.mean(0), 0.0)) / scale
    nodes, weights = np.polynomial.hermite_e.hermegauss(15)
    weights = weights / weights.sum()

    def bound(theta):
        b, s, u = theta[:k], theta[k], theta[k + 1 : k + 1 + m]
        lb, ls, lu = theta[k + 1 + m : 2 * k + 1 + m], theta[2 * k + 1 + m], theta[2 * k + 2 + m :]
        vb, vs, vu = np.exp(2 * lb), math.exp(2 * ls), np.exp(2 * lu)
        mean, var = xs @ b + u[group], (xs * xs) @ vb + vu[group]
        eta = mean[:, None] + np.sqrt(var)[:, None] * nodes
        p = 0.5 * (1 + np.tanh(0.5 * eta))
        d_mean, d_var = y - p @ weights, -(p @ (weights * nodes)) / (2 * np.sqrt(var))
        shrink, square = math.exp(-2 * s + 2 * vs), u * u + vu
        value = float(y @ mean - (np.logaddexp(0, eta) @ weights).sum()) + float(-0.5 * (b * b + vb).sum() / prior_fixed**2 - 0.5 * (s * s + vs) / prior_log_sd**2 - m * s - 0.5 * shrink * square.sum() + lb.sum() + ls + lu.sum())
        parts = [xs.T @ d_mean - b / prior_fixed**2, [-s / prior_log_sd**2 - m + shrink * square.sum()], np.bincount(group, d_mean, m) - shrink * u]
        parts += [((xs * xs).T @ d_var) * 2 * vb - vb / prior_fixed**2 + 1, [-vs / prior_log_sd**2 - 2 * vs * shrink * square.sum() + 1], np.bincount(group, d_var, m) * 2 * vu + 1 - shrink * vu]
        return value, np.concatenate(parts)

    theta = np.concatenate([np.zeros(k), [-0.5], np.zeros(m), np.full(k, -1.0), [-1.0], np.full(m, -0.5)])
    (value, gradient), pairs = bound(theta), []
    for _ in range(3000):
        if np.abs(gradient).max() < 1e-6:
            break
        direction, kept = gradient.copy(), []
        for a, c in reversed(pairs):
            kept.append((a @ direction) / (a @ c))
            direction -= kept[-1] * c
        direction *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1.0, np.abs(gradient).max())
        for (a, c), f in zip(pairs, reversed(kept), strict=True):
            direction += a * (f - (c @ direction) / (a @ c))
        size = 1.0
        while size > 1e-12 and not (moved := bound(theta + size * direction))[0] >= value + 1e-4 * size * (gradient @ direction):
            size /= 2
        a, c = size * direction, gradient - moved[1]
        if a @ c > 1e-12:
            pairs = [*pairs[-19:], (a, c)]
        theta, (value, gradient) = theta + a, moved
    return theta[:k] / scale, np.exp(theta[k + 1 + m : 2 * k + 1 + m]) / scale, math.exp(theta[k]), value


@pytest.mark.parametrize("chunk", [40_000, 50])
def test_mixed_model_is_that_of_another_optimiser(spark, monkeypatch, chunk):
    """Units of 1 to 24 rows, a rare outcome, marks and an intercept: same means, deviations and bound; and what was put in is found."""
    monkeypatch.setattr(mixed, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(2)
    unit = np.repeat(np.arange(200), rng.integers(1, 25, 200))
    x, u = rng.normal(size=len(unit)), rng.normal(0, 0.8, 200)
    mark = (rng.random(len(unit)) < 0.2).astype(float)
    y = (rng.random(len(unit)) < 1 / (1 + np.exp(-(-1.4 + 0.9 * x - 0.7 * mark + u[unit])))).astype(int)
    data = pd.DataFrame({"su_id": unit.astype(str), "one": 1.0, "x": x, "mark": mark, "active": y})
    fit = mixed.variational_mixed_logit(spark.createDataFrame(data).repartition(3), ["one", "x", "mark"])
    means, deviations, sd, value = gathered_mixed_fit(data, ["one", "x", "mark"])
    assert fit["success"] and fit["units"] == 200 and fit["rows"] == len(unit) and fit["iterations"] < 30
    assert fit["log_odds_mean"] == pytest.approx(means, abs=1e-5) and fit["posterior_sd"] == pytest.approx(deviations, abs=1e-5)
    assert fit["random_sd"] == pytest.approx(sd, abs=1e-4) and fit["bound"] == pytest.approx(value, abs=1e-5)
    assert fit["log_odds_mean"][1] == pytest.approx(0.9, abs=0.25) and 0.4 < fit["random_sd"] < 1.3


def test_mixed_model_of_odd_panels(spark):
    """A constant column, units that are all active or all inactive, and too many rows of one unit."""
    data = pd.DataFrame({"su_id": ["a"] * 6 + ["b"] * 6 + ["c"], "one": 1.0, "flat": 3.0, "x": [*range(6), *range(6), 2.0], "active": [1] * 6 + [0] * 6 + [1]})
    fit = mixed.variational_mixed_logit(spark.createDataFrame(data), ["one", "flat", "x"])
    means, _, _, value = gathered_mixed_fit(data, ["one", "flat", "x"])
    assert fit["success"] and fit["log_odds_mean"] == pytest.approx(means, abs=1e-4) and fit["bound"] == pytest.approx(value, abs=1e-5)


def test_contract(spark, tmp_path):
    df = contract.canonicalise(spark.createDataFrame([(" a\t", "2001", "x")], "SUID string, year_original string, lithology string"), ("su_id", "year", "parent_material"))
    assert tuple(df.first()) == ("a", 2001, "x") and df.columns == ["su_id", "year", "parent_material"]
    assert contract.resolved(["Cat", "n_shallow", "shallow_landslide_count", "SHALLOW_COUNT"], ["su_id", "shallow_count", "year"]) == {"su_id": "Cat", "shallow_count": "SHALLOW_COUNT"}
    both = contract.canonicalise(spark.createDataFrame([("u", "code", "name")], "su_id string, parent_material_code string, parent_material string"), ("su_id", "parent_material"))
    assert both.first()["parent_material"] == "code"
    with pytest.raises(contract.ContractError, match="year.*weight"):
        contract.canonicalise(df.drop("year"), ("su_id", "year", "weight"))
    with pytest.raises(Exception, match="null su_id"):
        contract.canonicalise(spark.createDataFrame([(None,)], "su_id string")).collect()
    twice = spark.createDataFrame([("a",), ("a",)], "su_id string")
    with pytest.raises(contract.ContractError, match="su_id=a"):
        contract.keyed(twice, ["su_id"], "twice")
    with pytest.raises(contract.ContractError):
        contract.checked_join(df, twice, ["su_id"])
    with pytest.raises(contract.ContractError):
        contract.checked_join(twice, df, ["su_id"], one_to_one=True)
    with pytest.raises(contract.ContractError):
        contract.assert_passed(contract.contract_checks(df, {"weight": ("weight",)}, "t"))
    (tmp_path / "a.csv").write_text("x")
    assert contract.one_of(spark, str(tmp_path), ["a.csv", "b.csv"]).endswith("/a.csv")
    (tmp_path / "b.csv").write_text("x")
    with pytest.raises(contract.ContractError):
        contract.one_of(spark, str(tmp_path), ["a.csv", "b.csv"])


def test_input_checks(spark):
    failed = lambda df, kind, terrain=(): {r["check"] for r in contract.input_checks(df, kind, "t", terrain).collect() if not r["passed"]}
    events = spark.createDataFrame([("a", 2000, " Shallow", 1.0, 2.0), ("b", 2001, "deep", None, 2.0)], "su_id string, event_year int, type string, x_m double, y_m double")
    assert failed(events, "events") == {"rows without geometry"}
    assert failed(events.where("su_id = 'b'").drop("x_m"), "events") == {"has points", "shallow events"}
    rain = spark.createDataFrame([("a", 1, 1.0), ("a", 1, 2.0), (None, 2, 1.0)], "su_id string, year int, Rx1day double")
    assert failed(rain, "rainfall") == {"units without a name", "repeated su_id year", *[f"has {c}" for c in contract.RAINFALL if c != "rx1day_mm"]}
    terrain = spark.createDataFrame([("a", 1.0)], "su_id string, relief_m double")
    assert failed(terrain, "terrain", ["relief_m"]) == set() and failed(terrain, "terrain", ["twi_median"]) == {"has twi_median"}
    units = spark.createDataFrame([("a", "Point", 1.0, 1.0, 0)], "su_id string, geometry_type string, x_m double, y_m double, srs_id int")
    assert failed(units, "slope_units") == {"rows that are no polygons", "rows without a spatial reference"}
    assert failed(spark.createDataFrame([], "su_id string, year int"), "response") == {"has rows"}


def test_table_comparison(spark):
    a = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, v double")
    b = spark.createDataFrame([(1, 1.0 + 1e-9), (3, 2.0)], "k int, v double")
    got = {r["check"]: r["detail"] for r in audit.compare_tables(a, b, ["k"]).collect()}
    assert (got["only_left"], got["only_right"], got["values:v"]) == ("1", "1", "0")


def test_margins(spark):
    a = spark.createDataFrame([("u", 1), ("v", 2)], "su_id string, year int")
    b = spark.createDataFrame([("u", 2), ("v", 1)], "su_id string, year int")
    c = spark.createDataFrame([("u", 1), ("u", 2)], "su_id string, year int")
    assert [r["differing"] for r in audit.margins_kept(a, b).collect()] == [0, 0]
    assert {r["margin"]: r["differing"] for r in audit.margins_kept(a, c).collect()} == {"su_id": 2, "year": 0}


def test_geopackage(spark, tmp_path):
    import sqlite3
    import struct

    head = b"GP\0\x01" + struct.pack("<i", 32644)
    ring = lambda *p: struct.pack(f"<I{2 * len(p)}d", len(p), *[x for q in p for x in q])
    point = head + struct.pack("<BIdd", 1, 1, 3.0, 4.0)
    polygon = head + struct.pack("<BII", 1, 3, 2) + ring((0, 0), (6, 0), (6, 6), (0, 6), (0, 0)) + ring((1, 1), (5, 1), (5, 5), (1, 5), (1, 1))
    path = tmp_path / "x.gpkg"
    db = sqlite3.connect(path)
    db.executescript("CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id); INSERT INTO gpkg_geometry_columns VALUES ('e', 'geom', 32644); CREATE TABLE e (su_id, geom)")
    db.executemany("INSERT INTO e VALUES (?, ?)", [("a", point), ("b", polygon), ("c", None)])
    db.commit()
    db.close()
    got = {r["su_id"]: r for r in geopackage.read_geopackage(spark, str(path)).collect()}
    assert (got["a"]["x_m"], got["a"]["y_m"], got["a"]["geometry_type"], got["a"]["srs_id"]) == (3.0, 4.0, "Point", 32644)
    assert got["b"]["su_area_m2"] == 20 and got["b"]["geometry_type"] == "Polygon" and got["b"]["x_m"] in (0.5, 5.5) and 0 < got["b"]["y_m"] < 6
    assert (got["c"]["x_m"], got["c"]["su_area_m2"]) == (None, None)


def test_projection_is_the_conformal_one_with_true_meridian():
    """Two things make it: lengths on the meridian (by quadrature), and equal scales in all directions; besides, a published point."""
    zone = projection.system("EPSG:32644")
    f = 1 / projection.INVERSE_FLATTENING
    e2 = f * (2 - f)
    curved = lambda lat: projection.AXIS * (1 - e2) / (1 - e2 * np.sin(lat) ** 2) ** 1.5
    for lat in (-60.0, 0.0, 29.3, 75.0):
        grid = np.linspace(0, math.radians(lat), 200_001)
        arc = float(np.sum((curved(grid[1:]) + curved(grid[:-1])) / 2 * np.diff(grid)))
        assert zone.forward(np.array([81.0]), np.array([lat])) == (pytest.approx(500_000), pytest.approx(0.9996 * arc, abs=1e-4))
    h = 1e-5
    for lon, lat in ((81.5, 29.0), (84.0, -40.0), (78.2, 60.0)):
        at = lambda a, b: np.array(zone.forward(np.array([a]), np.array([b])))[:, 0]
        east = (at(lon + h, lat) - at(lon - h, lat)) / (2 * math.radians(h) * projection.AXIS / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2) * math.cos(math.radians(lat)))
        north = (at(lon, lat + h) - at(lon, lat - h)) / (2 * math.radians(h) * curved(math.radians(lat)))
        assert east[0] == pytest.approx(north[1], abs=1e-7) and east[1] == pytest.approx(-north[0], abs=1e-7)
    published = projection.TransverseMercator(-75, east=0.0, axis=6378206.4, inverse_flattening=294.9786982)
    assert published.forward(np.array([-73.5]), np.array([40.5])) == (pytest.approx(127_106.5, abs=0.06), pytest.approx(4_484_124.4, abs=0.06))


def test_reprojection_of_columns(spark):
    """Degrees to metres and back, from zone to zone and from web maps, to a tenth of a millimetre; what isn't metres is refused."""
    rng = np.random.default_rng(2)
    lon, lat = rng.uniform(78, 84, 50), rng.uniform(-80, 80, 50)
    x, y = projection.system(32644).forward(lon, lat)
    web = (np.radians(lon) * projection.AXIS, np.log(np.tan(np.pi / 4 + np.radians(lat) / 2)) * projection.AXIS)
    other = projection.system(32744).forward(lon, lat)
    for source, a, b in ((4326, lon, lat), (3857, *web), (32744, *other), ("epsg:32644", x, y)):
        df = spark.createDataFrame(pd.DataFrame({"a": a, "b": b, "x": x, "y": y}))
        for r in projection.reprojected(df, "a", "b", source, "EPSG:32644").collect():
            assert (r["x_m"], r["y_m"]) == (pytest.approx(r["x"], abs=1e-4), pytest.approx(r["y"], abs=1e-4))
    with pytest.raises(ValueError, match="aren't metres"):
        projection.reprojected(df, "a", "b", 32644, 4326)
    with pytest.raises(ValueError, match="no rule"):
        projection.system(2154)


def test_geopackages_in_degrees(spark, tmp_path):
    import sqlite3
    import struct

    def package(name, srs):
        square = [(81.0, 29.0), (81.001, 29.0), (81.001, 29.001), (81.0, 29.001), (81.0, 29.0)]
        head = b"GP\0\x01" + struct.pack("<i", srs)
        shapes = [("p", head + struct.pack("<BIdd", 1, 1, 81.5, 29.25)), ("a", head + struct.pack("<BIII", 1, 3, 1, 5) + struct.pack("<10d", *[v for p in square for v in p])), ("n", None)]
        db = sqlite3.connect(tmp_path / name)
        db.executescript(f"CREATE TABLE gpkg_geometry_columns (table_name, column_name, srs_id); INSERT INTO gpkg_geometry_columns VALUES ('e', 'geom', {srs}); CREATE TABLE e (su_id, geom); CREATE TABLE gpkg_spatial_ref_sys (srs_id, organization, organization_coordsys_id); INSERT INTO gpkg_spatial_ref_sys VALUES (4326, 'EPSG', 4326), (77, 'epsg', 4326)")
        db.executemany("INSERT INTO e VALUES (?, ?)", shapes)
        db.commit()
        db.close()
        return str(tmp_path / name)

    zone = projection.system(32644)
    for srs in (4326, 77):
        got = {r["su_id"]: r for r in contract.read_table(spark, package(f"{srs}.gpkg", srs), crs="EPSG:32644").collect()}
        east, north = (float(v[0]) for v in zone.forward(np.array([81.5]), np.array([29.25])))
        assert (got["p"]["x_m"], got["p"]["y_m"]) == (pytest.approx(east, abs=1e-6), pytest.approx(north, abs=1e-6))
        # a thousandth of a degree each way, at the scale of the meridian squared
        assert got["a"]["su_area_m2"] == pytest.approx(97.417 * 110.854 * 0.9996**2, rel=1e-3) and got["n"]["x_m"] is None
    with pytest.raises(ValueError, match="in degrees"):
        geopackage.read_geopackage(spark, package("d.gpkg", 4326))
    with pytest.raises(ValueError, match="no reference system"):
        geopackage.read_geopackage(spark, package("u.gpkg", 0), crs=32644)
    (tmp_path / "e.csv").write_text("su_id,year,lon,lat\nu,2000,81.5,29.25\n")
    row = contract.read_table(spark, str(tmp_path / "e.csv"), ("su_id", "year"), crs=32644).first()
    assert (row["x_m"], row["y_m"]) == (pytest.approx(east, abs=1e-5), pytest.approx(north, abs=1e-5))
    with pytest.raises(contract.ContractError, match="degrees"):
        contract.read_table(spark, str(tmp_path / "e.csv"))


def test_a_panel_without_response_needs_events(spark):
    panel = spark.createDataFrame([("u", 2000)], "su_id string, year int")
    held = lambda df, **more: next(r["passed"] for r in contract.input_checks(df, "response", "panel", **more).collect() if r["check"] == "response or events")
    assert not held(panel) and held(panel, has_events=True) and held(panel.withColumn("active", F.lit(1)))


def test_folds_share_one_design(spark):
    """The shared columns times a fold's matrix are the fold's own design; coefficients are those of fits of each fold by itself."""
    rng = np.random.default_rng(12)
    n = 400
    data = pd.DataFrame({"su_id": [f"u{i}" for i in range(n)], "year": rng.integers(2000, 2006, n), "x": rng.normal(3000, 200, n), "z": rng.normal(size=n), "m": rng.choice(["a", "b", "c", "d"], n, p=[0.5, 0.3, 0.15, 0.05]), "rainfall_source_year": 1999})
    data.loc[data["year"] < 2002, "m"] = data["m"].replace("d", "b")
    data["active"] = (rng.random(n) < 1 / (1 + np.exp(-(data["z"] + (data["x"] - 3000) / 200 * 0.5 + (data["m"] == "c") - 1)))).astype(int)
    data.loc[rng.choice(n, 40, False), "x"] = np.nan
    data.loc[rng.choice(n, 30, False), "m"] = None
    frame = spark.createDataFrame(data.astype({"m": object}).where(data.notna(), None), "su_id string, year int, x double, z double, m string, rainfall_source_year int, active int")
    sets = {"P0": ["x"], "P1": ["x", "z"]}
    made, levels = forward.folds(frame, [2003, 2005], ["x", "z"], "m")
    shared = forward.Shared(made[2005].mean, made[2005].sd, len(levels))
    numbers, codes = data[["x", "z"]].to_numpy(), np.array([levels.index(v) if isinstance(v, str) else -1 for v in data["m"]])
    for fold in made.values():
        assert shared.columns(numbers, codes) @ shared.matrix(fold) == pytest.approx(fold.design(numbers, codes), abs=1e-12)
    beta = forward.fit(frame, made, levels, sets, ["x", "z"], "m", "year", "active", c=0.7)
    for (name, t), found in beta.items():
        own = (data["year"] < t).to_numpy()
        at = [0, *[1 + ["x", "z"].index(v) for v in sets[name]], *range(3, 3 + len(made[t].seen))]
        x, y = made[t].design(numbers[own], codes[own])[:, at], data["active"].to_numpy()[own]
        b, penalty = np.zeros(x.shape[1]), np.diag([0.0, *[1 / 0.7] * (x.shape[1] - 1)])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ b))
            b += np.linalg.pinv((x * (p * (1 - p))[:, None]).T @ x + penalty) @ (x.T @ (y - p) - penalty @ b)
        assert found == pytest.approx(b, abs=1e-8)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(2, "x"), (1, None)], "a int, b string").orderBy("a")
    sinks.write_table(df, str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_text().splitlines() == ["a,b", "1,", "2,x"]
    sinks.write_table(df.limit(0), str(tmp_path / "t.csv"))
    assert (tmp_path / "t.csv").read_text().splitlines() == ["a,b"]
    (tmp_path / "x").write_text("abc")
    found = sinks.file_hashes(spark, [str(tmp_path / "x")])
    assert list(found.values()) == ["ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"] == [sinks.local_hash(tmp_path / "x")]
    sinks.write_json(spark, str(tmp_path / "m.json"), sinks.manifest(spark, "s", "complete", found, {}, {}))
    assert '"status": "complete"' in (tmp_path / "m.json").read_text()


def _panel(seed, n=900):
    """A rainfall frame, as base of the models would be made from, and rainfall of all years."""
    rng = np.random.default_rng(seed)
    units, years = [f"u{i}" for i in range(90)], range(1995, 2005)
    rain = pd.DataFrame([(u, y, rng.gamma(2.0)) for u in units for y in years], columns=["su_id", "year", "rx7day_mm"])
    frame = rain.sample(n, random_state=1).query("year >= 1998").copy()
    k = len(frame)
    frame["gap_shallow_category"] = rng.choice(["1_year", "2_years", "3_5_years", "6_10_years", "gt10_years"], k)
    place = frame["su_id"].str[1:].astype(int)
    frame = frame.assign(relief_m=place * 1.0, log_su_area=np.sin(place), parent_material=np.array(["UF1", "UF2", "GN"])[place % 3], grid_id=(place % 9).astype(str))
    frame = frame.assign(prior_shallow_failure=1, shallow_history_crosses_missing_gap=0, prior_shallow_active_years_log1p=np.log1p(rng.integers(1, 6, k)))
    eta = -0.8 + np.where(frame["gap_shallow_category"] == "1_year", 0.7, 0.1) * (frame["rx7day_mm"] - 2)
    frame["shallow_active"] = (rng.random(k) < 1 / (1 + np.exp(-eta))).astype(int)
    frame.loc[frame.index[0], "relief_m"] = None
    return frame, rain


def test_rainfall_design_makes_its_rows_once(spark):
    """Levels and later users read complete cases that were written; they are not joined again for each."""
    frame, rain = _panel(4)
    base, _ = effects.rainfall_base(spark.createDataFrame(frame), ["relief_m"], {}, [])
    made = spark.sparkContext.accumulator(0)

    @F.udf("int")
    def counted(x):
        made.add(1)
        return x

    own, _, terms, gaps = effects.rainfall_design(base.withColumn("shallow_active", counted("shallow_active")), spark.createDataFrame(rain), "rx7day_mm", ["relief_m"], "gt10_years")
    assert own.count() == len(frame) - 1 and len(gaps) == 4 and own.agg(F.sum("shallow_active")).first()[0] == frame["shallow_active"][1:].sum()
    assert made.value == len(frame)


def test_rainfall_models_leave_no_complete_cases(spark):
    frame, rain = _panel(4)
    base, _ = effects.rainfall_base(spark.createDataFrame(frame), ["relief_m"], {}, [])
    left = lambda: {p for p in os.listdir(spark.conf.get("spark.checkpoint.dir")) if p.startswith("rainfall-complete")}
    before = left()
    tables, _ = effects.rainfall_effects(base, spark.createDataFrame(rain), {7: "rx7day_mm"}, ["relief_m"])
    assert left() == before and tables["missingness"].count() > 0


def test_base_of_the_rainfall_models_rests_on_its_own_table(spark, sf):
    from chronopanel.plans import catalog

    base, _ = catalog._rain_frame(spark, sf)
    assert base.inputFiles() and all("rainfall-risk" in p for p in base.inputFiles())


def test_rainfall_models_are_those_of_the_formula(spark):
    """Coefficients, covariance, effects and contrasts from NumPy, by the formula term by term."""
    frame, rain = _panel(4)
    static = ["relief_m", "log_su_area"]
    base, audit_rows = effects.rainfall_base(spark.createDataFrame(frame), static, {"UF1": "UF", "UF2": "UF"}, [])
    assert {r["stage"]: r["rows"] for r in audit_rows.collect()} == {"before_parent_material_exclusion": len(frame), "after_parent_material_exclusion": len(frame)}
    tables, records = effects.rainfall_effects(base, spark.createDataFrame(rain), {7: "rx7day_mm"}, static, sample=None)
    z = lambda v: (v - v.mean()) / v.std(ddof=1)
    unit = rain.groupby("su_id")["rx7day_mm"].agg(["mean", "std"])
    d = frame.copy()
    d["rx"] = (d["rx7day_mm"] - d["su_id"].map(unit["mean"])) / d["su_id"].map(unit["std"])
    own = unit.loc[d["su_id"].unique(), "mean"]
    d["between"] = (d["su_id"].map(unit["mean"]) - own.mean()) / own.std(ddof=1)
    for c in ("prior_shallow_active_years_log1p", *static):
        d[f"{c}_z"] = z(d[c])
    d = d.dropna()
    d["material"] = d["parent_material"].replace({"UF1": "UF", "UF2": "UF"})
    gaps = ["1_year", "2_years", "3_5_years", "6_10_years"]
    years = sorted(d["year"].unique())[1:]

    def design(d, state=None, more=0.0):
        rx = d["rx"] + more
        mark = [((d["gap_shallow_category"] == g) if state is None else pd.Series(state == g, d.index)).astype(float) for g in gaps]
        return np.column_stack([np.ones(len(d)), *mark, (d["material"] == "UF").astype(float), *[(d["year"] == y).astype(float) for y in years], rx, *[rx * m for m in mark], d["between"], d["prior_shallow_active_years_log1p_z"], d["relief_m_z"], d["log_su_area_z"]])

    x, y = design(d), d["shallow_active"].to_numpy()
    beta = _newton(x, y)
    p = 1 / (1 + np.exp(-x @ beta))
    bread, score = np.linalg.inv((x * (p * (1 - p))[:, None]).T @ x), (y - p)[:, None] * x
    n, k = x.shape

    def meat(codes):
        s = pd.DataFrame(score).groupby(codes.to_numpy()).sum().to_numpy()
        return len(s) / (len(s) - 1) * (n - 1) / (n - k) * bread @ s.T @ s @ bread

    cell = d["grid_id"] + "__" + d["year"].astype(str)
    v = meat(d["su_id"]) + meat(cell) - meat(d["su_id"] + "|" + cell)
    got = tables["coefficients"].toPandas()
    assert got["term"].tolist() == ["Intercept", *[f"gap={g}" for g in gaps], "material=UF", *[f"year={y}" for y in years], "rx_z", *[f"rx_z:gap={g}" for g in gaps], "rx_between_z", "prior_shallow_active_years_z", "relief_m_z", "log_su_area_z"]
    assert got["estimate"].to_numpy() == pytest.approx(beta, abs=1e-7)
    assert got["se_two_way_cluster"].to_numpy() == pytest.approx(np.sqrt(np.maximum(np.diag(v), 0)), rel=1e-5)
    q = lambda s, more: 1 / (1 + np.exp(-design(d, s, more) @ beta))
    want = {s: (q(s, 1.0) - q(s, 0.0)).mean() for s in [*gaps, "gt10_years"]}
    grad = {s: ((q(s, 1.0) * (1 - q(s, 1.0)))[:, None] * design(d, s, 1.0) - (q(s, 0.0) * (1 - q(s, 0.0)))[:, None] * design(d, s)).mean(0) for s in want}
    assert {r["history_state"]: r["AME_probability"] for r in tables["effects"].collect()} == pytest.approx(want, abs=1e-8)
    for r in tables["contrasts"].collect():
        g = grad[r["history_state"]] - grad["gt10_years"]
        assert r["AME_contrast_probability"] == pytest.approx(want[r["history_state"]] - want["gt10_years"], abs=1e-8) and r["SE_contrast_two_way"] == pytest.approx(np.sqrt(g @ v @ g), rel=1e-5)
    at = [got["term"].tolist().index(f"rx_z:gap={g}") for g in gaps]
    w = beta[at] @ np.linalg.pinv(v[np.ix_(at, at)]) @ beta[at]
    joint = tables["joint_tests"].first()
    assert (joint["df"], joint["n_rows"], joint["n_SU_clusters"]) == (4, n, d["su_id"].nunique()) and joint["joint_interaction_wald_two_way"] == pytest.approx(w, rel=1e-4)
    assert {r["variable"]: r["missing_rows"] for r in tables["missingness"].collect()}["relief_m_z"] == 1
    multiplicity = tables["multiplicity"].collect()
    assert len(multiplicity) == 5 and all(r["p_holm"] >= r["p_pointwise"] for r in multiplicity) and records[0]["n_rows"] == n
    few, records = effects.rainfall_effects(base, spark.createDataFrame(rain), {7: "rx7day_mm"}, static, sample=50)
    assert records[0]["n_standardization_rows"] == 50 and few["effects"].first()["n_standardized"] == 50


def test_materials_can_be_left_out(spark):
    frame, _ = _panel(4)
    base, counts = effects.rainfall_base(spark.createDataFrame(frame), ["log_su_area"], {"UF1": "UF"}, ["UF", "UF2"])
    rows = {r["stage"]: r["rows"] for r in counts.collect()}
    assert rows["after_parent_material_exclusion"] == base.count() == (frame["parent_material"] == "GN").sum() < rows["before_parent_material_exclusion"]
    with pytest.raises(ValueError, match="twi_median"):
        effects.rainfall_base(spark.createDataFrame(frame), ["twi_median"], {}, [])


def test_recurrence_model(spark):
    rng = np.random.default_rng(7)
    n = 600
    gap = rng.choice(["1_year", "6_10_years", "gt10_years"], n)
    x = rng.normal(size=n)
    eta = -1 + 1.2 * (gap == "1_year") + 0.5 * x
    data = pd.DataFrame({"su_id": rng.integers(0, 60, n).astype(str), "year": rng.integers(2000, 2003, n), "gap_time_category": gap, "prior_active_years_z": x, "monsoon_z": rng.normal(size=n), "active": (rng.random(n) < 1 / (1 + np.exp(-eta))).astype(int)})
    tables, record = effects.recurrence_model(spark.createDataFrame(data), seed=1)
    got = {r["term"]: r for r in tables["coefficients"].collect()}
    assert set(got) == {"Intercept", "gap:T.1_year", "gap:T.6_10_years", "year:T.2001", "year:T.2002", "prior_active_years_z", "monsoon_z"}
    assert got["gap:T.1_year"]["log_odds_mean"] == pytest.approx(1.2, abs=0.5) and got["prior_active_years_z"]["interval_low"] > 1
    assert {r["display_term"] for r in tables["focal"].collect()} == {"1 year vs >10 years", "6–10 years vs >10 years", effects.BURDEN_LABEL, effects.MONSOON_LABEL}
    assert record["success"] and record["rows"] == n and sum(r["n"] for r in tables["support"].collect()) == n


def _folds(seed=5, n=400):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=n)
    data = pd.DataFrame({"su_id": np.arange(n).astype(str), "year": rng.integers(2000, 2004, n), "x": x, "z": rng.normal(size=n), "m": rng.choice(["a", "b"], n), "active": (rng.random(n) < 1 / (1 + np.exp(-2 * x))).astype(int)})
    data["rainfall_source_year"] = data["year"] - 1
    data.loc[5, "x"], data.loc[6, "m"], data.loc[7, "z"] = None, None, float("nan")
    data.loc[data["year"] == 2003, "m"] = data.loc[data["year"] == 2003, "m"].replace({"b": "new"})
    return data


def test_forward_predictions_are_those_of_each_fold(spark):
    """Against NumPy, fold by fold: imputed and scaled by the training years, levels of training only."""
    data, sets = _folds(), {"P0": ["x"], "P1": ["x", "z"]}
    made = forward.forward_predictions(spark.createDataFrame(data), [2002, 2003], sets, "m", first_year=2001)
    got = {(r["model"], r["test_year"], r["su_id"]): r["predicted_probability"] for r in made["predictions"].collect()}
    named = {(r["model"], r["test_year"], r["feature"]): r["coefficient"] for r in made["coefficients"].collect()}
    for t in (2002, 2003):
        train, test = data[(data["year"] < t) & (data["year"] >= 2001)], data[data["year"] == t]
        frequent = sorted(train["m"].dropna().value_counts().items(), key=lambda x: (-x[1], x[0]))[0][0]
        levels = sorted(train["m"].dropna().unique())

        def design(d, names, train=train, frequent=frequent, levels=levels):
            columns = [np.ones(len(d))]
            for c in names:
                filled = train[c].fillna(train[c].median())
                columns.append((d[c].fillna(train[c].median()) - filled.mean()) / filled.std(ddof=0))
            return np.column_stack([*columns, *[(d["m"].fillna(frequent) == x).astype(float) for x in levels]])

        for model, names in sets.items():
            beta = _newton(design(train, names), train["active"].to_numpy(), 1.0)
            assert named[model, t, "intercept"] == pytest.approx(beta[0], abs=1e-7) and named[model, t, "numeric__x"] == pytest.approx(beta[1], abs=1e-7)
            want = 1 / (1 + np.exp(-design(test, names) @ beta))
            assert [got[model, t, i] for i in test["su_id"]] == pytest.approx(want, abs=1e-7)
    assert len(got) == 2 * (data["year"] >= 2002).sum() and (("P0", 2003, "categorical__m_b") in named) and (("P0", 2003, "categorical__m_new") not in named)


def test_forward_predictions_see_only_the_past(spark):
    data = _folds()
    run = lambda d: forward.forward_predictions(spark.createDataFrame(d), [2002], {"P0": ["x"], "P1": ["x", "z"]}, "m")["predictions"].orderBy("model", "su_id").collect()
    first = run(data)
    again = run(data.assign(active=np.where(data["year"] > 2002, 1 - data["active"], data["active"]), x=np.where(data["year"] > 2002, 99.0, data["x"])))
    assert first == again and {r["max_training_year"] for r in first} == {2001} and {r["model"] for r in first} == {"P0", "P1"}
    with pytest.raises(ValueError, match="missing predictors: q"):
        forward.forward_predictions(spark.createDataFrame(data), [2002], {"P0": ["q"]}, "m")
    with pytest.raises(ValueError, match="before 2000"):
        forward.forward_predictions(spark.createDataFrame(data), [2000], {"P0": ["x"]}, "m")


def test_calibration_lines(spark):
    rng = np.random.default_rng(9)
    p = rng.uniform(0.05, 0.95, 500)
    data = pd.DataFrame({"model": np.where(np.arange(500) % 2, "a", "b"), "predicted_probability": p, "observed": (rng.random(500) < p**1.5).astype(int)})
    data = pd.concat([data, pd.DataFrame({"model": "flat", "predicted_probability": 0.5, "observed": [0, 1]})])
    got = {r["model"]: (r["calibration_intercept"], r["calibration_slope"]) for r in models.calibration_lines(spark.createDataFrame(data), ["model"]).collect()}
    for m in "ab":
        own = data[data["model"] == m]
        x = np.column_stack([np.ones(len(own)), np.log(own["predicted_probability"] / (1 - own["predicted_probability"]))])
        assert got[m] == pytest.approx(tuple(_newton(x, own["observed"].to_numpy())), abs=1e-7)
    assert got["flat"] == (None, None)


def test_leaks_are_found(spark):
    rows = spark.createDataFrame([(2001, 2000, 2000), (2002, 2002, None), (2002, 2001, 2002)], "test_year int, max_training_year int, rainfall_source_year int")
    got = [r["passed"] for r in audit.leakage_checks(rows, ["a", "rx10day_mm"], list(contract.RAINFALL)).collect()]
    assert got == [False, True, False, False]
    assert all(r["passed"] for r in audit.leakage_checks(rows.limit(1), ["rx10day_mm_lag1"], list(contract.RAINFALL)).collect())


def test_report_tables(spark):
    wanted = spark.createDataFrame([("a", "a.csv"), ("b", "b.csv")], "item string, file string")
    assert {r["item"]: r["status"] for r in report.supplement_index(wanted, wanted.where("item = 'a'")).collect()} == {"a": "included", "b": "not_generated"}
    t = spark.createDataFrame([("gt10_years", 0.12345), ("1_year", None)], "gap_time_category string, rate double")
    assert [tuple(r) for r in report.presentation(t, "gap_time_category", ["rate"]).collect()] == [("1 year", None), (">10 years", "12.35")]
    results = report.main_results(("x", "rows", spark.createDataFrame([("n", 3)], "metric string, estimate int")))
    assert tuple(results.first()) == ("x", "n", 3.0, None, None, None, "rows")


def test_chi_square_tail_of_odd_degrees():
    from chronopanel.functions.scalar import chi2_tail

    # 5 % points of tables
    for x, df in ((3.841459, 1), (7.814728, 3), (11.070498, 5), (5.991465, 2), (9.487729, 4)):
        assert abs(chi2_tail(x, df) - 0.05) < 1e-6
    assert chi2_tail(0.0, 3) == 1.0


def test_coverage_counts_what_the_first_table_with_a_variable_holds(spark):
    from chronopanel.operators import report

    first = spark.createDataFrame([(1.0, "x"), (float("nan"), None), (None, "y"), (-2.0, "y")], "a double, odd string")
    other = spark.createDataFrame([(5.0, 7)], "a double, b int")
    got = {r["variable"]: tuple(r)[1:] for r in report.coverage([first, other], ["a", "odd", "b", "none"]).collect()}
    assert got == {"a": (4, 2, -2.0, 1.0), "odd": (4, 1, None, None), "b": (1, 0, 7.0, 7.0)}
    assert report.coverage([first.limit(0)], ["a"]).first()[1:] == (0, 0, None, None) and report.coverage([first], ["none"]).count() == 0
