"""Models: penalised and plain logistic fits, cluster-robust covariances, marginal effects.

Sums over rows are taken where the rows are; the driver only sees matrices whose sides are the number of coefficients.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from chronopanel.functions.scalar import Z95, chi2_tail, expit, logit, normal_two_sided

#: Levels that a category may have as terms of a fit.
MOST_LEVELS = 500


def levels_of(frame: DataFrame, *columns: str, most: int = MOST_LEVELS) -> list[list[str]]:
    """The distinct levels of each column in their order, as text. A level is a term of the fit, so more than ``most`` raise."""
    # a level more than may be is enough to know, so no more are gathered
    found = {c: [r[0] for r in frame.select(F.col(c).cast("string")).where(F.col(c).isNotNull()).distinct().limit(most + 1).collect()] for c in columns}
    if many := [c for c in columns if len(found[c]) > most]:
        raise ValueError(f"more than {most} levels in {', '.join(many)}")
    row = {c: sorted(v) for c, v in found.items()}
    return [list(row[c]) for c in columns]


def marks(column: str, levels: list[str], prefix: str) -> dict[str, Column]:
    """0/1 columns for levels; the reference level is the one that isn't listed."""
    return {f"{prefix}{x}": F.coalesce(F.col(column).cast("string") == x, F.lit(False)).cast("double") for x in levels}


@dataclass
class Fit:
    """A binomial fit: terms, coefficients, the inverse information, and covariances added later."""

    terms: list[str]
    beta: np.ndarray
    bread: np.ndarray
    n: int
    iterations: int
    covariance: np.ndarray = field(default_factory=lambda: np.empty(0))


def term(name: str) -> Column:
    """The column of a term, whatever characters its name has."""
    return F.col("`" + name.replace("`", "``") + "`")


def _matrix(batch: pa.RecordBatch, k: int) -> np.ndarray:
    return np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)], 1).astype(float)


def _expit(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _numbers(frame: DataFrame, *columns: str) -> DataFrame:
    return frame.select(*[term(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])


def _summed(rows: DataFrame, part) -> np.ndarray:
    """The sum over partitions of the one vector that ``part`` makes of each one's batches; added up by tasks before the driver adds the last few."""
    def vector(v: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([np.asarray(v).tolist()], pa.list_(pa.float64()))], ["v"])

    def run(batches):
        yield vector(part(batches))

    def add(batches):
        total = None
        for batch in batches:
            for v in batch.column("v").to_pylist():
                total = np.array(v) if total is None else total + v
        if total is not None:
            yield vector(total)

    made = rows.mapInArrow(run, "v array<double>").repartition(8).mapInArrow(add, "v array<double>").collect()
    return np.sum([r["v"] for r in made], axis=0)


def newton_sums(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Gradient, information, deviance and number of rows, as one vector."""
    eta = x @ beta
    p = _expit(eta)
    deviance = 2 * (np.logaddexp(0, eta) - y * eta).sum()
    return np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel(), [deviance, len(y)]])


def newton_step(sums: np.ndarray, beta: np.ndarray, penalty: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float]:
    """The next coefficients, the information at the present ones, and the (penalised) deviance there."""
    k = len(beta)
    gradient, information, deviance = sums[:k], sums[k : k + k * k].reshape(k, k), sums[-2]
    if penalty is not None:
        gradient, information, deviance = gradient - penalty * beta, information + np.diag(penalty), deviance + penalty @ (beta * beta)
    return beta + np.linalg.pinv(information, hermitian=True) @ gradient, information, float(deviance)


def binomial(frame: DataFrame, terms: list[str], label: str = "active", most: int = 100, tolerance: float = 1e-8) -> Fit:
    """Maximum likelihood by Newton steps: a pass over the rows each, of which every partition sends one matrix.

    It ends when the deviance changes by less than the tolerance, so a level whose rows are all alike ends too.
    """
    k = len(terms)
    rows = _numbers(frame, *terms, label).persist()
    beta, before = np.zeros(k), math.inf
    try:
        for i in range(most):
            def part(batches, beta=beta):
                sums = np.zeros(k + k * k + 2)
                for batch in batches:
                    table = _matrix(batch, k + 1)
                    sums += newton_sums(table[:, :k], table[:, k], beta)
                return sums

            sums = _summed(rows, part)
            moved, information, deviance = newton_step(sums, beta)
            if abs(before - deviance) < tolerance + 1e-12 * deviance:
                return Fit(terms, moved, np.linalg.pinv(information, hermitian=True), int(sums[-1]), i)
            beta, before = moved, deviance
    finally:
        rows.unpersist()
    raise ArithmeticError("the fit doesn't converge")


def linear(terms: list[str], beta: np.ndarray) -> Column:
    return reduce(lambda a, b: a + b, [term(t) * float(v) for t, v in zip(terms, beta, strict=True)])


def cluster_meat(frame: DataFrame, fit: Fit, clusters: list[str], label: str = "active") -> tuple[np.ndarray, int]:
    """The sum over clusters of the outer products of their scores, and their number."""
    k = len(fit.terms)
    residual = F.col(label) - expit(linear(fit.terms, fit.beta))
    own = frame.select(*clusters, residual.alias("_r"), *[term(t).cast("double").alias(f"x{i}") for i, t in enumerate(fit.terms)])
    scores = own.groupBy(*clusters).agg(*[F.sum(F.col("_r") * F.col(f"x{i}")).alias(f"x{i}") for i in range(k)]).drop(*clusters)

    def part(batches):
        sums = np.zeros(k * k + 1)
        for batch in batches:
            x = _matrix(batch, k)
            sums[:-1] += (x.T @ x).ravel()
            sums[-1] += len(x)
        return sums

    sums = _summed(scores, part)
    return sums[:-1].reshape(k, k), int(sums[-1])


def two_way_covariance(frame: DataFrame, fit: Fit, first: str, second: str, label: str = "active", correction: bool = True) -> tuple[int, int]:
    """Sets the fit's covariance: inclusion and exclusion over clusters of either kind and of both, each with its small-sample factor. Returns the numbers of clusters."""
    k, out, sizes = len(fit.terms), 0, []
    for clusters, sign in (([first], 1), ([second], 1), ([first, second], -1)):
        meat, g = cluster_meat(frame, fit, clusters, label)
        factor = g / (g - 1) * (fit.n - 1) / (fit.n - k) if correction else 1.0
        out = out + sign * factor * fit.bread @ meat @ fit.bread
        sizes.append(g)
    fit.covariance = out
    return sizes[0], sizes[1]


def joint_test(fit: Fit, terms: list[str]) -> tuple[float, int, float]:
    """Wald statistic, degrees of freedom and p-value that all of these terms are 0."""
    at = [fit.terms.index(t) for t in terms]
    b, v = fit.beta[at], fit.covariance[np.ix_(at, at)]
    w = float(b @ np.linalg.pinv(v) @ b)
    return w, len(at), chi2_tail(w, len(at))


def marginal_effects(frame: DataFrame, fit: Fit, states: dict[str, dict[str, float]], moved: str, step: float = 1.0) -> dict[str, tuple[float, np.ndarray]]:
    """(effect, gradient) of each state: the mean change of the probability when ``moved`` grows by ``step``, all rows set to the state.

    A state gives values to terms; a term ``a:b`` is made anew of a and b. One pass over the rows for all states; every partition sends its sums.
    """
    k, place = len(fit.terms), {t: i for i, t in enumerate(fit.terms)}
    products = [(i, place[a], place[b]) for t, i in place.items() for a, _, b in [t.partition(":")] if a in place and b in place]
    settings = [[(place[t], v) for t, v in state.items()] for state in states.values()]
    beta, at = fit.beta, place[moved]

    def part(batches):
        sums = np.zeros(len(settings) * (k + 1) + 1)
        for batch in batches:
            table = _matrix(batch, k)
            sums[-1] += len(table)
            for i, setting in enumerate(settings):
                for sign, more in ((-1, 0.0), (1, step)):
                    x = table.copy()
                    for j, v in setting:
                        x[:, j] = v
                    x[:, at] += more
                    for j, a, b in products:
                        x[:, j] = x[:, a] * x[:, b]
                    p = _expit(x @ beta)
                    sums[i * (k + 1)] += sign * p.sum()
                    sums[i * (k + 1) + 1 : (i + 1) * (k + 1)] += sign * (p * (1 - p)) @ x
        return sums

    sums = _summed(_numbers(frame, *fit.terms), part)
    means = (sums[:-1] / sums[-1]).reshape(len(settings), k + 1)
    return {name: (float(m[0]), m[1:]) for name, m in zip(states, means, strict=True)}


def effect_rows(fit: Fit, effects: dict[str, tuple[float, np.ndarray]], reference: str) -> tuple[list[tuple], list[tuple]]:
    """Rows of effects and of their contrasts with the reference state: name, estimate, error, low, high, p."""
    def row(name, estimate, gradient):
        error = math.sqrt(max(0.0, float(gradient @ fit.covariance @ gradient)))
        return name, float(estimate), error, estimate - Z95 * error, estimate + Z95 * error, normal_two_sided(estimate / error) if error else None

    base, base_gradient = effects[reference]
    return [row(k, e, g) for k, (e, g) in effects.items()], [row(k, e - base, g - base_gradient) for k, (e, g) in effects.items() if k != reference]


def calibration_lines(predictions: DataFrame, by: list[str]) -> DataFrame:
    """(by…, calibration_intercept, calibration_slope): an unpenalised logistic fit of the outcome on the log odds of the prediction, for each group.

    All groups take their Newton steps together, each step one aggregate over the rows. A group whose fit has no finite
    optimum, or no spread, has nulls. The number of groups (models, or models by year) is small.
    """
    z, y = F.col("z"), F.col("observed").cast("double")
    rows = predictions.select(*by, logit(F.col("predicted_probability")).alias("z"), "observed").persist()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name in by)
    known: dict[tuple, tuple] = {}
    open_ = {tuple(r): (0.0, 1.0) for r in rows.select(*by).distinct().collect()}
    try:
        for _ in range(50):
            if not open_:
                break
            at = predictions.sparkSession.createDataFrame([(*k, *b) for k, b in open_.items()], f"{schema}, a double, b double")
            p = expit(F.col("a") + F.col("b") * z)
            w = p * (1 - p)
            sums = rows.join(F.broadcast(at), by).groupBy(*by).agg(F.sum(y - p).alias("g0"), F.sum((y - p) * z).alias("g1"), F.sum(w).alias("h0"), F.sum(w * z).alias("h1"), F.sum(w * z * z).alias("h2"))
            for r in sums.collect():
                key = tuple(r[c] for c in by)
                a, b = open_[key]
                d = r["h0"] * r["h2"] - r["h1"] ** 2
                if not d > 1e-12 * r["h0"] * r["h2"] or not math.isfinite(d):
                    known[key] = (None, None)
                    continue
                move = ((r["h2"] * r["g0"] - r["h1"] * r["g1"]) / d, (r["h0"] * r["g1"] - r["h1"] * r["g0"]) / d)
                size = max(abs(x) for x in move)
                cut = min(1.0, 5 / size) if size else 1.0
                a, b = a + cut * move[0], b + cut * move[1]
                if size < 1e-10:
                    known[key] = (a, b)
                else:
                    open_[key] = (a, b)
            open_ = {k: v for k, v in open_.items() if k not in known}
    finally:
        rows.unpersist()
    out = [(*k, *v) for k, v in known.items()] + [(*k, None, None) for k in open_]
    return predictions.sparkSession.createDataFrame(out, f"{schema}, calibration_intercept double, calibration_slope double")
