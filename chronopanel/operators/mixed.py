"""A mixed-effects logistic regression by variational Bayes, fitted where the rows are.

All factors are independent Gaussians: coefficients, the log of the units' deviation, and each unit's effect, with means and log
deviations. Given what all units share, a unit's own two numbers only depend on its own rows, so each pass over the units finds
them by itself, and sends the bound, its gradient and its curvature in what is shared, with the units' own numbers eliminated (a Schur
complement each). So the driver takes Newton steps in some 2 k + 2 numbers, whatever the number of units, and nothing is kept between passes that a
lost executor could take with it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.scalar import Z95
from chronopanel.operators.models import _expit, _summed, term
from chronopanel.sources.tables import temporary, written

#: Rows that one unit may have (a unit has one a period), and rows that a task computes with at a time.
MOST_UNIT_ROWS, CHUNK_ROWS = 100_000, 40_000
NODES, WEIGHTS = np.polynomial.hermite_e.hermegauss(15)
WEIGHTS = WEIGHTS / WEIGHTS.sum()


def _expectations(mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, ...]:
    """The expectation of log(1 + exp(eta)) for Gaussian eta, of its slope, and the derivatives of minus the first.

    They are by mean and mean, mean and variance, variance, and variance twice: those of the very sums of the quadrature, so that steps and bound agree.
    """
    sd = np.sqrt(var)
    eta = mean[:, None] + sd[:, None] * NODES
    p = _expit(eta)
    q = p * (1 - p)
    pz = p @ (WEIGHTS * NODES)
    return np.logaddexp(0, eta) @ WEIGHTS, p @ WEIGHTS, -q @ WEIGHTS, -(q @ (WEIGHTS * NODES)) / (2 * sd), -pz / (2 * sd), pz / (4 * var * sd) - (q @ (WEIGHTS * NODES * NODES)) / (4 * var)


def _own(base: np.ndarray, spread: np.ndarray, y: np.ndarray, group: np.ndarray, m: int, shrink: float) -> tuple[np.ndarray, np.ndarray]:
    """Each unit's best mean and log deviation, given the rows' linear predictors and variances without it."""
    u, w = np.zeros(m), np.full(m, -0.5)
    total = lambda v: np.bincount(group, v, m)
    for i in range(80):
        v = np.exp(2 * w)
        _, p, a, c, e, d = _expectations(base + u[group], spread + v[group])
        slope = 2 * total(e)
        gu, gw = total(y - p) - shrink * u, slope * v + 1 - shrink * v
        huu = total(a) - shrink
        # the mean by a Newton step and the variance by its fixed point; both together once they are near
        du, dw = -gu / huu, -0.5 * np.log(np.maximum(1e-300, v * (shrink - slope)))
        huw, hww = total(c) * 2 * v, total(d) * 4 * v * v + 2 * slope * v - 2 * shrink * v
        det = huu * hww - huw * huw
        if i >= 4:
            near = (det > 0) & (hww < 0)
            safe = np.where(near, det, 1.0)
            du = np.where(near, (huw * gw - hww * gu) / safe, du)
            dw = np.where(near, (huw * gu - huu * gw) / safe, dw)
        u, w = u + np.clip(du, -2, 2), w + np.clip(dw, -1, 1)
        if max(np.abs(du).max(initial=0), np.abs(dw).max(initial=0)) < 1e-11:
            break
    return u, w


def sums(x: np.ndarray, y: np.ndarray, group: np.ndarray, m: int, theta: np.ndarray) -> np.ndarray:
    """What units bring to the bound, its gradient and its curvature in theta = (means, log deviation, their log deviations), units and rows; as one vector."""
    k = x.shape[1]
    b, s, lb, ls = theta[:k], theta[k], theta[k + 1 : 2 * k + 1], theta[2 * k + 1]
    vb, vs = np.exp(2 * lb), math.exp(2 * ls)
    shrink = math.exp(-2 * s + 2 * vs)  # the expectation of the units' precision
    base, spread = x @ b, (x * x) @ vb
    u, w = _own(base, spread, y, group, m, shrink)
    v = np.exp(2 * w)
    mean = base + u[group]
    loss, p, a, c, e, d = _expectations(mean, spread + v[group])
    square = float((u * u + v).sum())
    value = float(y @ mean - loss.sum()) - m * s - 0.5 * shrink * square + float(w.sum())
    wide = 2 * vb * x * x  # how a row's variance moves with the log deviations
    gradient = np.concatenate([x.T @ (y - p), [shrink * square - m], wide.T @ e, [-2 * vs * shrink * square]])
    curve = np.zeros((2 * k + 2, 2 * k + 2))
    cross = (x * c[:, None]).T @ wide
    curve[:k, :k] = (x * a[:, None]).T @ x
    curve[:k, k + 1 : 2 * k + 1], curve[k + 1 : 2 * k + 1, :k] = cross, cross.T
    curve[k + 1 : 2 * k + 1, k + 1 : 2 * k + 1] = (wide * d[:, None]).T @ wide + np.diag(2 * (wide.T @ e))
    curve[k, k] = -2 * shrink * square
    curve[k, -1] = curve[-1, k] = 4 * vs * shrink * square
    curve[-1, -1] = -(4 * vs + 8 * vs * vs) * shrink * square
    # what the units' own two numbers take away
    v2 = 2 * v
    each = lambda rows: np.stack([np.bincount(group, r, m) for r in rows.T], 1) if rows.shape[1] else np.zeros((m, 0))
    to_u = np.concatenate([each(x * a[:, None]), (2 * shrink * u)[:, None], each(wide * c[:, None]), (-4 * vs * shrink * u)[:, None]], 1)
    to_w = np.concatenate([each(x * c[:, None]) * v2[:, None], (2 * shrink * v)[:, None], each(wide * d[:, None]) * v2[:, None], (-4 * vs * shrink * v)[:, None]], 1)
    total = lambda r: np.bincount(group, r, m)
    huu, huw, hww = total(a) - shrink, total(c) * v2, total(d) * v2 * v2 + total(e) * 2 * v2 - 2 * shrink * v
    det = huu * hww - huw * huw
    curve -= (to_u * (hww / det)[:, None]).T @ to_u + (to_w * (huu / det)[:, None]).T @ to_w
    mixed = (to_u * (huw / det)[:, None]).T @ to_w
    curve += mixed + mixed.T
    return np.concatenate([[value], gradient, curve.ravel(), [m, len(y)]])


def _chunks(batches: Iterator, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Rows (label, terms…), the unit of each, and the number of units, of some units at a time."""
    for batch in batches:
        column = batch.column("rows")
        lengths = np.diff(column.offsets.to_numpy()) // (k + 1)
        table = column.flatten().to_numpy().reshape(-1, k + 1)
        ends = np.cumsum(lengths)
        first = 0
        while first < len(lengths):
            begin = ends[first] - lengths[first]
            last = max(first + 1, int(np.searchsorted(ends, begin + CHUNK_ROWS, side="right")))
            yield table[begin : ends[last - 1]], np.repeat(np.arange(last - first), lengths[first:last]), last - first
            first = last


def variational_mixed_logit(frame: DataFrame, terms: list[str], unit: str = "su_id", label: str = "active", prior_log_sd: float = 0.5, prior_fixed: float = 2.0, most: int = 1500, tolerance: float = 1e-5) -> dict:
    """The Gaussians that maximise the evidence bound, as a record.

    Columns are centred and scaled for the fit; means and deviations are then divided by the scales, while the intercept stays
    that of centred columns. A unit's rows (one a period) travel together, MOST_UNIT_ROWS at most, which is checked.
    """
    k = len(terms)
    columns = [term(t).cast("double") for t in terms]
    moments = frame.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    deviations = np.array([moments[f"s{i}"] or 0.0 for i in range(k)])
    varied = deviations > 1e-8
    scale = np.where(varied, deviations, 1.0)
    middle = np.where(varied, [moments[f"m{i}"] or 0.0 for i in range(k)], 0.0)
    scaled = [(c - float(middle[i])) / float(scale[i]) for i, c in enumerate(columns)]
    row = F.array(F.col(label).cast("double"), *scaled)
    collected = F.when(F.count("*") > MOST_UNIT_ROWS, F.raise_error(F.lit(f"a unit of more than {MOST_UNIT_ROWS} rows")).cast("array<double>")).otherwise(F.flatten(F.collect_list(row)))
    with temporary(frame.sparkSession):
        units = written(frame.groupBy(unit).agg(collected.alias("rows")).select("rows"), "mixed-units")
        return _fitted(units, terms, scale, prior_log_sd, prior_fixed, most, tolerance)


def _fitted(units: DataFrame, terms: list[str], scale: np.ndarray, prior_log_sd: float, prior_fixed: float, most: int, tolerance: float) -> dict:
    k = len(terms)
    size = 2 * k + 2
    evaluations = 0

    def bound(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int, int]:
        nonlocal evaluations
        evaluations += 1

        def part(batches):
            found = np.zeros(1 + size + size * size + 2)
            for table, group, m in _chunks(batches, k):
                found += sums(table[:, 1:], table[:, 0], group, m, theta)
            return found

        found = _summed(units, part)
        b, s, lb, ls = theta[:k], theta[k], theta[k + 1 : 2 * k + 1], theta[2 * k + 1]
        vb, vs, precision = np.exp(2 * lb), math.exp(2 * ls), 1 / prior_fixed**2
        value = found[0] - 0.5 * precision * (b @ b + vb.sum()) - 0.5 * (s * s + vs) / prior_log_sd**2 + lb.sum() + ls
        gradient = found[1 : 1 + size] + np.concatenate([-b * precision, [-s / prior_log_sd**2], 1 - vb * precision, [1 - vs / prior_log_sd**2]])
        curve = found[1 + size : 1 + size + size * size].reshape(size, size)
        curve = curve + np.diag(np.concatenate([np.full(k, -precision), [-1 / prior_log_sd**2], -2 * vb * precision, [-2 * vs / prior_log_sd**2]]))
        return float(value), gradient, curve, int(found[-2]), int(found[-1])

    theta = np.concatenate([np.zeros(k), [-0.5], np.full(k, -1.0), [-1.0]])
    value, gradient, curve, m, n = bound(theta)
    message, iteration = "iterations exhausted", 0
    for iteration in range(1, most + 1):  # noqa: B007
        if np.abs(gradient).max() < tolerance:
            message = "gradient below its tolerance"
            break
        # uphill also where the bound isn't concave
        sizes, ways = np.linalg.eigh(-curve)
        step = ways @ ((ways.T @ gradient) / np.maximum(np.abs(sizes), 1e-8 * np.abs(sizes).max()))
        step *= min(1.0, 2 / np.abs(step).max())
        for _ in range(12):
            found = bound(theta + step)
            if math.isfinite(found[0]) and found[0] >= value - 1e-11 * max(abs(value), 1.0):
                break
            step /= 2
        else:
            message = "no better point on the line"
            break
        gain, theta = found[0] - value, theta + step
        value, gradient, curve = found[:3]
        if gain < 1e-11 * max(abs(value), 1.0):
            message = "gain below its tolerance"
            break
    b, deviation = theta[:k] / scale, np.exp(theta[k + 1 : 2 * k + 1]) / scale
    return {
        "terms": terms, "log_odds_mean": b, "posterior_sd": deviation, "odds_ratio": np.exp(b), "interval_low": np.exp(b - Z95 * deviation), "interval_high": np.exp(b + Z95 * deviation),
        "random_sd": math.exp(theta[k]), "bound": value, "iterations": iteration, "evaluations": evaluations, "success": message.endswith("tolerance"), "message": message, "units": m, "rows": n,
    }
