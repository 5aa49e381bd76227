"""Expanding-window prediction: penalised logistic fits on all years before each test year, for several sets of features.

All fits of all test years advance together: a Newton step is one pass over the rows, in which a row adds to every fit whose
training years hold it. They share one design of raw columns (:class:`Shared`), built once a row and step; how a fold imputes, centres and scales is a
matrix, by which its sums are taken to its own columns. What the driver keeps are counts by year, medians, and matrices of coefficients.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.functions.scalar import number
from chronopanel.operators import models
from chronopanel.operators.ordered import quantiles


@dataclass
class Fold:
    """What the training years of a test year say: medians, means and deviations of the numbers, levels seen and the most frequent one."""

    last: int
    median: np.ndarray
    mean: np.ndarray
    sd: np.ndarray
    seen: list[int]
    frequent: int

    def design(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Intercept, scaled numbers, and a column for each level seen; missing numbers (NaN) are imputed, as are missing codes (-1). Unseen levels are all zeros."""
        x = (np.where(np.isnan(numbers), self.median, numbers) - self.mean) / self.sd
        level = np.where(codes < 0, self.frequent, codes)[:, None] == np.array(self.seen)
        return np.concatenate([np.ones((len(x), 1)), x, level], 1)


@dataclass
class Shared:
    """Raw columns that serve all folds: an intercept, each number (scaled alike for all, missing ones 0), a mark for each missing number, one for each level and for none.

    A fold's design is this one times its matrix, exactly: imputation moves a mark's weight, scaling a number's and the intercept's.
    """

    middle: np.ndarray
    scale: np.ndarray
    levels: int

    def columns(self, numbers: np.ndarray, codes: np.ndarray) -> np.ndarray:
        missing = np.isnan(numbers)
        x = np.where(missing, 0.0, (numbers - self.middle) / self.scale)
        level = codes[:, None] == np.array([*range(self.levels), -1])
        return np.concatenate([np.ones((len(x), 1)), x, missing, level], 1)

    def matrix(self, fold: Fold) -> np.ndarray:
        """Columns of this design by those of the fold's."""
        k = len(self.middle)
        out = np.zeros((1 + 2 * k + self.levels + 1, 1 + k + len(fold.seen)))
        out[0, 0] = 1
        at = np.arange(k)
        out[0, 1 + at] = (self.middle - fold.mean) / fold.sd
        out[1 + at, 1 + at] = self.scale / fold.sd
        out[1 + k + at, 1 + at] = (fold.median - self.middle) / fold.sd
        for j, level in enumerate(fold.seen):
            out[1 + 2 * k + level, 1 + k + j] = 1
            out[-1, 1 + k + j] = float(level == fold.frequent)
        return out


def folds(rows: DataFrame, test_years: list[int], numbers: list[str], category: str, year: str = "year") -> tuple[dict[int, Fold], list[str]]:
    """Fold by test year, and all levels of the category in their order."""
    long = rows.select(year, *[number(F.col(c)).alias(c) for c in numbers]).unpivot([year], numbers, "variable", "value")
    counted = long.where("value is not null").groupBy("variable", year, "value").agg(F.count("*").alias("n"))
    tests = F.explode(F.filter(F.array(*[F.lit(t) for t in test_years]), lambda t: t > F.col(year))).alias("test")
    middle = quantiles(counted.select("variable", "value", "n", tests), ["variable", "test"], "value", [0.5], weight="n")
    medians = {(r["variable"], r["test"]): r["quantiles"][0] for r in middle.collect()}
    parts = {(r["variable"], r[year]): r for r in long.groupBy("variable", year).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v")).collect()}
    (levels,) = models.levels_of(rows, category)  # which checks their number
    held = rows.groupBy(year, F.col(category).cast("string").alias("level")).agg(F.count("*").alias("n")).collect()
    out = {}
    for t in test_years:
        before = [r for r in held if r[year] is not None and r[year] < t]
        if not before:
            raise ValueError(f"no years to train on before {t}")
        total, counts = sum(r["n"] for r in before), Counter()
        for r in before:
            if r["level"] is not None:
                counts[r["level"]] += r["n"]
        median, mean, sd = (np.zeros(len(numbers)) for _ in range(3))
        for i, c in enumerate(numbers):
            if (c, t) not in medians:
                raise ValueError(f"{c} is missing in all years before {t}")
            median[i] = medians[c, t]
            # means and variances of the years' parts, and of the imputed rows as one more, put together
            pieces = [(p["n"], p["m"], p["v"]) for (name, y), p in parts.items() if name == c and y is not None and y < t and p["n"]]
            pieces.append((total - sum(n for n, _, _ in pieces), median[i], 0.0))
            mean[i] = sum(n * m for n, m, _ in pieces) / total
            sd[i] = np.sqrt(sum(n * (v + (m - mean[i]) ** 2) for n, m, v in pieces) / total) or 1.0
        frequent = min(counts, key=lambda x: (-counts[x], x)) if counts else None
        seen = [i for i, x in enumerate(levels) if counts[x]]
        out[t] = Fold(max(r[year] for r in before), median, mean, sd, seen, levels.index(frequent) if counts else -1)
    return out, levels


def _coded(rows: DataFrame, numbers: list[str], category: str, levels: list[str], *others: str) -> DataFrame:
    code = F.array_position(F.array(*[F.lit(x) for x in levels]).cast("array<string>"), F.col(category).cast("string")) - 1
    return rows.select(*[F.coalesce(number(F.col(c)), F.lit(float("nan"))).alias(f"x{i}") for i, c in enumerate(numbers)], F.coalesce(code, F.lit(-1)).cast("int").alias("code"), *others)


def _arrays(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    numbers = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(k)]
    return np.stack(numbers, 1) if k else np.empty((batch.num_rows, 0)), batch.column("code").to_numpy()


def fit(rows: DataFrame, made: dict[int, Fold], levels: list[str], sets: dict[str, list[str]], numbers: list[str], category: str, year: str, label: str, c: float = 1.0, most: int = 1000) -> dict[tuple[str, int], np.ndarray]:
    """Coefficients by model and test year: intercept, the set's numbers, levels seen; an L2 penalty of 1/C spares the intercept."""
    k = len(numbers)
    places = {(m, t): [0, *[1 + numbers.index(x) for x in names], *range(1 + k, 1 + k + len(f.seen))] for t, f in made.items() for m, names in sets.items()}
    last = made[max(made)]
    shared = Shared(last.mean, last.sd, len(levels))
    # of the shared columns, each fit has those that its own ones are made of
    own = {(m, t): shared.matrix(made[t])[:, at] for (m, t), at in places.items()}
    parts = {key: np.flatnonzero(a.any(1)) for key, a in own.items()}
    own = {key: a[parts[key]] for key, a in own.items()}
    beta = {key: np.zeros(len(at)) for key, at in places.items()}
    open_ = list(beta)
    frame = _coded(rows.where(F.col(year) < max(made)), numbers, category, levels, F.col(year).cast("int").alias("year"), F.col(label).cast("double").alias("y")).persist()
    try:
        for _ in range(most):
            sizes = [len(parts[key]) for key in open_]
            ends = np.cumsum([0, *[n + n * n + 2 for n in sizes]])

            def part(batches, at={key: own[key] @ beta[key] for key in open_}, open_=open_, ends=ends):
                sums = np.zeros(ends[-1])
                for batch in batches:
                    years = batch.column("year").to_numpy()
                    order = np.argsort(years, kind="stable")  # the rows before a year come first
                    years = years[order]
                    x, codes = _arrays(batch, k)
                    design, y = shared.columns(x[order], codes[order]), batch.column("y").to_numpy()[order]
                    for i, key in enumerate(open_):
                        n = np.searchsorted(years, key[1])
                        sums[ends[i] : ends[i + 1]] += models.newton_sums(design[:n, parts[key]], y[:n], at[key])
                return sums

            sums = models._summed(frame, part)
            left = []
            for i, key in enumerate(open_):
                penalty = np.array([0.0, *[1 / c] * (len(beta[key]) - 1)])
                n, to = sizes[i], own[key]
                found = sums[ends[i] : ends[i + 1]]
                found = np.concatenate([to.T @ found[:n], (to.T @ found[n : n + n * n].reshape(n, n) @ to).ravel(), found[n + n * n :]])
                moved, _, _ = models.newton_step(found, beta[key], penalty)
                if np.abs(moved - beta[key]).max() > 1e-9:
                    left.append(key)
                beta[key] = moved
            open_ = left
            if not open_:
                return beta
    finally:
        frame.unpersist()
    raise ArithmeticError("the fits don't converge")


def forward_predictions(rows: DataFrame, test_years: list[int], sets: dict[str, list[str]], category: str, year: str = "year", label: str = "active", first_year: int | None = None, c: float = 1.0) -> dict[str, DataFrame]:
    """predictions: held-out rows of each test year and set (su_id, test_year, model, observed, predicted_probability, max_training_year,
    rainfall_source_year); coefficients: (model, test_year, feature, coefficient).

    Numbers are imputed with the training years' exact median and scaled by their population deviation; the category is imputed with its most
    frequent level (ties to the first by name) and spread over all training levels; a level that training hasn't seen is all
    zeros. Training starts in first_year. rows is read once for each step, so it should be a stored table.
    """
    spark = rows.sparkSession
    if first_year is not None:
        rows = rows.where(F.col(year) >= first_year)
    numbers = list(dict.fromkeys(x for names in sets.values() for x in names))
    if missing := [x for x in [*numbers, category] if x not in rows.columns]:
        raise ValueError(f"missing predictors: {', '.join(missing)}")
    made, levels = folds(rows, test_years, numbers, category, year)
    beta = fit(rows, made, levels, sets, numbers, category, year, label, c)
    k = len(numbers)
    places = {m: [1 + numbers.index(x) for x in names] for m, names in sets.items()}

    def score(batches):
        for batch in batches:
            x, codes = _arrays(batch, k)
            years = batch.column("test_year").to_numpy()
            for t in np.unique(years).tolist():
                own = np.flatnonzero(years == t)
                f = made[t]
                design = f.design(x[own], codes[own])
                part = batch.take(pa.array(own))
                for m in sets:
                    at = [0, *places[m], *range(1 + k, 1 + k + len(f.seen))]
                    p = models._expit(design[:, at] @ beta[m, t])
                    n = len(own)
                    yield pa.RecordBatch.from_arrays([part.column("su_id"), part.column("test_year"), pa.array([m] * n), part.column("observed"), pa.array(p), pa.array(np.full(n, f.last, np.int32)), part.column("rainfall_source_year")], ["su_id", "test_year", "model", "observed", "predicted_probability", "max_training_year", "rainfall_source_year"])

    tests = _coded(rows.where(F.col(year).isin(*test_years)), numbers, category, levels, "su_id", F.col(year).cast("int").alias("test_year"), F.col(label).cast("int").alias("observed"), F.col("rainfall_source_year").cast("int").alias("rainfall_source_year"))
    id_type = rows.schema["su_id"].dataType.simpleString()
    predictions = tests.mapInArrow(score, f"su_id {id_type}, test_year int, model string, observed int, predicted_probability double, max_training_year int, rainfall_source_year int")
    named = []
    for (m, t), b in beta.items():
        features = ["intercept", *[f"numeric__{x}" for x in sets[m]], *[f"categorical__{category}_{levels[i]}" for i in made[t].seen]]
        named += [(m, t, name, float(v)) for name, v in zip(features, b, strict=True)]
    return {"predictions": predictions, "coefficients": spark.createDataFrame(named, "model string, test_year int, feature string, coefficient double")}
