"""Clusters against Lloyd's rounds in plain integers."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import centroids

COLUMNS = "vec_id long, embedding array<double>"


def plain(rows, k, rounds, width, scale=1024):
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) by whole scans in Python's integers."""
    def integer(x):
        return math.floor(x * scale)

    kept = [(i, [integer(x) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        dealt = [nearest(v)[1] for _, v in kept]
        for j in range(len(centres)):
            own = [v for (_, v), d in zip(kept, dealt, strict=True) if d == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    last = [nearest(v) for _, v in kept]
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(str((i, j, d, sum(e for e, x in last if x == j), sum(e for e, _ in last), hashes[j])) for (i, _), (d, j) in zip(kept, last, strict=True))


def got(frame, **settings):
    return sorted(str(tuple(r[c] for c in ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))) for r in centroids.cluster(frame, **settings).collect())


def test_rounds_are_lloyds(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(6, 5))
    rows = [(i, (middles[i % 6] + 0.05 * rng.normal(size=5)).tolist()) for i in range(300)]
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5).withColumns({c: F.lit(1) for c in ("v", "cluster", "moved", "upper", "n", "a b")})
    scans = []
    assert got(frame, k=6, rounds=8, width=5, scans=scans) == plain(rows, 6, 8, 5)
    assert scans[0] == 300 and scans[-1] < 30  # bounds settle the rest


def test_odd_rows(spark):
    """Nulls, lengths, non-finite components, no and repeated ids, equal vectors and centroids, ties, fewer vectors than clusters."""
    rows = [(1, None), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (None, [0.5, -0.25]), (None, [0.5, -0.25]), (6, [0.0, 0.0]), (6, [0.0, 0.0]), (6, [2.0, 1.0]), (7, [1.0, 0.5]), (8, [-3.0, 1e-9]), (9, [-1e-9, -3.0])]
    for k in (1, 3, 8, 20):
        assert got(spark.createDataFrame(rows, COLUMNS), k=k, rounds=3, width=2) == plain(rows, k, 3, 2)
    same = [(i, [1.0, 2.0]) for i in range(40)]
    assert got(spark.createDataFrame(same, COLUMNS), k=4, rounds=2, width=2) == plain(same, 4, 2, 2)
    assert got(spark.createDataFrame(rows[:5], COLUMNS), width=2) == []
    assert got(spark.createDataFrame([], COLUMNS)) == []
    named = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "vec_id string, embedding array<float>")
    assert {r["vec_id"] for r in centroids.cluster(named, width=1).collect()} == {"a", "b"}


def test_large_components_are_exact_or_raise(spark):
    far = [(i, [float(2**40 + i * 7919 % 1000), float(-(2**40) + i)]) for i in range(60)]
    assert got(spark.createDataFrame(far, COLUMNS), k=4, rounds=4, width=2) == plain(far, 4, 4, 2)
    with pytest.raises(Exception, match="a distance beyond 64 bits"):
        got(spark.createDataFrame([(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [0.0, 5e11])], COLUMNS), k=1, rounds=1, width=2)
    with pytest.raises(Exception, match="a component beyond 64 bits"):
        got(spark.createDataFrame([(1, [1e300, 0.0])], COLUMNS), width=2)
