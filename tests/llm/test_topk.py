"""Top-k search against all products."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import topk


def brute(rows, k=5):
    """Every row against every other row."""
    good = [(i, tuple(math.floor(256 * np.float32(x).astype(float)) for x in v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(good):
        if i is not None and i % 50 == 0:
            found = sorted((-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(good) if a != b)[:k]
            out += [(i, r, None if none else j, -s) for r, (s, none, j) in enumerate(found, 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("shard_rows", [40, 10_000])
def test_search(spark, shard_rows):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.25, 0.7]) for _ in range(4)]) for i in range(300)]
    rows += [(400 + i, [0.7, 0.7, 0.7, 0.7]) for i in range(100)] + [(3, rows[3][1]), (900, None), (901, [1.0, None, 0.0, 0.0]), (902, [float("nan"), 0.0, 0.0, 0.0]), (903, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0, 1.0]), (904, []), (905, [1.0]), (950, [1.0, 2.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("q", F.lit(1))
    got = topk.search(frame, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).collect()
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str) == brute(rows)


def test_large_values_and_few_rows(spark):
    rows = [(0, [1e6, -1e6]), (1, [1e6, 1e6]), (2, [-1e6, 1e6])]
    got = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted(((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got), key=str) == brute(rows)
    assert topk.search(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).count() == 0


def test_tree_boxes_are_tight():
    rng = np.random.default_rng(2)
    x = rng.integers(-300, 300, (500, 3))
    tree = topk.Tree(np.arange(500), x, 16)
    for (lo, hi), low, high in zip(tree.spans, tree.low, tree.high, strict=True):
        assert (tree.rows[lo:hi].min(0) == low).all() and (tree.rows[lo:hi].max(0) == high).all()


@pytest.mark.parametrize("shard_rows", [8, 10_000])
def test_rows_that_share_ids_and_vectors_ask_one_by_one(spark, tmp_path, shard_rows):
    """Ids of 2 to 10 rows, of different vectors and of equal ones, and rows without an id, against the SQL."""
    rng = random.Random(7)
    rows = []
    for n in range(2, 11):
        own = [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(n)]
        rows += [(50 * n, v) for v in own] + [(50 * n, own[0])] * (n % 3) + [(n, own[0]), (None, own[1])]
    rows += [(50, [9.0, 9.0, 9.0])] * 12 + [(51, [9.0, 9.0, 9.0]), (None, [9.0, 9.0, 9.0]), (None, None), (100, [None, 1.0, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted((str(tuple(r)) for r in topk.search(frame, F.col("vec_id") % 50 == 0, shard_rows=shard_rows).select("query_id", "rank", "vec_id", "score").collect()))
    frame.coalesce(1).write.parquet(str(tmp_path / "e"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/e/*.parquet'")
    db.execute(topk.OP2_SQL)
    assert got == sorted(map(str, db.fetchall())) == sorted(map(str, brute(rows))) and len(got) == 5 * sum(i is not None and i % 50 == 0 and v is not None and None not in v for i, v in rows)
