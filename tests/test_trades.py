"""Chains of trades: single rounds against plain Python, uniformity over a whole class of matrices, and agreement with swaps."""

import hashlib
from collections import Counter
from itertools import product

import numpy as np
from pyspark.sql import functions as F

from chronopanel.operators import randomization, trades

YEARS = [1990, 1991, 1993, 1994, 1996, 1999, 2000]
MISSING = [1992, 1995]


def matrix_of(spark, masks):
    return spark.createDataFrame([(f"u{i:03d}", int(m)) for i, m in enumerate(masks)], "su_id string, mask long")


def plain_round(masks, seed, number, columns, depth):
    """A round over {unit: mask}, one chain."""
    md5 = lambda *parts: hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()
    blocks = {}
    for key, u in sorted((md5(seed, number, u), u) for u in masks):
        blocks.setdefault(key[:depth], []).append(u)
    new = dict(masks)
    for members in blocks.values():
        for a, b in zip(members[::2], members[1::2]):
            p, q = masks[a], masks[b]
            pool = sorted((1 << c for c in range(columns) if (p ^ q) >> c & 1), key=lambda bit: (md5(seed, number, a, bit), bit))
            taken = sum(pool[: (p & ~q).bit_count()])
            new[a], new[b] = p & q | taken, p & q | (p ^ q) ^ taken
    return new


def test_rounds_are_those_of_plain_python(spark):
    rng = np.random.default_rng(1)
    masks = rng.integers(0, 1 << 63, 151, dtype=np.uint64).astype(np.int64) | 1
    columns, depth = trades.MOST_COLUMNS, trades.digits(151, 20)
    assert depth == 1 and trades.digits(0) == trades.digits(4096) == 0 and trades.digits(4097) == 1
    chains = randomization.schedule(spark, 2, [5, -6])
    state, want = trades.begun(matrix_of(spark, masks), chains), {s: {f"u{i:03d}": int(m) for i, m in enumerate(masks)} for s in (5, -6)}
    for number in range(3):
        state = trades.trade_round(state, number, columns, depth)
        want = {s: plain_round(m, s, number, columns, depth) for s, m in want.items()}
    got = state.collect()
    assert {(r["seed"], r["su_id"]): r["mask"] for r in got} == {(s, u): m for s, rows in want.items() for u, m in rows.items()}
    assert all(r["mask"].bit_count() == r["size"] for r in got) and {r["met"] for r in got} <= {0, 1, 2, 3}


def test_trades_are_uniform_over_all_matrices_of_their_margins(spark):
    """3,000 chains on a class that can be listed: chi-square over all its matrices."""
    start = [0b0011, 0b0101, 0b0110, 0b1000]
    sums = lambda rows: [sum(r >> c & 1 for r in rows) for c in range(4)]
    some = [[m for m in range(16) if m.bit_count() == r.bit_count()] for r in start]
    every = [rows for rows in product(*some) if sums(rows) == sums(start)]
    assert len(every) > 20
    n = 3000
    chains = spark.range(n).select(F.col("id").cast("int").alias("chain"), (F.col("id") + 100).alias("seed"), F.lit(1).alias("n_draws"))
    _, state = trades.Traders(matrix_of(spark, start), chains, YEARS[:4], [], 14, 2).take(0, 1)
    drawn = state.groupBy("chain").agg(F.transform(F.array_sort(F.collect_list(F.struct("su_id", "mask"))), lambda x: x["mask"]).alias("rows")).collect()
    found = Counter(tuple(r["rows"]) for r in drawn)
    assert len(drawn) == n and found.keys() <= set(every)
    expected = n / len(every)
    chi = sum((found[m] - expected) ** 2 / expected for m in every)
    free = len(every) - 1
    assert chi < free + 4 * (2 * free) ** 0.5, (chi, free)


def test_trades_agree_with_swaps(spark):
    rng = np.random.default_rng(3)
    # early years are busy and late ones are not, so that rates of the matrix as it is differ from the null's
    masks = [int(m) for m in rng.integers(1, 127, 60) & rng.integers(0, 128, 60) | rng.integers(0, 8, 60)]
    matrix = matrix_of(spark, [m for m in masks if m])
    swaps = randomization.swap_chains(matrix, randomization.schedule(spark, 400, [1, 2]), YEARS, MISSING, 3000, 400)
    traded = trades.traded_chains(matrix, randomization.schedule(spark, 400, list(range(50, 250))), YEARS, MISSING, 12, 8)
    moments = lambda d: {r["gap_time_category"]: r for r in d.groupBy("gap_time_category").agg(F.avg("n_risk").alias("n"), F.avg("active").alias("a"), F.stddev("active").alias("sd"), F.stddev("n_risk").alias("nsd"), F.count("*").alias("k"), F.bool_and("margins_kept").alias("kept")).collect()}
    one, two = moments(swaps), moments(traded)
    assert one.keys() == two.keys() == set(randomization.CATEGORIES)
    for c in one:
        assert one[c]["kept"] and two[c]["kept"] and one[c]["k"] == two[c]["k"] == 400
        # five standard errors of the difference of two means
        assert abs(one[c]["a"] - two[c]["a"]) <= 5 * max(one[c]["sd"], two[c]["sd"], 0.01) * (2 / 400) ** 0.5
        assert abs(one[c]["n"] - two[c]["n"]) <= 5 * max(one[c]["nsd"], two[c]["nsd"], 0.01) * (2 / 400) ** 0.5


def test_draws_count_their_state_and_broken_margins_show(spark):
    rng = np.random.default_rng(4)
    masks = [int(m) for m in rng.integers(1, 128, 40)]
    matrix, plan = matrix_of(spark, masks), randomization.schedule(spark, 1, [9])
    state = trades.begun(matrix, plan)
    ones = trades.column_sums(matrix, len(YEARS))
    dense = randomization.dense(masks, len(YEARS))
    assert ones == dense.sum(0).tolist()
    rows = trades.gap_counts(state, 0, YEARS, MISSING, ones).collect()
    assert {r["gap_time_category"]: (r["n_risk"], r["active"]) for r in rows} == randomization.matrix_gap_counts(dense, YEARS, MISSING) and all(r["margins_kept"] for r in rows)
    for broken in (state.withColumn("mask", F.when(F.col("su_id") == "u001", F.col("mask").bitwiseXOR(1)).otherwise(F.col("mask"))), state.withColumn("size", F.col("size") + 1)):
        assert not any(r["margins_kept"] for r in trades.gap_counts(broken, 0, YEARS, MISSING, ones).collect())


def test_batches_go_on_and_chains_stop_at_their_draws(spark):
    rng = np.random.default_rng(6)
    matrix = matrix_of(spark, [int(m) for m in rng.integers(1, 128, 33)])
    plan = randomization.schedule(spark, 7, [1, 2])
    whole = sorted(tuple(r) for r in trades.traded_chains(matrix, plan, YEARS, MISSING, 5, 3, 8).collect())
    assert Counter(r[0] for r in whole) == {0: 20, 1: 15}
    traders = trades.Traders(matrix, plan, YEARS, MISSING, 5, 3, 8)
    a, state = traders.take(0, 3)
    b, _ = traders.take(3, 1, state)
    assert sorted(tuple(r) for r in a.unionAll(b).collect()) == whole
    assert trades.traded_chains(matrix, plan.where("chain > 5"), YEARS, MISSING, 5, 3).count() == 0
    assert trades.traded_chains(matrix.limit(0), plan, YEARS, MISSING, 1, 1).count() == 0
