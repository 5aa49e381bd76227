"""Golden rows of the history block, by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.operators import history, randomization
from chronopanel.sources import contract

YEARS = [1992, 1993, 1996, 1997, 1998, 1999, 2000, 2001, 2009, 2010]
COUNTS = {"A": {1992: 2, 1996: 1, 1998: 3, 2009: 1}, "B": {1997: 1}, "C": {}}


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(u, y, str(COUNTS[u].get(y, 0)), COUNTS[u].get(y, 0)) for u in COUNTS for y in reversed(YEARS)]
    df = history.derive_response(spark.createDataFrame(rows, "su_id string, year int, landslide_count string, shallow_active int"))
    return history.build_history(df, [1994, 1995]).persist()


def test_block(panel):
    got = {r["year"]: r for r in panel.where("su_id = 'A'").collect()}
    columns = ("landslide_count", "active", "prior_landslide_count", "prior_active_years", "prior_failure", "last_active_year", "years_since_last_activity", "history_crosses_missing_gap", "gap_time_category", "activity_class", "recurrence_stage")
    want = {
        1992: (2, 1, 0, 0, 0, None, None, 0, None, "active_history_unknown", None),
        1993: (0, 0, 2, 1, 1, 1992, 1, 0, "1_year", "inactive", "1_prior_active_year"),
        1996: (1, 1, 2, 1, 1, 1992, 4, 1, "3_5_years", "recurrent_activity", "1_prior_active_year"),
        1998: (3, 1, 3, 2, 1, 1996, 2, 0, "2_years", "recurrent_activity", "2_prior_active_years"),
        2009: (1, 1, 6, 3, 1, 1998, 11, 0, "gt10_years", "recurrent_activity", "3plus_prior_active_years"),
        2010: (0, 0, 7, 4, 1, 2009, 1, 0, "1_year", "inactive", "3plus_prior_active_years"),
    }
    for year, row in want.items():
        assert tuple(got[year][c] for c in columns) == row, year
    first = panel.where("su_id = 'B' and year = 1997").first()
    assert first["activity_class"] == "first_observed_activation" and first["gap_time_category"] is None
    assert panel.where("su_id = 'C' and prior_failure = 1").count() == 0


def test_audits(panel):
    totals = history.exclusion_summary(history.exclusion_audit(panel)).where("analysis = 'recurrence'").first()
    assert (totals["potential_slope_unit_years"], totals["pre_first_excluded"], totals["gap_crossing_excluded"], totals["retained_risk_rows"]) == (30, 15, 1, 14)
    support = {r["gap_time_category"]: (r["n_slope_unit_years"], r["active_outcomes"], r["n_slope_units"]) for r in history.risk_support(panel).collect()}
    assert support == {"1_year": (5, 0, 2), "2_years": (3, 1, 2), "3_5_years": (3, 0, 2), "gt10_years": (3, 1, 2)}
    rates = randomization.observed_gap_rates(history.risk_set(panel))
    by_name = {r["gap_time_category"]: (r["n_risk"], r["rate"]) for r in rates.collect()}
    assert by_name["6_10_years"] == (0, None)
    s = randomization.statistics(rates).first()
    assert s["short_1_5_rate"] == pytest.approx(1 / 11) and s["long_gt5_rate"] == pytest.approx(1 / 3)
    assert s["short_vs_long_risk_ratio"] == pytest.approx(3 / 11) and s["one_vs_gt10_risk_ratio"] == 0


def test_events_give_the_response(spark):
    panel = spark.createDataFrame([("A", 2000), ("A", 2001)], "su_id string, year int")
    events = spark.createDataFrame([("A", 2000, " Shallow "), ("A", 2000, "deep"), (None, 2000, "deep")], "su_id string, year int, type string")
    got = {r["year"]: (r["landslide_count"], r["shallow_count"], r["active"]) for r in history.derive_response(panel, events).collect()}
    assert got == {2000: (2.0, 1.0, 1), 2001: (0.0, 0.0, 0)}
    negative = spark.createDataFrame([("A", 2000, "-3"), ("A", 2001, "x"), ("A", 2002, None), ("A", 2003, "NaN")], "su_id string, year int, count string")
    assert {(r["landslide_count"], r["active"]) for r in history.derive_response(negative, events).collect()} == {(0.0, 0)}
    unnamed = events.drop("type")
    with pytest.raises(contract.ContractError):
        history.derive_response(panel, unnamed)


def test_flags_are_no_counts(spark):
    rows = spark.createDataFrame([("A", 2000, 3.0, float("nan")), ("A", 2001, float("nan"), 2.0), ("A", 2002, None, 0.0)], "su_id string, year int, occurrence double, Shallow_Occurrence double")
    got = {r["year"]: (r["landslide_count"], r["active"], r["shallow_count"], r["shallow_active"]) for r in history.derive_response(rows).collect()}
    assert got == {2000: (1.0, 1, 0.0, 0), 2001: (0.0, 0, 1.0, 1), 2002: (0.0, 0, 0.0, 0)}
    # a flag of all events gives way to the events themselves
    events = spark.createDataFrame([("A", 2001, "deep"), ("A", 2001, "deep")], "su_id string, year int, type string")
    assert {r["year"]: r["landslide_count"] for r in history.derive_response(rows, events).collect()} == {2000: 0.0, 2001: 2.0, 2002: 0.0}


def test_a_panel_without_a_response_raises(spark):
    for columns in ("su_id string, year int", "su_id string, year int, count int"):
        with pytest.raises(contract.ContractError):
            history.derive_response(spark.createDataFrame([], columns))


def test_chains_agree_with_the_relational_rates(spark, panel):
    matrix = history.activity_matrix(panel, YEARS)
    masks = {r["su_id"]: r["mask"] for r in matrix.collect()}
    assert masks == {"A": 0b0100010101, "B": 0b0000001000}
    import numpy as np

    dense = np.array([[masks[u] >> i & 1 for i in range(len(YEARS))] for u in sorted(masks)], np.int8)
    counts = randomization.matrix_gap_counts(dense, YEARS, [1994, 1995])
    assert counts == {"1_year": (5, 0), "2_years": (3, 1), "3_5_years": (3, 0), "6_10_years": (0, 0), "gt10_years": (3, 1)}
    draws = randomization.swap_chains(matrix, randomization.schedule(spark, 5, [1, 2]), YEARS, [1994, 1995], 50, 20)
    rows = draws.collect()
    assert len(rows) == 25 and all(r["margins_kept"] for r in rows)
    again = {tuple(r) for r in draws.collect()}
    assert again == {tuple(r) for r in rows}


def test_registered_chains_are_whole(spark, sf):
    from chronopanel.plans import catalog, stages

    full = stages.Config("", "")
    got = catalog.QUERIES["chain_diagnostics"](spark, sf).collect()
    assert sum(r["retained_draws"] for r in got) == full.draws == 9999
    assert {r["total_attempts"] for r in got} == {full.burn_in + full.draws // 3 * full.thin} and all(r["margins_kept"] for r in got)


def test_swaps_are_those_of_sets():
    rng = np.random.default_rng(5)
    masks = [int(x) for x in rng.integers(1, 63, 40)]
    rows = [{i for i in range(6) if x >> i & 1} for x in masks]
    again, accepted = np.random.default_rng(3), 0
    swaps = randomization.swapped(masks, 6, np.random.default_rng(3), 3000)
    a, b, c, d = again.integers(40, size=3000), again.integers(39, size=3000), again.integers(6, size=3000), again.integers(5, size=3000)
    for i, j, x, y in zip(a, b + (b >= a), c, d + (d >= c), strict=True):
        p, q = rows[i], rows[j]
        if (x in p) != (y in p) and (x in q) != (y in q) and (x in p) != (x in q):
            rows[i], rows[j], accepted = p ^ {int(x), int(y)}, q ^ {int(x), int(y)}, accepted + 1
    assert accepted == swaps > 0 and [sum(1 << x for x in r) for r in rows] == masks


def test_chains_go_on_where_they_stopped(spark, panel):
    matrix, plan = history.activity_matrix(panel, YEARS), randomization.schedule(spark, 10, [1, 2])
    whole = {tuple(r) for r in randomization.swap_chains(matrix, plan, YEARS, [1994, 1995], 50, 20).collect()}
    start = randomization.chain_starts(matrix, plan)
    one = randomization.chain_steps(start.withColumn("n_draws", F.lit(3)), YEARS, [1994, 1995], 50, 20).persist()
    two = randomization.chain_steps(randomization.chain_after(start, one, 2), YEARS, [1994, 1995], 50, 20)
    parts = one.unionAll(two).where("gap_time_category is not null").drop("masks", "generator")
    assert {tuple(r) for r in parts.collect()} == whole


def test_tallies_of_changed_rows_are_those_of_whole_matrices(monkeypatch):
    rng = np.random.default_rng(8)
    start = rng.integers(1, 1 << 10, 500)
    masks, missing = start.copy(), [1994, 1995]
    monkeypatch.setattr(randomization, "SLICE", 64)
    tally, dense_rows = randomization.Tally(masks, start, YEARS, missing), []
    monkeypatch.setattr(randomization, "dense", lambda m, columns, whole=randomization.dense: dense_rows.append(len(m)) or whole(m, columns))
    for _ in range(20):
        moved = []
        assert randomization.swapped(masks, 10, rng, 60, moved) * 2 == sum(map(len, moved)) > 0
        tally.update(np.concatenate(moved))
        assert tally.margins_kept
        counts = randomization.matrix_gap_counts(randomization.dense(masks.tolist(), 10), YEARS, missing)
        assert {c: (n, k) for c, n, k in zip(randomization.CATEGORIES, *tally.sums.tolist(), strict=True)} == counts
        # rows that didn't move are not read for a draw
        assert dense_rows.pop() == 500 and max(dense_rows) <= 2 * 2 * 60
        dense_rows.clear()
    tally.check()
    # margins that don't hold show, also in later draws, and so does a row that changed without being named
    masks[3] ^= 1
    with pytest.raises(ValueError):
        tally.check()
    for rows in ([3], [5]):
        tally.update(np.array(rows))
        assert not tally.margins_kept
    masks[3] ^= 1
    tally.update(np.array([3]))
    assert tally.margins_kept
    tally.check()


def test_whole_matrices_are_counted_by_slices():
    """A task's memory doesn't grow with units x years: two million units of 60 years are 960 MB as a matrix of numbers."""
    import tracemalloc

    masks = np.arange(1, 2_000_001)
    tracemalloc.start()
    tally = randomization.Tally(masks, masks, list(range(1900, 1960)), [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert tally.margins_kept and peak < 300e6


def plain_swaps(masks, columns, rng, n):
    """Proposals as swapped draws them, one after another; how many were taken up."""
    done = 0
    while n > 0:
        k = min(n, randomization.PROPOSALS)
        n -= k
        a, b, c, d = (rng.integers(m, size=k) for m in (len(masks), len(masks) - 1, columns, columns - 1))
        for i, j, x, y in zip(a.tolist(), (b + (b >= a)).tolist(), c.tolist(), (d + (d >= c)).tolist(), strict=True):
            bits = 1 << x | 1 << y
            if (masks[i] ^ masks[j]) & bits == bits and masks[i] & bits not in (0, bits):
                masks[i], masks[j], done = masks[i] ^ bits, masks[j] ^ bits, done + 1
    return done


def test_blocks_of_swaps_are_swaps_one_by_one(monkeypatch):
    """For few rows and many, narrow and wide ones, and rows that share a mark."""
    rng = np.random.default_rng(9)
    for rows, columns, spots in ((2, 2, 1 << 18), (30, 6, 1 << 18), (3000, 6, 1 << 18), (3000, 6, 64), (40000, 6, 1 << 18), (40000, 25, 4096), (5000, 63, 1 << 18)):
        monkeypatch.setattr(randomization, "SPOTS", spots)
        masks = rng.integers(1, 1 << columns, rows) & rng.integers(0, 1 << columns, rows)
        want, now, moved = masks.tolist(), masks.copy(), []
        done = plain_swaps(want, columns, np.random.default_rng(4), 20000)
        assert randomization.swapped(now, columns, np.random.default_rng(4), 20000, moved) == done and (done > 100 or rows == 2)
        assert now.tolist() == want
        assert set(np.flatnonzero(now != masks)) <= set(np.concatenate(moved).tolist()) and sum(map(len, moved)) == 2 * done


def test_few_proposals_wait_for_others(monkeypatch):
    """In a matrix of many rows nearly all proposals of a block are settled at once."""
    rng, alone = np.random.default_rng(10), []
    monkeypatch.setattr(randomization, "_one_by_one", lambda masks, i, j, bits, plain=randomization._one_by_one: alone.append(len(i)) or plain(masks, i, j, bits))
    masks = rng.integers(1, 64, 100_000) & rng.integers(0, 64, 100_000)
    assert randomization.swapped(masks, 6, rng, 10 * randomization.PROPOSALS) > 5000
    assert sum(alone) < 0.03 * 10 * randomization.PROPOSALS


def test_chains_start_beside_one_another_and_off_the_driver(spark, panel, monkeypatch):
    from pyspark.sql.classic.dataframe import DataFrame

    matrix, plan = spark.createDataFrame([(f"u{i}", i) for i in range(12, 0, -1)], "su_id string, mask long"), randomization.schedule(spark, 9, [1, 2, 3])
    with monkeypatch.context() as m:
        for name in ("collect", "toPandas", "toArrow", "first"):
            m.setattr(DataFrame, name, lambda *_: pytest.fail("rows went to the driver"))
        starts = randomization.chain_starts(matrix, plan)
    order = sorted(range(1, 13), key=lambda i: f"u{i}")
    rows = starts.collect()
    assert [(r["chain"], r["n_draws"], np.frombuffer(r["start"], np.int64).tolist(), r["masks"] == r["start"], r["generator"], r["first"]) for r in sorted(rows)] == [(c, 3, order, True, None, 0) for c in range(3)]
    steps = randomization.chain_steps(starts, YEARS, [1994, 1995], 5, 5)
    tasks = steps.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.count_distinct("chain").alias("n")).collect()
    assert [r["n"] for r in tasks] == [1, 1, 1]
    empty = randomization.chain_starts(matrix.limit(0), plan).collect()
    assert [(r["start"], r["masks"]) for r in empty] == [(b"", b"")] * 3
    monkeypatch.setattr(randomization, "MOST_UNITS", 11)
    with pytest.raises(Exception, match="more than 11 active units"):
        randomization.chain_starts(matrix, plan).collect()
