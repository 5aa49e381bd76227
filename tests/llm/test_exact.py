"""Equal texts: groups against plain Python, filters of several slices and saturated ones, odd rows."""

import hashlib
import string
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from chronopanel.llm import exact

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def plain(rows):
    """(doc_id, keep_id, group_size, kept, text_sha256) of (doc_id, text) rows, in any order."""
    groups = defaultdict(list)
    for i, text in rows:
        groups[(text or "").translate(LOWER)].append(i)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0))
        out += [(i, ids[-1], len(ids), k == len(ids) - 1, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    odd = [(None, None), (None, ""), (None, "only without id"), (None, "Only without id"), (1, "É one"), (2, "é one"), (3, "é ONE"), (4, "İ"), (5, "i̇"), (6, "x" * 300_000), (7, "X" * 300_000), (8, " "), (9, "same"), (9, "same"), (9, "SAME"), (10, "\x00a"), (11, "\x00A")]
    return odd + [(100 + i, f"Text {i}") for i in range(400)] + [(1000 + i, f"tEXT {i * 7}") for i in range(40)] + [(2000 + i, "hot copy") for i in range(300)]


COLUMNS = "doc_id long, text string"


def got(frame):
    return sorted((tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in exact.classes(frame).collect()), key=str)


def test_groups_are_those_of_plain_python(spark, rows):
    frame = spark.createDataFrame(rows, COLUMNS).repartition(5).withColumns({c: F.lit("z") for c in ("_sha", "_row", "page", "bits", "keep_id", "_maybe")})
    assert got(frame) == plain(rows)
    passed = exact.classes(frame).groupBy("passed").agg(F.max("group_size").alias("most"), F.count("*").alias("n")).collect()
    straight = next(r for r in passed if r["passed"])
    assert straight["most"] == 1 and straight["n"] > 0.9 * sum(n == 1 for _, _, n, _, _ in plain(rows))
    assert got(spark.createDataFrame([], COLUMNS)) == []


def test_slices_of_the_filter_and_a_full_one(spark, rows, monkeypatch):
    frame = spark.createDataFrame(rows, COLUMNS)
    monkeypatch.setattr(exact, "PAGE_BITS", 512)  # some 25 pages, 4 at a time
    monkeypatch.setattr(exact, "PAGES_AT_ONCE", 4)
    assert got(frame) == plain(rows)
    monkeypatch.setattr(exact, "PAGE_BITS", 8)  # every cell is set: all rows are compared
    monkeypatch.setattr(exact, "CELLS_PER_ROW", 1)
    monkeypatch.setattr(exact, "PAGES_AT_ONCE", 1000)
    few = rows[:60]
    assert got(spark.createDataFrame(few, COLUMNS)) == plain(few)


@pytest.mark.parametrize("most", [16384, 1])
def test_rows_that_stay_keep_their_columns(spark, rows, monkeypatch, most):
    monkeypatch.setattr(exact, "PAGES_AT_ONCE", most)
    frame = spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit("kept") for c in ("_sha", "_doc", "_id", "page", "a b")})
    kept = exact.deduplicate(frame)
    assert kept.columns == frame.columns and kept.where("`a b` = 'kept'").count() == kept.count()
    want = sorted(str((i, (t or "").translate(LOWER))) for i, t in {(i, (t or "").translate(LOWER)) for i, t in rows} if (i, (t or "").translate(LOWER)) in {(r[1], (t or "").translate(LOWER)) for r, t in _pairs(rows)})
    assert sorted(str((r["doc_id"], (r["text"] or "").translate(LOWER))) for r in kept.select("doc_id", "text").collect()) == want


def _pairs(rows):
    by_hash = {r[4]: r for r in plain(rows)}
    return [(by_hash[hashlib.sha256((t or "").translate(LOWER).encode()).hexdigest()], t) for _, t in rows]
