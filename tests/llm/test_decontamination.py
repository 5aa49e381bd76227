"""Decontamination against a plain search."""

import hashlib
import random
import re

import pytest

from chronopanel.llm import decontamination

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def expected(text, items):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        n = min(13, len(w))
        for window in {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else ():
            for i in range(len(own) - n + 1):
                if tuple(own[i : i + n]) == window:
                    hit |= set(range(i, i + n))
                    found.add("" if item is None else str(item))
    n, k = len(own), len(hit)
    return n, k, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), k > 0 and 20 * k >= n


@pytest.fixture(scope="module")
def case():
    rng = random.Random(4)
    lexicon = [f"w{i}" for i in range(30)] + ["É", "Straße", "x9"]
    some = lambda n: " ".join(rng.choice(lexicon) for _ in range(n))
    items = [(i, some(rng.choice([14, 20, 40]))) for i in range(10)] + [(10, "short one"), (11, ""), (12, None), (None, some(15)), (2, some(20)), (13, some(13))]
    docs = [(i, some(rng.choice([0, 5, 60, 400]))) for i in range(30)]
    docs += [(100 + i, f"{some(20)} {t} {some(i * 30)}") for i, (_, t) in enumerate(items) if t]
    docs += [(200, None), (201, ""), (202, "SHORT, One!"), (203, items[0][1].upper()), (203, items[0][1].upper()), (None, items[1][1])]
    return docs, items


@pytest.mark.parametrize("block_words", [10, 1_000_000])
def test_scan(spark, case, block_words):
    docs, items = case
    got = decontamination.scan(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), block_words=block_words).collect()
    text = {}
    for i, t in docs:
        text[i] = t
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == expected(text[r["doc_id"]], items)


def test_removal_keeps_columns(spark, case):
    docs, items = case
    frame = spark.createDataFrame([(t, i, "z") for i, t in docs], "text string, doc_id long, contaminated string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    clean = decontamination.decontaminate(frame, bench)
    assert clean.columns == frame.columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, t in docs if not expected(t, items)[4])
    cut = decontamination.decontaminate(frame, bench, remove="spans")
    assert cut.count() == len(docs)
    assert all(not expected(r["text"], [x for x in items if x[1] and len(words(x[1])) > 26])[4] for r in cut.where("doc_id = 203").collect())


def test_empty_tables(spark, case):
    docs, items = case
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontamination.scan(frame.limit(0), bench).count() == 0
    assert decontamination.scan(frame, bench.limit(0)).where("n_hit > 0").count() == 0
