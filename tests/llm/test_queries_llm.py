"""The registered queries on the smallest tables, against their SQL where there is some."""

import math
import os
import re
import zlib

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronopanel.llm import catalog, language, toxicity
from chronopanel.sources.tables import written

from test_decontamination import words
from test_jaccard import all_pairs
from test_mixing_sharding import water


def plain(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    text = lambda v: str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(text(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        db = duckdb.connect()
        for p in os.listdir(sf):
            db.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{p}'")
        assert plain(got) == plain(db.execute(catalog.ORACLES[name]).df())


@pytest.fixture(scope="module")
def stages(spark, sf):
    """The rows of documents and after each stage."""
    import corpus_pipeline

    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        out.append(written(stage(spark, out[-1], sf), name))
        assert name == "sharding" or out[-1].columns == out[0].columns
    return [d.toPandas() for d in out]


def test_pipeline_is_what_plain_python_makes(spark, sf, stages):
    """Every stage on what the one before kept: scores from the network's own windows, all pairs, a plain search, targets, and the law."""
    docs, clean, single, pure, mixed, dealt = stages
    frame = spark.createDataFrame(docs)
    model = toxicity.fit(frame, spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "text", "toxic", 3, 1)
    keep = [plain_score(model, t) < 0.7 for t in docs["text"]]
    assert sorted(clean["doc_id"]) == sorted(docs["doc_id"][keep]) and 0 < len(docs) - len(clean) < 0.3 * len(docs)
    rows = list(zip(clean["doc_id"].tolist(), clean["text"].tolist(), strict=True))
    want = {c for (_, n, c) in all_pairs(rows, 5, 80) if n} | {d for (d, n, _) in all_pairs(rows, 5, 80) if not n}
    assert set(single["doc_id"]) == want and len(single) == len(want)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            grams.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(g) for g in grams}

    def stays(text):
        w, hit = words(text), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit |= set(range(i, i + n))
        return not hit or 20 * len(hit) < len(w)

    assert sorted(pure["doc_id"]) == sorted(d for d, t in zip(single["doc_id"], single["text"], strict=True) if stays(t)) and len(pure) < len(single)
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    total = pure.assign(n=pure["text"].map(size)).groupby("source")["n"]
    target = water(total.sum().to_dict())
    taken = mixed.assign(n=mixed["text"].map(size)).groupby("source")["n"].sum()
    assert all(abs(taken.get(s, 0) - t) <= total.max()[s] for s, t in target.items())
    assert mixed["doc_id"].value_counts().max() <= 2 and set(mixed["doc_id"]) <= set(pure["doc_id"])
    counts = dealt["shard"].value_counts().reindex(range(40), fill_value=0)
    assert len(dealt) == len(mixed) and counts.max() - counts.min() <= 1 and sorted(dealt["doc_id"]) == sorted(mixed["doc_id"])


def test_language_and_toxicity_score_as_plain_python_does(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    own = docs.toPandas()
    rows = {r["doc_id"]: r for r in language.identify(docs).collect()}
    learn = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2
    model = language.fit(docs, learn, "doc_id", "text", "lang")

    def word_score(w):
        known, table = model.words
        if w in known:
            return [float(x) for x in table[known[w]]]
        for n in (5, 4, 3, 2, 1):
            known, table = model.grams[n]
            marked = f"<{w}>" if n > 1 else w
            found = [table[known[marked[i : i + n]]] for i in range(len(marked) - n + 1) if marked[i : i + n] in known]
            if found:
                return [sum(float(x[j]) for x in found) / len(found) for j in range(len(model.languages))]
        return [0.0] * len(model.languages)

    for d, text in zip(own["doc_id"], own["text"], strict=True):
        found = re.findall(r"[^\W\d_]+", (text or "").lower())
        sums = [sum(x) for x in zip(*[word_score(w) for w in found], strict=True)] if found else []
        best = model.languages[max(range(len(sums)), key=lambda j: sums[j])] if found else "und"
        assert rows[d]["lang_pred"] == best and rows[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2)
        if found:
            share = [math.exp((s - max(sums)) / math.sqrt(len(found))) for s in sums]
            assert rows[d]["score"] == pytest.approx(max(share) / sum(share), abs=1e-4)
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    p = toxicity.fit(docs, labels, "doc_id", "text", "toxic", 3, 1)
    scored = {r["doc_id"]: r for r in toxicity.rate(docs, labels).collect()}
    for d, text in list(zip(own["doc_id"], own["text"], strict=True))[:40]:
        assert scored[d]["score"] == pytest.approx(plain_score(p, text), abs=1e-3) and scored[d]["predicted"] == (scored[d]["score"] >= 0.7)


def plain_score(p, text):
    """The network read word by word: gates, candidate state, attention and logistic output, one window after the other."""
    tokens = re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())
    starts = [0] if len(tokens) <= 32 else [*range(0, len(tokens) - 32, 16), len(tokens) - 32]
    known = {}

    def vector(w):
        if w not in known:
            marked, chars, n = b"<%b>" % w, np.zeros(8), 0
            for k in (3, 4, 5):
                for i in range(len(marked) - k + 1):
                    rolling = 0
                    for c in marked[i : i + k]:
                        rolling = (rolling * 0x100000001B3 + c + 1) & 0xFFFFFFFFFFFF
                    chars += p["chars"][(rolling * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 50]
                    n += 1
            known[w] = np.concatenate([p["words"][xxhash.xxh32_intdigest(w) % len(p["words"])], chars / math.sqrt(n)])
        return known[w]

    sig = lambda x: 1 / (1 + np.exp(-x))
    best = -math.inf
    for at in starts:
        window, states = tokens[at : at + 32], {}
        for d, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h = np.zeros(8)
            for t in order:
                x, u = vector(window[t]) @ p[f"W{d}"] + p[f"b{d}"], h @ p[f"U{d}"]
                z, r = sig(x[:8] + u[:8]), sig(x[8:16] + u[8:16])
                h = h + z * (np.tanh(x[16:] + r * u[16:]) - h)
                states.setdefault(t, {})[d] = h
        both = [np.concatenate([states[t]["f"], states[t]["b"]]) for t in range(len(window))]
        weights = np.exp([s @ p["attend"] for s in both]) if both else []
        pooled = sum((w * s for w, s in zip(weights, both, strict=True)), np.zeros(16)) / (sum(weights) or 1)
        best = max(best, float(pooled @ p["out"] + p["bias"][0]))
    return float(sig(best))
