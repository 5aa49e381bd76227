"""Very long texts, clashing names of further columns, null ids and repeated rows, for every operator and stage that takes documents."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import chat, decontamination, jaccard, language, mixing, secrets, sharding, shared, toxicity, topk, warc
from chronopanel.llm.catalog import ORACLES

NAMES = ["id", "check", "v", "row", "s", "root", "node", "shard", "slot", "_source", "_key", "size", "score", "label", "lang_pred", "_text", "_0", "spans", "n", "path", "candidate"]
COLUMNS = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def long_text():
    rng = np.random.default_rng(1)
    words = np.array([f"w{i}" for i in range(5000)])
    return " ".join(words[rng.integers(0, 5000, 60_000)]) + " " + "x" * 200_000 + " the end"


@pytest.fixture(scope="module")
def docs(spark, long_text):
    """Nulls in every column, empty texts, one very long text and a copy of it, repeated rows, and further columns of any name."""
    rows = [(1, "one two three four", "en", "a"), (1, "one two three four", "en", "a"), (None, "one two three four", None, None), (None, None, None, None), (None, None, None, None), (2, "", "de", "b"), (3, long_text, "en", "b"), (4, long_text, "en", None), (5, " \n", "en", "c"), (6, "password=Tr0ub4dor3 der schnee", "de", "c")]
    frame = spark.createDataFrame(rows, COLUMNS)
    return frame.withColumns({c: F.lit("kept") for c in NAMES})


def test_every_operator_takes_them(spark, docs, long_text):
    labels = spark.createDataFrame([(1, 0), (3, 1), (None, 1), (6, 1), (2, None)], "doc_id long, toxic int").withColumn("y", F.lit("z"))
    benchmark = spark.createDataFrame([("i", long_text[:4000]), ("i", None), (None, "der schnee"), ("long", long_text)], "item_id string, text string").withColumn("_text", F.lit("z"))
    n = docs.count()
    assert jaccard.join_components(docs).count() == n
    assert mixing.mix_plan(docs).agg(F.count("*"), F.max("size")).first()[1] == 60_003
    assert sharding.shard(docs, shards=3).count() == n
    assert language.identify(docs).count() == n and toxicity.rate(docs, labels).count() == n
    found = {r["doc_id"]: r for r in decontamination.scan(docs, benchmark, block_words=5000).collect()}
    assert found[3]["n_words"] == found[3]["n_hit"] == 60_003 and found[3]["n_items"] == 2 and found[6]["contaminated"]
    secret = secrets.scan(docs).collect()
    assert {r["candidate"] for r in secret if r["is_secret"]} == {"Tr0ub4dor3"} and sum(len(r["candidate"]) == 200_000 for r in secret) == 2
    for kept in (toxicity.without_toxic(docs, labels), jaccard.one_of_each(docs), decontamination.decontaminate(docs, benchmark), decontamination.decontaminate(docs, benchmark, remove="spans"), mixing.mix(docs)):
        assert kept.columns == docs.columns and kept.agg(F.bool_and(F.col("label") == "kept")).first()[0]
    once = jaccard.one_of_each(docs).select("doc_id", F.length("text").alias("n")).collect()
    assert sorted((r["doc_id"] or 0, r["n"] or 0) for r in once) == sorted([(1, 18), (0, 0), (0, 0), (2, 0), (3, len(long_text)), (5, 2), (6, 30)])


def test_long_texts_are_hashed_like_others(long_text, monkeypatch):
    texts = ["a b", long_text, None, "", "b\tA  c"]
    hashes, starts = shared.hashed_words(texts)
    monkeypatch.setattr(shared, "PIECE_BYTES", 1000)
    again, places = shared.hashed_words(texts)
    assert (hashes == again).all() and (starts == places).all() and starts.tolist() == [0, 2, 60_005, 60_005, 60_005, 60_008]
    assert hashes[0] == hashes[-2] and hashes[1] == hashes[-3] and len(np.unique(hashes[2:60_005])) == 5003
    longer = shared.hashed_words(["x" * 70_000 + " " + "x" * 70_001])[0]
    assert longer[0] != longer[1]


def test_segments_have_the_windows_of_the_text(long_text, monkeypatch):
    want = {tuple(w) for w in _windows(toxicity.words_of(long_text))}
    monkeypatch.setattr(toxicity, "SEGMENT_WORDS", toxicity.WIDTH + toxicity.STRIDE * 5)
    assert {tuple(w) for part in toxicity.segments(long_text) for w in _windows(part)} == want
    p = toxicity.start(1)
    few = toxicity.score(p, [long_text, "a", None])
    monkeypatch.undo()
    assert toxicity.score(p, [long_text, "a", None]) == pytest.approx(few, abs=1e-6)
    monkeypatch.setattr(language, "WORDS_TOGETHER", 100)
    assert [w for part in language.word_lists(long_text) for w in part] == language.words_of(long_text)
    for most in (30, 1000):
        parts = list(decontamination.segments(long_text, 12, most))
        words = decontamination.words_of(long_text)
        assert all(words[at : at + len(x)] == x for at, x in parts) and parts[-1][0] + len(parts[-1][1]) == len(words)


def _windows(words):
    v = toxicity.Vocabulary([words])
    places, _ = v.windows()
    return [[v.words[i] if i >= 0 else None for i in row] for row in places]


@pytest.mark.parametrize("bits", [64, 6])
def test_sets_of_one_name_are_told_apart(spark, bits):
    texts = [f"a{i} b{i} c{i} d{i}" for i in range(60)] + ["a1 b1 c1 d1", "A2 b2 c2 d2"]
    got = jaccard.join_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), bits=bits).collect()
    assert {r["id"]: r["component_id"] for r in got} == {i: i if i < 60 else i - 59 for i in range(62)}


def test_null_and_repeated_ids_are_mixed_one_by_one(spark):
    """Taken words come near the target where all rows of a source share an id, or are alike altogether."""
    rows = [(None, f"w{i} b c d e", "a") for i in range(600)] + [(7, "same same", "b")] * 500 + [(i, "x y", "c") for i in range(50)] + [(9, "", "b")] * 5
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    plan = mixing.mix_plan(frame)
    for r in plan.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("largest"), F.max("copies").alias("copies")).collect():
        assert abs(r["taken"] - r["target"]) <= r["largest"] and r["copies"] <= 2
    assert mixing.mix(frame).groupBy("source").count().orderBy("source").collect() == plan.groupBy("source").agg(F.sum("copies").alias("count")).orderBy("source").collect()


def test_chats_of_many_and_null_turns_are_those_of_the_sql(spark, monkeypatch):
    monkeypatch.setattr(chat, "LEAST_LARGE", 20)
    rows = [(1, 5, "ab"[i % 2], f"t{i % 7}") for i in range(40)] + [(1, None, "a\nuser name=b", "<|im_end|>"), (1, 6, None, None), (2, 0, "a", "x"), (2, 1, "system", "be"), (None, 3, "c", "y"), (None, 3, "c", "y"), (3, None, "d", "z")]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    out = chat.rotate(frame)
    masked = F.aggregate("masks", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    got = out.select("conv_id", "perspective", "block", "part", "n_turns", F.length("text").cast("long").alias("n_chars"), masked.alias("masked_chars"), F.sha2("text", 256).alias("text_sha256")).toPandas().astype(object)
    path = os.path.join(os.environ.get("TMPDIR", "/tmp"), f"conversations-{os.getpid()}.parquet")
    frame.coalesce(1).write.mode("overwrite").parquet(path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/*.parquet'")
    want = db.execute(ORACLES["op10_chat"]).df().astype(object)[list(got.columns)]
    plain = lambda d: sorted(str([None if pd.isna(v) else int(v) if isinstance(v, (int, float)) else v for v in r]) for r in d.itertuples(index=False))
    assert plain(got) == plain(want) and len(got) > 10
    assert "\nuser name=b" not in "".join(r["text"] for r in out.where("conv_id = 1").collect())


def test_vectors_without_components_and_beyond_64_bits(spark):
    empty = spark.createDataFrame([(i, []) for i in range(100)] + [(200, [1.0])], "vec_id long, embedding array<double>")
    got = topk.search(empty, F.col("vec_id") % 50 == 0).collect()
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got} == {(q, k, v, 0 if q != 200 else 0) for q in (0, 50, 200) for k, v in enumerate([x for x in range(7) if x != q][:5], 1)}
    big = spark.createDataFrame([(0, [1e300, 1.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="beyond 64 bits"):
        topk.search(big, F.col("vec_id") % 50 == 0).collect()
    # the product with itself has more than 64 bits, those with others fit
    large = spark.createDataFrame([(0, [1e8, -1e8]), (1, [1e5, 1.0]), (2, [3e5, 2e5])], "vec_id long, embedding array<double>")
    scores = {r["vec_id"]: r["score"] for r in topk.search(large, F.col("vec_id") % 50 == 0).collect()}
    assert scores == {1: 65536 * (10**13 - 10**8), 2: 65536 * 10**13}
    with pytest.raises(Exception, match="a score beyond 64 bits"):
        topk.search(large.withColumn("vec_id", F.col("vec_id") * 50), F.col("vec_id") == 50).union(topk.search(large.unionAll(spark.createDataFrame([(3, [1e8, -1e8])], large.schema)), F.col("vec_id") == 0)).collect()


def test_common_vectors_and_pruned_shards(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 6)) * 4
    rows = [(i, (centres[i % 12] + rng.normal(size=6) * 0.1).tolist()) for i in range(600)] + [(1000 + i, centres[0].tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.search(frame, F.col("vec_id") % 50 == 0, shard_rows=50).collect()}
    q = np.floor(256 * np.array([v for _, v in rows])).astype(np.int64)
    ids = np.array([i for i, _ in rows])
    for a in np.flatnonzero(ids % 50 == 0):
        best = sorted((-int(q[a] @ q[b]), int(ids[b])) for b in range(len(ids)) if ids[b] != ids[a])[:5]
        assert [got[int(ids[a]), k] for k in range(1, 6)] == [(i, -s) for s, i in best]


def test_storage_names():
    assert warc.file_system("file:/a/b")[1] == warc.file_system("file:///a/b")[1] == warc.file_system("/a/b")[1] == "/a/b"
    assert warc.file_system("dbfs:/a")[1] == "/dbfs/a"
    with pytest.raises(ValueError):
        warc.file_system("wasb://x@y/z")
    assert warc.SCHEMES["s3a"] == "s3"
