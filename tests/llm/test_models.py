"""Language, toxicity and secrets on held-out rows and by hand."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronopanel.llm import language, secrets, toxicity


def test_language_model_backs_off():
    model = language.Model([("en", "the weather is with the other"), ("de", "der schnee ist nicht schön"), ("de", "schnell")])
    assert model.languages == ["de", "en"]
    langs, scores = language.predict(model, ["the weather", "schnees", "12 !", None, "", "ZZQ"], language._Rows(model))
    assert langs[:5] == ["en", "de", "und", "und", "und"] and langs[5] in ("de", "en") and scores[2] == 0
    assert all(0 <= s <= 1 for s in scores)


def test_language_of_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = language.identify(docs).join(docs, "doc_id")
    held = got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert held[0] > 0.95 and held[1] > 20
    odd = spark.createDataFrame([(1, None, "en"), (None, "the", "en"), (2, "a", None), (3, "the", "en"), (3, "the", "en")], "doc_id long, text string, lang string")
    assert language.identify(odd).count() == 5
    assert {r["lang_pred"] for r in language.identify(odd.where("lang is null")).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    texts = [[b"w%d" % i for i in rng.integers(0, 20, n)] for n in (40, 5, 32, 0)]
    vocabulary = toxicity.Vocabulary(texts)
    places, owner = vocabulary.windows()
    labels, weights = (owner % 2).astype(np.float32), np.ones(len(owner), np.float32)
    p = {k: v.astype(np.float64) for k, v in toxicity.start(3).items()}
    p = {k: (v * 2 if v.ndim > 1 else v) for k, v in p.items()}

    def loss(q):
        x = vocabulary.inputs(q)
        z = toxicity.forward(q, {d: x @ q[f"W{d}"] + q[f"b{d}"] for d in "fb"}, places)
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    g = toxicity.gradients(p, vocabulary, places, labels, weights)
    for name in ("Wf", "Ub", "bf", "attend", "out", "bias", "words", "chars"):
        at = np.unravel_index(np.argmax(np.abs(g[name])), g[name].shape)
        moved = []
        for step in (1e-3, -1e-3):
            q = {**p, name: p[name].copy()}
            q[name][at] += step
            moved.append(loss(q))
        assert (moved[0] - moved[1]) / 2e-3 == pytest.approx(float(g[name][at]), rel=0.05, abs=1e-4)


def test_windows_cover_every_word():
    v = toxicity.Vocabulary([[b"%d" % i for i in range(n)] for n in (0, 1, 32, 33, 100)])
    places, owner = v.windows()
    for i, own in enumerate(v.texts):
        assert set(places[owner == i].ravel()) - {-1} == set(own.tolist())


def test_toxicity_is_learned(spark):
    rng = random.Random(1)
    text = lambda bad, n: " ".join(["nastyword" + "xyz"[rng.randrange(3)] if bad and j == n // 2 else f"plain{rng.randrange(300)}" for j in range(n)])
    rows = [(i, text(i % 4 == 0, rng.choice([8, 60, 200])), int(i % 4 == 0)) for i in range(400)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(1000, None), (1001, ""), (None, "plain1")], "doc_id long, text string").withColumn("score", F.lit("kept"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(3, None), (5000, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.rate(docs, labels).collect()}
    held = [(got[i]["predicted"], y) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 80 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and len(got) == 403
    clean = toxicity.without_toxic(docs, labels)
    assert clean.columns == docs.columns and 290 < clean.count() < 330
    assert toxicity.rate(docs, labels.where("toxic = 0")).agg(F.max("score")).first()[0] == 0
    assert toxicity.rate(docs.limit(0), labels).count() == 0


def test_secrets(spark):
    key, password, token = "AKIA" + "QZ7RT2LMNB5VXW3K", "b7db7aa4a5fcc78305", "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
    rows = [(1, f"the {key} and password={password} of", "src1"), (2, f'then token = "{token}" goes', "src2"), (3, "the information thenationthereading", "x"), (4, None, "x"), (5, "", None), (6, f"commit {token}", "x"), (6, f"commit {token}", "x"), (None, "see https://example.org/the/reading/station", "tests")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("label", F.lit(0))
    got = secrets.scan(docs).collect()
    kept = {(r["doc_id"], r["candidate"]) for r in got if r["is_secret"]}
    assert {(1, key), (1, password), (2, token)} <= kept
    assert not any(r["is_secret"] for r in got if r["doc_id"] in (3, 6, None))
    first = next(r for r in got if r["candidate"] == password)
    assert first["nth"] == 1 and first["gap"] == len(" and password=")
    assert secrets.scan(docs.limit(0)).count() == 0


def test_forest_on_findings_it_hasn_t_seen(spark):
    model = secrets.train(secrets.labelled_findings(spark))
    fresh = secrets.labelled_findings(spark, 2000, seed=99)
    own = secrets.features(F.col("candidate"), F.col("before"), F.col("after"), F.col("path"))
    from pyspark.ml.feature import VectorAssembler

    table = VectorAssembler(inputCols=list(secrets.FEATURES), outputCol="features").transform(fresh.select("label", *[c.alias(k) for k, c in own.items()]))
    assert model.transform(table).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] > 0.95


def test_secrets_behind_long_names(spark):
    token = "1beb58b8af68854f0e01b4ad40cdbb6ae7f578ae"
    names = [f"aws_secret_access_key={token}", f"aws_secret_access_key = {token}", f'the service_api_access_token="{token}"', f"service_api_access_token: '{token}'", f"last_known_good_commit={token}", f"last_known_good_commit = {token}"]
    docs = spark.createDataFrame(list(enumerate(names)), "doc_id int, text string").withColumn("source", F.lit("src"))
    near = {r["doc_id"]: r for r in secrets.candidates(docs, "doc_id", "text", "source").where(F.col("candidate") == token).collect()}
    assert {i: r["before"] for i, r in near.items()} == {i: x[: x.index(token)] for i, x in enumerate(names)}
    assert {r["doc_id"] for r in secrets.scan(docs).where("is_secret").collect()} == {0, 1, 2, 3}
    one, run = "ab12" * 4, spark.createDataFrame([(1, " ".join(f"{i}{'ab12' * 4}" for i in range(9)), "src")], "doc_id int, text string, source string")
    text = run.first()["text"]
    for r in secrets.candidates(run, "doc_id", "text", "source").collect():
        at = text.index(f"{r['nth']}{one}")
        assert r["gap"] == (r["nth"] > 0) and r["before"] == text[max(0, at - 48):at] and r["after"] == text[at + 17:at + 41]


def test_numerals_are_no_letters_and_long_texts_teach(spark):
    """Languages that only long texts have are learned; texts of numerals have no language."""
    rng = random.Random(3)
    text = lambda words, n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(["le", "chat", "mange", "bien"], 6000), "fr") for i in range(20)] + [(100 + i, text(["the", "cat", "eats", "well"], 20), "en") for i in range(20)]
    rows += [(200, "½ ² Ⅷ ٣", "en"), (201, "le chat ½", None), (202, "the cat", None)]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert {got[i] for i in range(20)} == {"fr"} and {got[100 + i] for i in range(20)} == {"en"} and (got[200], got[201], got[202]) == ("und", "fr", "en")


def test_sparse_rows_are_those_of_all_counts():
    """Against plain logarithms, with many languages of which each has few words."""
    sample = [(f"l{i:03d}", f"w{i} w{i // 2} shared shared") for i in range(60)]
    model = language.Model(sample)
    known, table = model.words
    counts = {lang: {w: t.count(w) for w in t} for lang, t in ((a, re.findall("[a-z]+", b)) for a, b in sample)}
    for word in known:
        want = [math.log((counts[lang].get(word, 0) + 0.5) / (sum(counts[lang].values()) + 0.5 * (len(known) + 1))) for lang in model.languages]
        assert table[known[word]] == pytest.approx(want, abs=1e-6)
    assert table.language.nbytes + table.more.nbytes < 20 * sum(map(len, counts.values()))
