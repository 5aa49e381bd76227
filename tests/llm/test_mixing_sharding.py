"""Mixing and sharding against plain Python."""

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from chronopanel.llm import mixing, sharding

ROWS = [(i, " ".join(["w"] * (i * 7 % 40)), ["b", "a", "c", None][i % 4 if i % 9 else 0]) for i in range(400)] + [(1000, None, "a"), (None, "one two", "a"), (1001, "x y", "d"), (1001, "x y", "d")]


def water(sizes: dict, weights=(5, 2, 1), share=1.5, most=2):
    """Reshare the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    target, left, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not full:
            return target | {s: level * w[s] for s in open_}
        for s in full:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_and_taken(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    got = mixing.mix_plan(docs).collect()
    assert len(got) == len(ROWS)
    sizes, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
        assert r["taken"] <= 2 * r["size"]
    want = water(sizes)
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(want[r["source"]])
    for s in sizes:
        assert abs(taken[s] - want[s]) <= max(longest[s], 1)
    again = mixing.mix_plan(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_repeats_rows_with_all_columns(spark):
    docs = spark.createDataFrame([(i, "a b c", "s", "kept", 1) for i in range(40)], "doc_id long, text string, source string, copies string, target int")
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() == 60
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mix_plan(docs.limit(0)).count() == 0


def check_law(rows, texts, shards):
    assert sorted(r["doc_id"] is None or r["doc_id"] for r in rows) == sorted(i is None or i for i, _ in texts)
    by = defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())


@pytest.mark.parametrize("copies", [0, 2, 130])
def test_shards_are_even_and_groups_whole(spark, copies):
    texts = [(i, f"text {i}") for i in range(190)] + [(500 + i, "the same") for i in range(copies)] + [(900 + i, f"pair {i // 2}") for i in range(40)] + [(2000, None), (2001, None), (2002, ""), (None, "no id")]
    rows = sharding.shard(spark.createDataFrame(texts, "doc_id long, text string"), shards=8).collect()
    check_law(rows, texts, 8)
    text = dict(texts)
    for r in rows:
        raw = (text[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    where = defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert sum(len(where[f"pair {i}"]) == 1 for i in range(20)) >= 18
    assert len(where["the same"]) <= max(1, 130 // 20)


def test_propagation_cuts_fewer_links_within_quotas(spark):
    """Against plain counting: two rings of cliques, and a group larger than a shard."""
    links = [(10 * g + i, 10 * g + j) for g in range(30) for i in range(10) for j in range(i)] + [(10 * g, 10 * g + 10) for g in range(29)]
    links += [(1000, 1000 + i) for i in range(1, 120)]
    nodes = sorted({x for e in links for x in e})
    quotas = [60] * 8
    labels, cuts = sharding.propagate(spark.createDataFrame([(x,) for x in nodes], "node long"), spark.createDataFrame(links, "a long, b long"), quotas, rounds=12)
    where = {r["node"]: r["shard"] for r in labels.collect()}
    assert sorted(where) == nodes and all(sum(s == i for s in where.values()) <= q for i, q in enumerate(quotas))
    assert cuts[-1] == sum(where[a] != where[b] for a, b in links) < 0.4 * cuts[0]


def test_copies_are_linked_by_a_tree(spark, monkeypatch):
    monkeypatch.setattr(sharding, "FAN", 4)
    keys = ["a"] * 60 + ["b"] * 2 + ["c"] + [None] * 5
    links = [tuple(r) for r in sharding.copy_links(spark.createDataFrame(list(enumerate(keys)), "node long, key string"), "key", len(keys)).collect()]
    assert len(links) == 60 and len({x for e in links for x in e}) == 62 and all(keys[a] == keys[b] for a, b in links)
    assert max(sum(x in e for e in links) for x in range(60)) < 20


def test_flows_keep_quotas():
    flows = sharding.accepted_flows({(0, 1): 5, (1, 0): 3, (2, 1): 4, (0, 2): 1}, [0, 2, 0])
    assert flows == {(0, 1): 3, (1, 0): 3, (2, 1): 2}


def test_few_and_no_documents(spark):
    few = [(1, "a"), (2, "a"), (3, None)]
    check_law(sharding.shard(spark.createDataFrame(few, "doc_id long, text string"), shards=5).collect(), few, 5)
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), shards=5).count() == 0


def plain_propagation(hashes, links, quotas, rounds):
    """The rounds in plain Python; hashes has, for each node, Spark's hash of it alone, with -1, and with each round."""
    shards = len(quotas)
    near = {}
    for a, b in links:
        near.setdefault(a, []).append(b)
        near.setdefault(b, []).append(a)
    order = sorted(hashes, key=lambda x: (hashes[x][None] % sharding.BUCKETS, x))
    label = {x: i % shards for i, x in enumerate(order)}
    cut = lambda: sum(label[a] != label[b] for a, b in links)
    cuts, idle = [cut()], 0
    for turn in range(rounds):
        wishes = {}
        for x in hashes:
            if x in near and hashes[x][turn] % 2 == 0:
                votes = Counter(label[y] for y in near[x])
                n, _, _, to = max((n, s == label[x], (s + hashes[x][None]) % shards, s) for s, n in votes.items())
                if to != label[x] and n > votes[label[x]]:
                    wishes.setdefault((label[x], to), []).append((-min(15, n - votes[label[x]]), hashes[x][-1] % 16, x))
        held = Counter(label.values())
        flows = sharding.accepted_flows({k: len(v) for k, v in wishes.items()}, [q - held[i] for i, q in enumerate(quotas)])
        if not flows:
            if (idle := idle + 1) == 2:
                break
            continue
        idle = 0
        for pair, n in flows.items():
            label |= {x: pair[1] for _, _, x in sorted(wishes[pair])[:n]}
    return label, [*cuts, cut()]


def test_propagation_is_that_of_plain_python(spark):
    rng = random.Random(8)
    links = [(g * 100 + i, g * 100 + rng.randrange(i)) for g in range(30) for i in range(1, rng.randrange(2, 12))] + [(rng.randrange(5) * 100, 1 + rng.randrange(5) * 100) for _ in range(6)]
    links = [(a, b) for a, b in links if a != b]
    nodes = sorted({x for p in links for x in p})
    quotas = [len(nodes) // 7 + 2] * 7
    frame = spark.createDataFrame([(x,) for x in nodes], "node long")
    turns = range(6)
    hashed = frame.select("node", F.xxhash64("node").alias("own"), F.xxhash64("node", F.lit(-1)).alias("last"), *[F.xxhash64("node", F.lit(t)).alias(f"t{t}") for t in turns]).collect()
    hashes = {r["node"]: {None: r["own"], -1: r["last"], **{t: r[f"t{t}"] for t in turns}} for r in hashed}
    labels, cuts = sharding.propagate(frame, spark.createDataFrame(links, "a long, b long"), quotas, rounds=len(turns))
    want, want_cuts = plain_propagation(hashes, links, quotas, len(turns))
    assert {r["node"]: r["shard"] for r in labels.collect()} == want and cuts == want_cuts and cuts[1] < cuts[0] / 3


def test_links_of_copies_start_cut_and_end_whole(spark, sf):
    row = sharding.op5_sharding(spark, sf).select("links", "cut_before", "cut_after").first()
    assert row["links"] > 3 and row["cut_before"] > 0.8 * row["links"] and row["cut_after"] < 0.1 * row["links"]
