"""The n-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest

from chronopanel.llm import jaccard


def features(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def all_pairs(rows, n, percent):
    sets = [features(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                parent[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [(d, len(s), best.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def near_copies(rng, base, count, most):
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    new = lambda n: [f"v{rng.randrange(4000)}" for _ in range(n)]
    texts = [" ".join(new(rng.choice([1, 2, 3, 4, 9, 30, 120, 700]))) for _ in range(120)]
    texts += near_copies(rng, new(150), 60, 14) + near_copies(rng, new(60), 30, 4) + near_copies(rng, new(900), 12, 40)
    passage = " ".join(new(60))
    texts += [f"{' '.join(new(rng.choice([2, 20, 100])))} {passage}" for _ in range(40)]
    texts += ["Same\tText here", "same text  HERE", "", None, " \n", "x", "X", "É x", "é x", "a b", "a b"]
    out = list(enumerate(texts))
    rng.shuffle(out)
    return [*out, (3, out[5][1]), (None, out[6][1]), (None, "nobody else")]


@pytest.mark.parametrize(("n", "percent", "n2", "k2"), [(3, 90, 3, 1), (5, 80, 2, 1), (2, 70, 4, 2)])
def test_components(spark, rows, n, percent, n2, k2):
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=n, percent=percent, n2=n2, k2=k2).collect()
    assert sorted(map(str, [(r["id"], r["n_shingles"], r["component_id"]) for r in got])) == sorted(map(str, all_pairs(rows, n, percent)))


def test_small_blocks_give_the_same(spark, rows, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_FEATURES", 2000)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 1000)
    got = jaccard.join_components(spark.createDataFrame(rows, "doc_id long, text string"), n=3, percent=90).collect()
    assert sorted(map(str, [(r["id"], r["n_shingles"], r["component_id"]) for r in got])) == sorted(map(str, all_pairs(rows, 3, 90)))


@pytest.mark.parametrize(("percent", "n2", "k2"), [(90, 3, 1), (80, 2, 1), (70, 4, 2)])
def test_no_linked_pair_is_without_a_common_signature(percent, n2, k2):
    rng, scheme = np.random.default_rng(1), jaccard.PartEnum(percent, n2, k2)
    for size in [*range(1, 60), 200, 1000]:
        a = np.unique(rng.integers(0, 2**63, size, dtype=np.uint64))
        for _ in range(20):
            # as far apart as links may be: some features dropped, others added
            drop = rng.integers(0, size + 1)
            b = np.union1d(a[rng.permutation(len(a))[drop:]], rng.integers(0, 2**63, rng.integers(0, size + 1), dtype=np.uint64))
            common = len(np.intersect1d(a, b))
            if len(b) and 100 * common >= percent * (len(a) + len(b) - common):
                s, place = scheme.of([a, b])
                assert set(s[place == 0]) & set(s[place == 1])


def test_sets_of_any_size_a_text_can_hold_have_a_band():
    scheme = jaccard.PartEnum(90, 3, 1)
    assert all(scheme.high[scheme.bands(size)[0]] >= size for size in [1, 1 << 20, (1 << 26) + 1, 1 << 31])


def test_signatures_of_one_set_are_not_dealt_by_ranges(spark, monkeypatch):
    seen, stars = [], jaccard._stars
    monkeypatch.setattr(jaccard, "_stars", lambda signatures: seen.append(signatures.count()) or stars(signatures))
    rng = random.Random(4)
    texts = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(300)) for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate([*texts, *texts])), "doc_id long, text string").repartition(6)
    got = jaccard.join_components(frame, n=5, percent=80).collect()
    assert sorted((r["id"], r["component_id"]) for r in got) == [(i, i % 60) for i in range(120)]
    assert seen == [0]  # copies have one name, and no two sets have a signature in common


@pytest.mark.parametrize("bins", [1, 3, 1000])
def test_signatures_that_sets_share_are_kept(spark, rows, bins):
    scheme = jaccard.PartEnum(80, 3, 1)
    frame = spark.createDataFrame([(d, i, t) for i, (d, t) in enumerate(rows)], "id long, check long, text string").repartition(5)
    packed = jaccard.signed(frame, 5, scheme, bins)
    got = jaccard._shared(packed).collect()
    sets = {jaccard.vertex(x): x for x in jaccard.shingle_sets([t for _, t in rows], 5) if len(x)}
    s, place = scheme.of(list(sets.values()))
    members = {}
    for x, v in zip(s.tolist(), np.array(list(sets))[place].tolist(), strict=True):
        members.setdefault(x, set()).add(v)
    found = {}
    for r in got:
        found.setdefault(r["s"], set()).update({r["v"], r["root"]} - {None})
    assert found == {x: own for x, own in members.items() if len(own) > 1}
    assert packed.agg({"bin": "max"}).first()[0] < bins


def test_members_of_signatures_hang_together(spark):
    rng = random.Random(2)
    # one signature of most rows, one set of very many copies, and rare ones, over many partitions
    rows = [(rng.choice([7, 7, 7, rng.randrange(100, 400)]), rng.choice([1, rng.randrange(60)]), None, rng.randrange(65_536)) for _ in range(4000)] + [(9, 5, 3, 1), (9, 3, None, 1), (9, 2, None, 2), (9, 8, 2, 2)]
    frame = spark.createDataFrame(rows, "s long, v long, root long, c long")
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "50")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stars = [tuple(r) for r in jaccard._stars(frame).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    members, tied = {}, {}
    for s, v, root, _ in rows:
        members.setdefault(s, set()).update({v} if root is None else {v, root})
    for s, v, root in stars:
        tied.setdefault(s, []).append((v, root))
    for s, own in members.items():
        reached, grown = {min(own)}, True
        while grown:
            more = {x for pair in tied.get(s, ()) if reached & set(pair) for x in pair} - reached
            reached, grown = reached | more, bool(more)
        assert reached == own, s


def test_one_of_each(spark, rows):
    rows = [*rows[:-3], rows[7], *rows[-2:]]  # a repeated row; no id of two components
    frame = spark.createDataFrame([(t, d, "x") for d, t in rows], "text string, doc_id long, component_id string")
    kept = jaccard.one_of_each(frame)
    assert kept.columns == frame.columns
    want = all_pairs(rows, 5, 80)
    texts = [t for _, t in rows]
    components = {c for (d, n, c), t in zip(want, texts, strict=True) if n and c is not None}
    empty = sum(1 for _, n, _ in want if not n)
    nameless = len({t for (d, n, c), t in zip(want, texts, strict=True) if n and c is None})
    assert kept.count() == len(components) + empty + nameless


def test_empty_table(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.join_components(none).count() == 0 and jaccard.one_of_each(none).count() == 0
