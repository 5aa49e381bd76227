"""N-gram Jaccard join by PartEnum signatures, and the components of its links.

A document's set holds its distinct shingles of n words (hashed to 64 bits); documents link at ``100 * common >= percent *
union``. Documents with equal sets are one vertex, named by 64 bits of a hash; where another hash tells that two sets have
one name, all sets of that name are named anew, so that sets count as equal only if 128 bits are.

Signatures. Sets of a band of sizes [low, high] that link differ in at most ``k = (100 - percent) * 2 * high / (100 +
percent)`` features. The feature domain is hashed into n1 parts and each of these into n2; a signature is the projection on
n2 - k2 of the n2. Two sets that differ in k features at most have n1 - k // (k2 + 1) parts at least in which they differ in k2
features at most, and in each of these share a signature. n1 is ``spread`` times what the method needs, so linked sets share
more than one, say g; then each set may leave out its g - 1 smallest projections (all below one size, so that equal
projections are left out by both), and no link is lost: this removes the projections of no or one feature that
unrelated documents have in common. A set also signs for the next band if it can link into it.

Links. Vertices that share a signature are compared in two rounds, both in groups of bounded size. The first compares
sketches, histograms of the features' hashes of about a byte for eight features: sets differ in as many features at least as their
histograms do, so pairs whose histograms are too far apart are no links. There a signature's members meet one of them first (those that are
signed together one of their own, and only these the one of all), and one another only where that leaves them unconnected. The pairs that remain make families. The second
compares the sets themselves, each sent once for its family. Either round passes over pairs that are connected
already, and only what joins two components leaves a group, so a group of near copies never becomes a row for each pair, and
no pair of a shared signature is skipped unless it is connected. Thus components are exact.

Nulls, ties, and so on: texts that are null or have no words have the empty set and link with nothing; with fewer than n
words the whole sequence is the one shingle; a null id takes part but never names a component that has another id; repeated
rows are copies; a very long text is hashed piece by piece, but its set is held as a whole, 8 bytes a word; an empty table gives an empty
result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronopanel.llm.shared import hashed_words, mixed, released, windows
from chronopanel.sources.tables import temporary, written

#: Characters of text that are worked on together.
CHUNK_CHARS = 3_000_000
#: Features in a block of sets that are compared with one another.
BLOCK_FEATURES = 1 << 22
#: Bytes of sketches in one.
BLOCK_BYTES = 1 << 25
#: Bins of the histograms that bound differences of sets, and of the smallest sketch.
BINS, LEAST_BINS = 256, 64
#: Members of a signature up to which all its pairs are listed, and pairs that are listed together.
SMALL_BUCKET, PAIRS_TOGETHER = 64, 2_000_000
#: Bits of a signature, whole bytes; a collision only costs a comparison.
SIGNATURE_BITS = 48
#: Features whose signatures are searched together for those that sets share, about.
MEETING_FEATURES = 1 << 21
#: Names that several sets may have before they are named anew.
MOST_CLASHES = 1_000_000


def shingle_sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    """The sorted set of each text's shingles."""
    words, starts = hashed_words(texts)
    whole = windows(words, n)
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        own = whole[a : b - n + 1] if b - a >= n else windows(words[a:b], b - a) if b > a else whole[:0]
        own = np.sort(own)
        out.append(own[np.diff(own, prepend=~own[:1]) != 0] if len(own) else own)
    return out


def vertex(features: np.ndarray, bits: int = 64, clashes: frozenset[int] = frozenset()) -> int | None:
    """What names a set: a hash of it, and another one where sets clash in the first; None for the empty one."""
    if not len(features):
        return None
    name = xxhash.xxh3_64_intdigest(features.tobytes()) & ((1 << bits) - 1)
    signed = int(np.uint64(name).astype(np.int64))
    return _witness(features, 2) if signed in clashes else signed


def _witness(features: np.ndarray, seed: int = 1) -> int:
    """A hash apart from the name's."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(features.tobytes(), seed)).astype(np.int64))


def sketch(features: np.ndarray) -> bytes:
    """A histogram of the features' hashes: a power of two of bins, one for eight features at least, of a byte each."""
    bins = LEAST_BINS
    while 8 * bins < len(features):
        bins *= 2
    return np.minimum(np.bincount((features >> np.uint64(40) & np.uint64(bins - 1)).astype(np.int64), minlength=bins), 255).astype(np.uint8).tobytes()


class PartEnum:
    """Signatures for one threshold."""

    def __init__(self, percent: int, n2: int, k2: int, spread: float = 1.25, largest: int = 1 << 31):
        self.percent, self.n2, self.k2 = percent, n2, k2
        self.subsets = list(combinations(range(n2), n2 - k2))
        self.low, high = [1], []
        while self.low[-1] <= largest:
            # as wide as two steps of the threshold: a set signs for one band and a half on average
            high.append(max(self.low[-1] * 10_000 // (percent * percent), self.low[-1]))
            self.low.append(high[-1] + 1)
        self.high = np.array(high)
        self.k = (100 - percent) * 2 * self.high // (100 + percent)
        least = self.k // (k2 + 1) + 1
        self.n1 = np.where(self.k == 0, 1, np.ceil(least * spread).astype(np.int64))
        self.spare = self.n1 - least  # g - 1

    def bands(self, size: int) -> list[int]:
        band = int(np.searchsorted(self.high, size))
        return [band, band + 1] if 100 * size // self.percent > self.high[band] else [band]

    def of(self, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of non-empty sets, and the place of each one's set in the list."""
        entries = [(i, b) for i, x in enumerate(sets) for b in self.bands(len(x))]
        if not entries:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        owner, band = np.array(entries).T
        sizes = np.array([len(x) for x in sets])[owner]
        parts = self.n1[band]
        starts = np.concatenate([[0], np.cumsum(parts)])
        features = np.concatenate([sets[i] for i in owner])
        entry = np.repeat(np.arange(len(owner)), sizes)
        spread = mixed(features ^ np.uint64(0x5851F42D4C957F2D))
        cell = (starts[entry] + ((spread >> np.uint64(32)) % parts[entry].astype(np.uint64)).astype(np.int64)) * self.n2
        cell += ((spread & np.uint64(0xFFFFFFFF)) % np.uint64(self.n2)).astype(np.int64)
        sums = np.zeros(starts[-1] * self.n2, np.uint64)
        np.add.at(sums, cell, mixed(features + np.uint64(0x9E3779B97F4A7C15)))
        counts = np.bincount(cell, minlength=len(sums)).reshape(-1, self.n2)
        sums = sums.reshape(-1, self.n2)
        part_entry = np.repeat(np.arange(len(owner)), parts)
        place = np.arange(starts[-1]) - starts[part_entry]
        tag = mixed(band[part_entry].astype(np.uint64) << np.uint64(40) | place.astype(np.uint64))
        signatures, weights = [], []
        for j, subset in enumerate(self.subsets):
            chosen = list(subset)
            total = sums[:, chosen].sum(1, dtype=np.uint64) if len(chosen) == 1 else sum(mixed(sums[:, c] + np.uint64(c + 1)) for c in chosen)
            signatures.append(mixed(total ^ mixed(tag + np.uint64(j))))
            weights.append(counts[:, chosen].sum(1))
        signature, weight, by = np.concatenate(signatures), np.concatenate(weights), np.tile(part_entry, len(self.subsets))
        # each entry leaves out its smallest projections, up to its spare ones, but never some of one size and not others
        order = np.lexsort((weight, by))
        signature, weight, by = signature[order], weight[order], by[order]
        first = np.searchsorted(by, np.arange(len(owner)))
        least = weight[first + self.spare[band]]  # all below this are at most the spare ones
        kept = weight >= least[by]
        return (signature[kept] >> np.uint64(64 - SIGNATURE_BITS)).astype(np.int64), owner[by[kept]]


def _chunks(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[list]]:
    """The columns' values, in chunks of CHUNK_CHARS of the last one, which is text."""
    held: list[list] = [[] for _ in columns]
    size = 0
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            for x, v in zip(held, row, strict=True):
                x.append(v)
            size += len(row[-1] or "")
            if size >= CHUNK_CHARS:
                yield held
                held, size = [[] for _ in columns], 0
    yield held


def named(docs: DataFrame, n: int, bits: int = 64, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """Of rows (id, check, text): a row (id, check, n, w, sketch, v) for each, v naming its set (null where empty)."""
    id_type = docs.schema["id"].dataType

    def run(batches):
        for ids, checks, texts in _chunks(batches, ["id", "check", "text"]):
            sets = shingle_sets(texts, n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, to_arrow_type(id_type)), pa.array(checks, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([_witness(x) for x in sets], pa.int64()), pa.array([sketch(x) for x in sets], pa.binary()), pa.array([vertex(x, bits, clashes) for x in sets], pa.int64())],
                ["id", "check", "n", "w", "sketch", "v"],
            )

    return docs.mapInArrow(run, f"id {id_type.simpleString()}, check long, n long, w long, sketch binary, v long")


def _packed(s: np.ndarray) -> bytes:
    """Signatures without the bytes that they don't fill."""
    return s.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : SIGNATURE_BITS // 8].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    own = np.frombuffer(data, np.uint8).reshape(-1, SIGNATURE_BITS // 8)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, : SIGNATURE_BITS // 8] = own
    return out.view("<i8").ravel()


def signed(docs: DataFrame, n: int, scheme: PartEnum, bins: int, bits: int = 64, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """Of rows (id, check, text): signatures of their sets as packed rows (bin, c, s, v, times, root), c a small number of the chunk. Copies in a chunk sign once.

    Of the sets of a chunk that share a signature, the one with the least name has no root: in a row for each bin of signatures are those s of
    sets without one, ``times`` of them for each v. The others, and their roots, are in a row of a bin below 0, which is the chunk's.
    """

    def run(batches):
        for ids, checks, texts in _chunks(batches, ["id", "check", "text"]):
            chunk = xxhash.xxh64_intdigest(repr((ids[:1], checks[:1]))) % 65_536
            sets = shingle_sets(texts, n)
            distinct = {v: x for x in sets if (v := vertex(x, bits, clashes)) is not None}
            s, place = scheme.of(list(distinct.values()))
            if not len(s):
                continue
            v = np.array(list(distinct), np.int64)[place]
            order = np.lexsort((v, s))
            s, v = s[order], v[order]
            first = np.concatenate([[True], s[1:] != s[:-1]])
            root = v[first][np.cumsum(first) - 1]
            out = []
            if (others := v != root).any():
                out.append((-1 - chunk % bins, _packed(s[others]), v[others].tobytes(), None, root[others].tobytes()))
            s, v = s[first], v[first]
            bin_ = s % bins
            order = np.lexsort((v, bin_))
            s, v, bin_ = s[order], v[order], bin_[order]
            runs = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (bin_[1:] != bin_[:-1])]))
            names, times = v[runs], np.diff(np.append(runs, len(s))).astype(np.uint32)
            cuts = np.flatnonzero(np.concatenate([[True], bin_[1:] != bin_[:-1], [True]]))
            at = np.searchsorted(runs, cuts)
            for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
                out.append((int(bin_[i]), _packed(s[i:j]), names[at[k] : at[k + 1]].tobytes(), times[at[k] : at[k + 1]].tobytes(), None))
            binned, *packed = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(binned, pa.int64()), pa.array([chunk] * len(out), pa.int64()), *[pa.array(x, pa.binary()) for x in packed]], ["bin", "c", "s", "v", "times", "root"])

    return docs.mapInArrow(run, "bin long, c long, s binary, v binary, times binary, root binary")


def _shared(packed: DataFrame) -> DataFrame:
    """Rows (s, v, root, c) of the signatures that two sets have: of :func:`signed`, all with a root, and those without one that two chunks have for different sets.

    Nearly all signatures are of one set only and end here, so what is exchanged of them is packed, and they are written nowhere. A signature comes once from a chunk.
    """

    def run(table: pa.Table) -> pa.Table:
        s = [_unpacked(x) for x in table.column("s").to_pylist()]
        v = [np.frombuffer(x, np.int64) for x in table.column("v").to_pylist()]
        c = np.repeat(table.column("c").to_numpy(), [len(x) for x in s])
        if table.column("bin")[0].as_py() < 0:
            root = [np.frombuffer(x, np.int64) for x in table.column("root").to_pylist()]
            return pa.table({"s": np.concatenate(s), "v": np.concatenate(v), "root": np.concatenate(root), "c": c})
        v = np.concatenate([np.repeat(x, np.frombuffer(t, np.uint32)) for x, t in zip(v, table.column("times").to_pylist(), strict=True)])
        s = np.concatenate(s)
        order = np.argsort(s, kind="stable")
        s, v, c = s[order], v[order], c[order]
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        kept = np.repeat(np.minimum.reduceat(v, starts) != np.maximum.reduceat(v, starts), np.diff(np.append(starts, len(s))))
        return pa.table({"s": s[kept], "v": v[kept], "root": pa.nulls(int(kept.sum()), pa.int64()), "c": c[kept]})

    return packed.groupBy("bin").applyInArrow(run, "s long, v long, root long, c long")


def components(edges: DataFrame) -> DataFrame:
    """(v, label) for every vertex of edges (a, b): the least vertex that it reaches. Contracts the graph until no edge is left."""
    edges = written(edges.where("a <> b").distinct(), "edges")
    nodes = edges.select(F.col("a").alias("v")).unionAll(edges.select(F.col("b").alias("v"))).distinct()
    labels = nodes.withColumn("label", F.col("v"))
    while not edges.isEmpty():
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("p"))
        to = written(to, "pointers")
        next_ = to.select(F.col("a").alias("p"), F.col("p").alias("q"))
        # a vertex points at a smaller one; follow two pointers further
        to = written(to.join(next_, "p").select("a", F.col("q").alias("p")).join(next_, "p").select("a", F.col("q").alias("p")), "pointers")
        labels = written(labels.join(to.withColumnRenamed("a", "label"), "label", "left").select("v", F.coalesce("p", "label").alias("label")), "labels")
        moved = edges.join(to, "a").select(F.col("p").alias("x"), "b").join(to.select(F.col("a").alias("b"), F.col("p").alias("y")), "b")
        edges = written(moved.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        released(edges.sparkSession)
    return labels


def _folded(table: np.ndarray, bins: int) -> np.ndarray:
    """Histograms of fewer bins: bins are low bits of the hash, so halves add up."""
    while table.shape[1] > bins:
        half = table.shape[1] // 2
        table = table[:, :half] + table[:, half:]
    return table


class Group:
    """Sets that share signatures in one group, their histograms, and what is connected so far."""

    def __init__(self, percent: int, v: np.ndarray, sizes: np.ndarray, histograms: list[np.ndarray]):
        self.percent, self.v, self.sizes = percent, v, sizes
        self.parent = list(range(len(v)))
        self.bins = np.array([len(x) for x in histograms])
        self.tables, self.place = {}, np.zeros(len(v), np.int64)
        for bins in np.unique(self.bins).tolist():
            own = np.flatnonzero(self.bins == bins)
            self.place[own] = np.arange(len(own))
            self.tables[bins] = np.stack([histograms[x] for x in own]).astype(np.int16)

    def near(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs (i, j), those that may be links by their sizes and histograms."""
        most = (100 - self.percent) * (self.sizes[i] + self.sizes[j]) // (100 + self.percent)
        kept = np.abs(self.sizes[i] - self.sizes[j]) <= most
        i, j, most = i[kept], j[kept], most[kept]
        good = np.zeros(len(i), bool)
        for a in self.tables:
            for b in self.tables:
                own = np.flatnonzero((self.bins[i] == a) & (self.bins[j] == b))
                step = max(1, (1 << 23) // max(a, b))
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    x, y = _folded(self.tables[a][self.place[i[part]]], min(a, b)), _folded(self.tables[b][self.place[j[part]]], min(a, b))
                    good[part] = np.abs(x - y).sum(1, dtype=np.int64) <= most[part]
        return i[good], j[good]

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def linked(self, i: int, j: int) -> bool:
        """Whether a pair that may be a link is taken for one."""
        return True

    def links(self, i: np.ndarray, j: np.ndarray) -> Iterator[tuple[int, int]]:
        """Links among pairs that join what isn't connected."""
        for x, y in zip(*(k.tolist() for k in self.near(i, j)), strict=True):
            a, b = self.root(x), self.root(y)
            if a != b and self.linked(x, y):
                self.parent[b] = a
                yield int(self.v[x]), int(self.v[y])


class Sketched(Group):
    """Sketches: pairs that may be links."""


class Whole(Group):
    """Sets: pairs that are links."""

    def __init__(self, percent, v, sizes, sets):
        self.sets = sets
        super().__init__(percent, v, sizes, [np.bincount((x.view(np.uint64) >> np.uint64(11) & np.uint64(BINS - 1)).astype(np.int64), minlength=BINS) for x in sets])

    def linked(self, i: int, j: int) -> bool:
        common = len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True))
        return 100 * common >= self.percent * (self.sizes[i] + self.sizes[j] - common)


def _maybe(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b), those whose sketches let them be links."""
    side = lambda c: sketches.select(F.col("v").alias(c), F.col("n").alias(f"n_{c}"), F.col("payload").alias(f"p_{c}"))

    def run(batches):
        for batch in batches:
            k = batch.num_rows
            sizes = np.concatenate([batch.column(c).to_numpy() for c in ("n_a", "n_b")])
            histograms = [np.frombuffer(x, np.uint8) for c in ("p_a", "p_b") for x in batch.column(c).to_pylist()]
            i, _ = Group(percent, np.arange(2 * k), sizes, histograms).near(np.arange(k), np.arange(k) + k) if k else ([], [])
            kept = np.zeros(k, bool)
            kept[i] = True
            yield batch.select(["a", "b"]).filter(pa.array(kept))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _pairs(place: np.ndarray, cuts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of each bucket, place[cuts[k] : cuts[k + 1]]: those of all small buckets together and once, then of large ones a row at a time."""
    sizes, held, size = np.diff(cuts), [], 0

    def distinct():
        codes = np.unique(np.concatenate(held))
        return codes >> 32, codes & 0xFFFFFFFF

    for m in np.unique(sizes[(sizes > 1) & (sizes <= SMALL_BUCKET)]).tolist():
        x, y = np.triu_indices(m, 1)
        starts = cuts[:-1][sizes == m]
        step = max(1, PAIRS_TOGETHER // len(x))
        for at in range(0, len(starts), step):
            rows = np.sort(place[starts[at : at + step, None] + np.arange(m)], 1)
            held.append((rows[:, x] << 32 | rows[:, y]).ravel())
            size += len(held[-1])
            if size > PAIRS_TOGETHER:
                yield distinct()
                held, size = [], 0
    if held:
        yield distinct()
    seen: dict[int, list[np.ndarray]] = {}
    for k in np.flatnonzero(sizes > SMALL_BUCKET).tolist():
        own = np.unique(place[cuts[k] : cuts[k + 1]])
        for i in own.tolist():
            seen.setdefault(i, []).append(own)
    for i, buckets in seen.items():
        others = np.unique(np.concatenate([b[np.searchsorted(b, i, "right") :] for b in buckets]))
        if len(others):
            yield np.full(len(others), i), others


def _met(members: DataFrame, payload: DataFrame, kind: type[Group], percent: int, limit: int) -> DataFrame:
    """Pairs (a, b) that join components among the members (s, v, family) of each signature.

    payload is (v, n, payload). A family that fits ``limit`` payload entries goes into one group whole, and small ones share
    groups; a larger one is dealt by signature into as many parts as its members fill; and a signature that is too large by itself is dealt
    into blocks of which each two meet. Where family is null, signatures alone are dealt.
    """
    length = F.length if kind is Sketched else F.size
    members = written(members.join(payload.select("v", length("payload").cast("long").alias("size")), "v"), "jaccard-members")
    total = members.agg(F.sum("size")).first()[0] or 0
    bins = max(1, 2 * total // limit)
    large = members.groupBy("s").agg(F.sum("size").alias("own")).where(F.col("own") > limit)
    dealt = members.join(large, "s", "left")
    if kind is Whole:
        families = members.groupBy("family").agg(F.sum("size").alias("filled"))
        families = families.join(members.select("family", "v", "size").distinct().groupBy("family").agg(F.sum("size").alias("held")), "family")
        bins = max(1, 2 * (families.agg(F.sum("held")).first()[0] or 0) // limit)
        dealt = dealt.join(families, "family")
    dealt = dealt.withColumn("blocks", F.coalesce(F.ceil(F.col("own") / limit), F.lit(1)).cast("int")).withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    bin_ = F.when(F.col("blocks") > 1, F.concat_ws("/", F.lit("s"), "s", F.least("block", "other"), F.greatest("block", "other")))
    if kind is Whole:
        bin_ = bin_.when(F.col("held") > limit, F.concat_ws("/", F.lit("f"), "family", F.pmod(F.xxhash64("s"), F.ceil(F.col("filled") / limit))))
    shared = F.pmod(F.xxhash64("family" if kind is Whole else "s"), F.lit(bins)).cast("string")
    dealt = written(dealt.select(bin_.otherwise(shared).alias("bin"), "s", "v", "block"), "jaccard-dealt")
    sort = payload.schema["payload"].dataType.simpleString()
    needed = dealt.select("bin", "v").distinct().join(payload, "v").select("bin", F.lit(None).cast("long").alias("s"), "v", F.lit(0).alias("block"), "n", "payload")
    rows = dealt.select("bin", "s", "v", "block", F.lit(None).cast("long").alias("n"), F.lit(None).cast(sort).alias("payload")).unionAll(needed)

    def run(table: pa.Table) -> pa.Table:
        is_set = table.column("s").is_null().to_numpy()
        own = table.filter(pa.array(is_set)).combine_chunks()
        values = own.column("payload").combine_chunks()
        values = values.chunk(0) if isinstance(values, pa.ChunkedArray) else values
        if kind is Whole:
            offsets, flat = values.offsets.to_numpy(), values.values.to_numpy()
            payload = [flat[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]
        else:
            payload = [np.frombuffer(x, np.uint8) for x in values.to_pylist()]
        order = np.argsort(own.column("v").to_numpy())
        v, sizes = own.column("v").to_numpy()[order], own.column("n").to_numpy()[order]
        rest = table.filter(pa.array(~is_set)).sort_by([("s", "ascending")])
        s, place = rest.column("s").to_numpy(), np.searchsorted(v, rest.column("v").to_numpy())
        blocks = np.zeros(len(v), np.int64)
        blocks[place] = rest.column("block").to_numpy()
        group = kind(percent, v, sizes, [payload[i] for i in order])
        cuts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1], [True]]))
        across = len(np.unique(blocks)) > 1
        out = []
        for i, j in _pairs(place, cuts):
            if across:  # pairs within a block are compared elsewhere
                apart = blocks[i] != blocks[j]
                i, j = i[apart], j[apart]
            out += group.links(i, j)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    return rows.groupBy("bin").applyInArrow(run, "a long, b long")


def _stars(signatures: DataFrame) -> DataFrame:
    """Rows (s, v, root) that tie all members of a signature together, from its rows (s, v, root, c) of chunks, of which some have no root yet.

    Those are dealt by ranges of (s, v, c), so that a frequent signature, or a set with very many copies, is spread over partitions. In each, a signature's
    least member is the root of the others; only the first and last signatures of a partition can go on in others, and these few meet once more.
    """
    dealt = signatures.where("root is null").select("s", "v", "c").repartitionByRange("s", "v", "c").sortWithinPartitions("s", "v")

    def run(batches):
        first = last = root = None
        for batch in batches:
            s, v = batch.column("s").to_numpy(), batch.column("v").to_numpy()
            if not len(s):
                continue
            starts = np.concatenate([[s[0] != last], s[1:] != s[:-1]])
            at = np.maximum.accumulate(np.where(starts, np.arange(len(s)), -1))
            roots = np.where(at < 0, v[0] if root is None else root, v[at])
            if first is None:
                first = s[0]
                yield pa.RecordBatch.from_arrays([pa.array(s[:1]), pa.array(v[:1]), pa.nulls(1, pa.int64())], ["s", "v", "root"])
            others = v != roots
            yield pa.RecordBatch.from_arrays([pa.array(s[others]), pa.array(v[others]), pa.array(roots[others])], ["s", "v", "root"])
            last, root = s[-1], roots[-1]
        if last != first:
            yield pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([root], pa.int64()), pa.nulls(1, pa.int64())], ["s", "v", "root"])

    met = written(dealt.select("s", "v").mapInArrow(run, "s long, v long, root long"), "jaccard-met")
    edges = met.where("root is null").withColumn("root", F.min("v").over(Window.partitionBy("s"))).where("v <> root")
    return signatures.where("root is not null").select("s", "v", "root").unionAll(met.where("root is not null")).unionAll(edges)


def _rows(docs: DataFrame, n: int, scheme: PartEnum, bits: int) -> tuple[DataFrame, DataFrame]:
    """The documents of :func:`named` and the members (s, v, root) of signatures that sets share.

    Sets that clash in a name are named anew until no name has two sets. Texts are read once for names and once for signatures, since all
    signatures as a table, beside their exchange, would take several times the disk of the texts.
    """
    clashes: frozenset[int] = frozenset()
    while True:
        documents = written(named(docs, n, bits, clashes), "jaccard-documents")
        clashing = documents.where("v is not null").groupBy("v").agg(F.min("w").alias("a"), F.max("w").alias("b")).where("a <> b")
        found = [r["v"] for r in clashing.select("v").limit(MOST_CLASHES + 1).collect()]
        if len(found) > MOST_CLASHES:
            raise ValueError("too many sets of one name")
        if not found:
            break
        clashes = clashes | frozenset(found)
    features = documents.agg(F.sum("n")).first()[0] or 0
    shared = written(_shared(signed(docs, n, scheme, 1 + features // MEETING_FEATURES, bits, clashes)), "jaccard-shared")
    released(docs.sparkSession)
    return documents, written(_stars(shared), "jaccard-stars")


def join_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3, percent: int = 90, n2: int = 3, k2: int = 1, bits: int = 64) -> DataFrame:
    """Per row of docs: id, check (a hash of the text), n_shingles, v (its set), component_id, kept (one row in each component)."""
    docs = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("check"), F.col(text_col).alias("text"))
    with temporary(docs.sparkSession):
        return written(_components(docs, *_rows(docs, n, PartEnum(percent, n2, k2), bits), n, percent), "jaccard-result", keep=True)


def _components(docs: DataFrame, documents: DataFrame, stars: DataFrame, n: int, percent: int) -> DataFrame:
    released(docs.sparkSession)
    meta = documents.drop("sketch", "w")
    sketches = documents.where("v is not null").groupBy("v").agg(F.first("n").alias("n"), F.first("sketch").alias("payload"))
    # all of a signature meet its roots first; where that connects them, nothing is left to compare
    pairs = written(stars.select(F.col("v").alias("a"), F.col("root").alias("b")).distinct(), "jaccard-pairs")
    near = written(_maybe(pairs, sketches, percent), "jaccard-near")
    connected = components(near)
    label = lambda c: connected.select(F.col("v").alias(c), F.col("label").alias(f"label_{c}"))
    apart = F.coalesce("label_a", "a") != F.coalesce("label_b", "b")
    open_pairs = pairs.join(label("a"), "a", "left").join(label("b"), "b", "left").where(apart).select(F.col("a").alias("v"), F.col("b").alias("root"))
    open_signatures = stars.join(open_pairs, ["v", "root"], "left_semi").select("s").distinct()
    open_stars = written(stars.join(open_signatures, "s", "left_semi"), "jaccard-open")
    released(docs.sparkSession)
    rest = open_stars.select("s", "v").unionAll(open_stars.select("s", F.col("root").alias("v"))).distinct()
    families = components(near.unionAll(_met(rest, sketches, Sketched, percent, BLOCK_BYTES))).withColumnRenamed("label", "family")
    released(docs.sparkSession)
    at = meta.where("v is not null").groupBy("v").agg(F.min(F.struct("id", "check")).alias("at")).join(families.select("v"), "v").select("v", "at.*")

    def run(batches):
        for names, texts in _chunks(batches, ["v", "text"]):
            sets = shingle_sets(texts, n)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["v", "n", "payload"])

    texts = docs.alias("d").join(at.alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.check") == F.col("w.check"))).select("v", "text")
    # repeated rows come more than once; any is the set
    sets = written(texts.dropDuplicates(["v"]).mapInArrow(run, "v long, n long, payload array<long>"), "jaccard-features")
    # members of different families are no links; all of a family that fits a group meet there, of larger ones those with a common signature
    held = families.join(sets.select("v", "n"), "v").groupBy("family").agg(F.sum("n").alias("held"))
    sized = written(families.join(held, "family"), "jaccard-families")
    close = sized.where(F.col("held") <= BLOCK_FEATURES).select(F.col("family").alias("s"), "v", "family")
    large = sized.where(F.col("held") > BLOCK_FEATURES).drop("held")
    if not large.isEmpty():
        members = stars.select("s", "v").unionAll(stars.select("s", F.col("root").alias("v")))
        close = close.unionAll(members.join(large, "v").select(F.xxhash64("s", "family").alias("s"), "v", "family").distinct())
    labels = components(_met(close, sets, Whole, percent, BLOCK_FEATURES))
    known = meta.where("v is not null").groupBy("v").agg(F.min("id").alias("id"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "check", "v")).alias("keeper")).join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
    named = known.groupBy("label").agg(F.min("id").alias("component_id"), F.min("keeper").alias("keeper"))
    by_vertex = known.select("v", "label").join(named, "label").select("v", "component_id", "keeper")
    return (
        meta.join(by_vertex, "v", "left")
        .select("id", "check", F.col("n").alias("n_shingles"), "v", F.when(F.col("v").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
                (F.col("v").isNull() | (F.col("keeper.id").eqNullSafe(F.col("id")) & (F.col("keeper.check") == F.col("check")))).alias("kept"))
    )


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, n2: int = 3, k2: int = 1) -> DataFrame:
    """The rows of docs, with all their columns, that stay when of each component of links only the document of the least id does.

    Documents without words all stay; of repeated rows one does.
    """
    found = join_components(docs, id_col=id_col, text_col=text_col, n=n, percent=percent, n2=n2, k2=k2).where("kept and v is not null")
    kept = found.groupBy("id", "check").agg(F.count("*").alias("copies"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    words = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.where(words).select(row, F.col(id_col).alias("id"), F.xxhash64(text_col).alias("check"))
    own = rows.alias("d").join(kept.alias("k"), F.col("d.id").eqNullSafe(F.col("k.id")) & (F.col("d.check") == F.col("k.check"))).select("row", "d.id", "d.check", "copies")
    out = own.where("copies = 1").select("row")
    if not kept.where("copies > 1").isEmpty():
        out = out.unionAll(own.where("copies > 1").groupBy("id", "check").agg(F.first("row").alias("row")).select("row"))
    return docs.where(~words).select(row).unionAll(out).select("row.*")


def op1_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents whose sets of 3-word shingles have a similarity of 0.9 or more."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
