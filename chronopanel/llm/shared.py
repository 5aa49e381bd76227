"""What several operators need: joins and samples that hot keys don't gather, hashed words, and bounded caches."""

from __future__ import annotations

import gc
import re
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

#: Words as the contracts of the sharding, mixing and near-copy queries define them, for Java and RE2.
WORD = r"[^\x20\x09-\x0D]+"
#: A key of more than this share of all rows is hot; so there are this many hot keys at most.
HOT_SHARE, MOST_HOT = 1 / 1000, 1000


def released(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that nothing refers to any more: it does so when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def joined_by_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """A left join of rows to groups (key, size, …), whose sizes are the numbers of rows with the key, of ``total`` rows.

    Keys of more than HOT_SHARE of all rows, MOST_HOT at most, are broadcast, so the shuffle has no hot key.
    """
    hot = F.col(size) > total * HOT_SHARE
    names = [c for c in groups.columns if c != key]
    near = rows.join(F.broadcast(groups.where(hot).select(key, F.lit(True).alias("_hot"), *[F.col(c).alias(f"_h_{c}") for c in names])), key, "left")
    far = near.where("_hot is null").drop("_hot", *[f"_h_{c}" for c in names]).join(groups.where(~hot), key, "left")
    found = near.where("_hot").select(*rows.columns, *[F.col(f"_h_{c}").alias(c) for c in names])
    return found.unionByName(far.select(*rows.columns, *names))


def sampled(rows: DataFrame, group: str, per_group: int) -> DataFrame:
    """The per_group distinct rows of each group that come first by ``key``, the hex md5 of something; rows has (group, key, …), all small.

    A group is cut at a slice of its keys first, so that no more than that slice and the sample meet in one task.
    """
    slices = rows.groupBy(group, F.substring("key", 1, 4).alias("_slice")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    needed = slices.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).where(F.col("_before") < per_group)
    last = needed.groupBy(group).agg(F.max("_slice").alias("_last"))
    few = rows.join(F.broadcast(last), group).where(F.substring("key", 1, 4) <= F.col("_last")).drop("_last")
    order = Window.partitionBy(group).orderBy("key", *[c for c in rows.columns if c not in (group, "key")])
    return few.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_group).drop("_rank")


class HashedWords(dict):
    """64-bit hashes of byte strings, looked up rather than computed again; emptied when it holds ``most`` of them."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def multipliers(n: int) -> np.ndarray:
    """n odd constants, as weights of the positions of a window."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n hashes."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j, c in enumerate(multipliers(n)):
        out += hashes[j : j + m] * c
    return mixed(out)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
#: Bytes that are hashed as one array, and of a word that is hashed by itself first.
PIECE_BYTES, LONG_WORD = 4_000_000, 1 << 16
_LONG = re.compile(rb"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{%d,}" % LONG_WORD)
_BREAK = re.compile(rb"[\x20\x09-\x0D]")


def _prepared(text: str | None) -> bytes:
    """Lower-cased bytes (A-Z), words beyond LONG_WORD replaced by their digest."""
    raw = (text or "").encode("utf-8", "surrogatepass").lower()
    return _LONG.sub(lambda m: b"\x01" + xxhash.xxh3_128_hexdigest(m[0]).encode(), raw) if len(raw) >= LONG_WORD else raw


def _pieces(raw: bytes) -> Iterator[bytes]:
    """A long text cut between words."""
    at = 0
    while len(raw) - at > PIECE_BYTES:
        cut = _BREAK.search(raw, at + PIECE_BYTES)
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end
    yield raw[at:]


def _hashed(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    inside = ~_SPACE[data]
    step = np.diff(inside.astype(np.int8), prepend=0)
    begins, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    lengths = ends - begins
    at = np.concatenate([[0], np.cumsum(lengths)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], lengths)
    powers = np.cumprod(np.full(int(lengths.max(initial=0)) + 1, 0x2545F4914F6CDD1D, np.uint64), dtype=np.uint64)
    parts = _BYTE[data[inside]] * powers[place]
    hashes = mixed(np.add.reduceat(parts, at[:-1]) + lengths.astype(np.uint64)) if len(begins) else np.empty(0, np.uint64)
    starts = np.cumsum([0, *[len(x) + 1 for x in raw]])
    return hashes, np.searchsorted(begins, starts)


def hashed_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and where each text's begin (with the end): words by ASCII whitespace, A-Z lower-cased.

    Texts are hashed as arrays of bytes, so no word becomes an object; a long text goes piece by piece, so that only its hashes grow with it.
    """
    out, counts, held, size = [], [], [], 0

    def flush():
        nonlocal held, size
        hashes, starts = _hashed(held)
        out.append(hashes)
        counts.extend(np.diff(starts).tolist())
        held, size = [], 0

    for raw in map(_prepared, texts):
        if held and size + len(raw) > PIECE_BYTES:
            flush()
        if len(raw) > PIECE_BYTES:
            parts = [_hashed([x])[0] for x in _pieces(raw)]
            out += parts
            counts.append(sum(map(len, parts)))
        else:
            held.append(raw)
            size += len(raw)
    if held:
        flush()
    return (np.concatenate(out) if out else np.empty(0, np.uint64)), np.cumsum([0, *counts])
