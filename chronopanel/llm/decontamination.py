"""Benchmark decontamination: a broadcast hash set of the benchmark's word n-grams, looked up in every window of the documents.

Items are read in blocks of at most ``block_words`` words; a longer item is cut into pieces that share a window less one word. Each
block becomes a table of window hashes whose size is thus bounded. A benchmark of one block takes one pass over the documents. A
larger one numbers the documents in a table once and takes a pass over it for each block, which writes no more than the numbers, spans and items of
documents with a hit; the block is destroyed before the next is made, so neither driver nor workers hold more than one, and
the last pass joins what the others found. Each match of hashes is verified word by word.
Texts are scanned in segments that share a window less one word, so what a task holds doesn't grow with a text's words.

Texts are lower-cased (A-Z) and split into runs of letters, digits and bytes above 127. An item of fewer words than a
window, but not none, is one window of its own length.

Nulls, ties, and so on: a null or empty text has no words and no hits; an item without words matches nothing; items that
share a window all count; rows of one item_id count as one item; a null item_id counts as an item named by the empty
string; repeated documents are reported each; an empty table on either side works; further columns are kept and may have
any name.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.shared import HashedWords, windows
from chronopanel.sources.tables import temporary, written

WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
WINDOW = 13
#: Words of benchmark text behind one lookup table: about 200 MB of Python objects at the most.
BLOCK_WORDS = 1_000_000
#: Words of a text that are scanned together.
SEGMENT_WORDS = 500_000
#: Bits of the table that rejects most windows at once.
SIEVE_BITS = 22


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def segments(text: str | None, overlap: int, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(place of its first word, words) of segments of at most ``most`` words; each begins with the last ``overlap`` words of the one before it."""
    if not text or len(text) < most:
        yield 0, words_of(text)
        return
    at, held = 0, []
    for m in WORDS.finditer(text.encode("utf-8", "surrogatepass").lower()):
        held.append(m[0])
        if len(held) == most:
            yield at, held
            at, held = at + most - overlap, held[most - overlap :]
    yield at, held


class Lookup:
    """Windows of some items: by length and hash, each with its words and the items that have it."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.by_length: dict[int, dict[int, list[tuple[tuple[bytes, ...], set[str]]]]] = defaultdict(dict)
        hashed = HashedWords()
        for item, words in items:
            n = min(window, len(words))
            if not n:
                continue
            for i, h in enumerate(windows(hashed.of(words), n).tolist()):
                there = self.by_length[n].setdefault(h, [])
                words_here = tuple(words[i : i + n])
                for known, ids in there:
                    if known == words_here:
                        ids.add(item)
                        break
                else:
                    there.append((words_here, {item}))
        self.sieves = {}
        for n, table in self.by_length.items():
            sieve = np.zeros(1 << SIEVE_BITS, bool)
            sieve[(np.fromiter(table, np.uint64, len(table)) & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)] = True
            self.sieves[n] = sieve

    def hits(self, words: list[bytes], hashes: np.ndarray, at: int, end: int, found: dict[int, np.ndarray]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans (start, end in words) and items of the document whose words are words[at:end]; found: by length, positions that pass the sieve, and hashes."""
        spans, items = [], set()
        for n, (places, keys) in found.items():
            lo, hi = np.searchsorted(places, [at, end - n + 1])
            for i, h in zip(places[lo:hi].tolist(), keys[lo:hi].tolist(), strict=True):
                for known, ids in self.by_length[n].get(h, ()):
                    if tuple(words[i : i + n]) == known:
                        spans.append((i - at, i - at + n))
                        items |= ids
        return spans, items

    def scan(self, texts: list[str | None], hashed: HashedWords, most_words: int = SEGMENT_WORDS) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
        """(words, spans, items) of each text; segments are taken together up to most_words, so that short texts share the work."""
        out: list[tuple[int, list, set]] = [(0, [], set()) for _ in texts]
        held: list[tuple[int, int, list[bytes]]] = []

        def flush():
            words = [w for _, _, x in held for w in x]
            hashes = hashed.of(words)
            found = {}
            for n, sieve in self.sieves.items():
                w = windows(hashes, n)
                places = np.flatnonzero(sieve[(w & np.uint64((1 << SIEVE_BITS) - 1)).astype(np.int64)])
                found[n] = (places, w[places])
            at = 0
            for i, first, x in held:
                spans, items = self.hits(words, hashes, at, at + len(x), found)
                _, known, ids = out[i]
                known += [(first + a, first + b) for a, b in spans]
                out[i] = (first + len(x), known, ids | items)
                at += len(x)
            held.clear()

        size = 0
        for i, text in enumerate(texts):
            for first, words in segments(text, self.window - 1, most_words):
                held.append((i, first, words))
                size += len(words)
                if size >= most_words:
                    flush()
                    size = 0
        flush()
        return out


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, as spans apart from one another."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contaminated(n_words: int, n_hit: int) -> bool:
    """The rule: a twentieth of the words or more."""
    return n_hit > 0 and 20 * n_hit >= n_words


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans and what lies between them."""
    raw = text.encode("utf-8", "surrogatepass")
    places = [m.span() for m in WORDS.finditer(raw.lower())]
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """Items as words, in blocks of about block_words words, read one partition at a time; long items in pieces."""
    held, size = [], 0
    for row in benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        for first, words in segments(row["t"], window - 1, max(block_words, 2 * window)):
            if first and len(words) < window:
                continue  # its words are all in the piece before
            held.append((row["i"], words))
            size += len(words)
            if size >= block_words:
                yield held
                held, size = [], 0
    if held:
        yield held


FOUND = "spans array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _scanned(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, window: int, block_words: int, finish, schema) -> DataFrame:
    """rows (…, _text) scanned for all blocks; finish makes a batch of schema of one of rows, its texts, and (words, spans, items) of each."""
    spark = rows.sparkSession
    sc = spark.sparkContext

    def merge(known: list[dict | None], one: list) -> list:
        return [(n, merged([*s, *((x["start"], x["end"]) for x in k["spans"])]), i | set(k["items"])) if k else (n, merged(s), i) for (n, s, i), k in zip(one, known, strict=True)]

    def hits(table):
        """Of rows (_row, _text): those with a hit, without their texts."""

        def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashed = HashedWords()
            for batch in batches:
                found = table.value.scan(batch.column("_text").to_pylist(), hashed)
                there = [(r, merged(s), sorted(i)) for r, (_, s, i) in zip(batch.column("_row").to_pylist(), found, strict=True) if s]
                spans = pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in there], _SPANS)
                yield pa.RecordBatch.from_arrays([pa.array([r for r, _, _ in there], pa.int64()), spans, pa.array([i for _, _, i in there], pa.list_(pa.string()))], ["_row", "spans", "items"])

        return scan_batches

    def run(table, told: bool):
        def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashed = HashedWords()
            for batch in batches:
                texts = batch.column("_text").to_pylist()
                known = batch.column("_found").to_pylist() if told else [None] * len(texts)
                own = batch.select(range(batch.num_columns - 1)) if told else batch
                yield finish(own, texts, merge(known, table.value.scan(texts, hashed)))

        return scan_batches

    before, known, numbered = None, [], None
    with temporary(spark):
        for items in blocks(benchmark, item_col, item_text_col, window, block_words):
            if before is not None:
                shared = sc.broadcast(Lookup(before, window))
                if numbered is None:
                    numbered = written(rows.withColumn("_row", F.monotonically_increasing_id()), "decontamination-rows")
                known.append(written(numbered.select("_row", "_text").mapInArrow(hits(shared), f"_row long, {FOUND}"), "decontamination-found"))
                shared.destroy()
            before = items
        shared = sc.broadcast(Lookup(before or [], window))
        if numbered is None:
            return rows.mapInArrow(run(shared, False), schema)
        found = reduce(DataFrame.unionAll, known).groupBy("_row").agg(F.struct(*[F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "items")]).alias("_found"))
        joined = numbered.join(found, "_row", "left").select(*[F.col(f"`{c}`") for c in rows.columns], "_found")
        return written(joined.mapInArrow(run(shared, True), schema), "decontamination-result", keep=True)


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, and spans (start and end, in words)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def finish(batch, texts, found):
        hit = [sum(b - a for a, b in s) for _, s, _ in found]
        return pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array(hit, pa.int64()),
                pa.array([len(i) for _, _, i in found], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for _, _, i in found], pa.string()),
                pa.array([contaminated(n, h) for (n, _, _), h in zip(found, hit, strict=True)], pa.bool_()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], _SPANS),
            ],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"],
        )

    schema = f"doc_id {id_type}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"
    return _scanned(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text")), benchmark, item_col, item_text_col, window, block_words, finish, schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, remove: str = "documents") -> DataFrame:
    """The rows of docs, with all their columns, without contaminated documents (remove='documents'), or with the hit spans cut out of them (remove='spans')."""
    place = docs.columns.index(text_col)

    def finish(batch, texts, found):
        bad = [contaminated(n, sum(b - a for a, b in s)) for n, s, _ in found]
        kept = batch.select(range(batch.num_columns - 1))
        if remove == "documents":
            return kept.filter(pa.array([not x for x in bad], pa.bool_()))
        cut = [without(t, s) if x else t for t, x, (_, s, _) in zip(texts, bad, found, strict=True)]
        return kept.set_column(place, batch.schema.field(place), pa.array(cut, batch.schema.field(place).type))

    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    out = _scanned(plain.withColumn("_text", F.col(names[place])), benchmark, item_col, item_text_col, window, block_words, finish, plain.schema)
    return out.toDF(*docs.columns)


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark, windows of 13 words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("spans")


OP4_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
ip AS (SELECT item, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS p FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM ip),
ns AS (SELECT DISTINCT n FROM iw),
dp AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, ns WHERE len(w) >= n),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM dp),
h AS (SELECT dw.r, dw.n, dw.p, iw.item FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
q AS (SELECT DISTINCT r, unnest(range(p, p + n)) AS q FROM h),
c AS (SELECT r, count(*) AS n_hit FROM q GROUP BY r),
k AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM h) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON d.r = c.r LEFT JOIN k ON d.r = k.r
"""
