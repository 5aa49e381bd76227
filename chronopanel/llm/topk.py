"""Exact search for the largest integer inner products, by a k-d tree for each shard.

Components become floor(256 * x). Of rows with equal vectors only those of the k + 1 smallest ids can be among anyone's k best, so the others are
left out first, and equal queries are searched once, for k + 1 rows; each row that asks then leaves out itself. Vectors are dealt into shards of about SHARD_ROWS by space: the
bits of a key tell for the most spread dimensions on which side of the median a vector is, and keys next to one another share
a shard. A shard's tree halves its rows at the median of their widest dimension, down to leaves, and keeps for each node
the tight box around its rows and their least id. A query bounds its product with a node's rows by the box, visits nodes best
bound first, and leaves out whatever can't beat its k-th score or, at an equal score, its id. Each query first searches the
shard where it lies. The k-th score found there is then held against the boxes of all shards, page by page of boxes, and the
query goes only to shards that may beat it. Queries stream through each shard's tree in blocks; the tree is the only thing
that a task holds, so memory is bounded by SHARD_ROWS.

Nulls, ties, and so on: vectors that are null or hold a null or non-finite component take no part; a null id asks nothing and is the last
candidate of its score; equal scores go to smaller ids; every row counts by itself, also where rows share an id or are alike altogether: each asks, and only the row itself
is no candidate of its own;
of vectors of different lengths the shorter is filled up with zeros, and an empty one scores 0 with all; components beyond 64 bits raise, as
does a score, and products are exact whatever their size; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronopanel.operators.ordered import prefix_sums
from chronopanel.sources.tables import temporary, written

SHARD_ROWS = 8192
LEAF_ROWS = 64
QUERY_BLOCK = 256
#: Boxes of shards in one page, queries that a task holds against one, bits of the key that cuts space, and salts of equal vectors.
PAGE, PAGE_QUERIES, MOST_BITS, SALTS = 4096, 20_000, 20, 32
#: Stands for scores of more than 64 bits, which raise unless they are a row's product with itself; and for null as an id.
BEYOND = 2**63 - 1


def bounds_of(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest product that each query may have with rows in each box."""
    return np.maximum(queries, 0).astype(float) @ high.T + np.minimum(queries, 0).astype(float) @ low.T


class Tree:
    """Nodes as arrays: box corners, least id, children (or rows of a leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS):
        order = np.arange(len(ids))
        self.spans, self.children, lows, highs, least = [], [], [], [], []

        def add(lo: int, hi: int) -> int:
            own = rows[order[lo:hi]]
            self.spans.append((lo, hi))
            self.children.append(None)
            lows.append(own.min(0))
            highs.append(own.max(0))
            least.append(ids[order[lo:hi]].min())
            return len(self.spans) - 1

        waiting = [add(0, len(ids))]
        while waiting:
            node = waiting.pop()
            lo, hi = self.spans[node]
            if hi - lo <= leaf_rows:
                continue
            widest = int(np.argmax(highs[node].astype(float) - lows[node]))
            middle = (hi - lo) // 2
            order[lo:hi] = order[lo:hi][np.argpartition(rows[order[lo:hi], widest], middle)]
            self.children[node] = pair = (add(lo, lo + middle), add(lo + middle, hi))
            waiting += pair
        self.ids, self.rows = ids[order], rows[order]
        self.low, self.high, self.least = np.array(lows, float), np.array(highs, float), np.array(least)

    def search(self, queries: np.ndarray, kth: list[int | None], k: int) -> Iterator[list[tuple[int, int, bool]]]:
        """For each query its (score, id, whether the vector is the query's), best first, of scores not below its known k-th score."""
        bounds = bounds_of(queries, self.low, self.high)
        largest = [max(map(abs, (int(x.max(initial=0)), int(x.min(initial=0))))) for x in (queries, self.rows)]
        size = largest[0] * largest[1] * self.rows.shape[1]
        kind = float if size < 2**52 else np.int64 if size < 2**62 else object
        if kind is not float:  # room for the bounds' rounding
            bounds += float(size) * 1e-12
        rows = self.rows.astype(kind)
        for i in range(len(queries)):
            query = queries[i].astype(kind)
            best: list[tuple[int, int, int]] = []  # (score, -id, row): the worst first
            floor = -np.inf if kth[i] is None else kth[i]
            heap = [(-bounds[i, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                bound = -bound
                if bound < floor:
                    break
                if len(best) == k and (bound < best[0][0] or bound == best[0][0] and self.least[node] > -best[0][1]):
                    continue
                if self.children[node]:
                    for child in self.children[node]:
                        if bounds[i, child] >= floor:
                            heapq.heappush(heap, (-bounds[i, child], child))
                    continue
                lo, hi = self.spans[node]
                scores = rows[lo:hi] @ query
                for j in np.flatnonzero(scores >= floor).tolist():
                    found = (int(scores[j]), -int(self.ids[lo + j]), lo + j)
                    if len(best) < k:
                        heapq.heappush(best, found)
                    elif found > best[0]:
                        heapq.heapreplace(best, found)
                if len(best) == k:
                    floor = max(floor, best[0][0])
            yield [(s, -x, bool((self.rows[j] == queries[i]).all())) for s, x, j in sorted(best, reverse=True)]


def _matrix(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Vectors as rows of one width, filled up with zeros or cut; at least one wide."""
    values = column.to_pylist()
    width = max(1, max(map(len, values), default=0)) if width is None else width
    out = np.zeros((len(values), width), np.int64)
    for row, v in zip(out, values, strict=True):
        row[: len(v)] = v[:width]
    return out


def _runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of runs alike in all columns."""
    n = len(columns[0])
    cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if n else []
    edges = [0, *map(int, cuts), n]
    return ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def _search(rows: DataFrame, queries: DataFrame, shards: int, k: int) -> DataFrame:
    """(rep, score, vec_id, same): of each query (shard, rep, q, kth) the k best in its shard of rows (shard, id, q), and whether their vectors are its own."""
    both = rows.select("shard", F.lit(0).alias("kind"), "id", "q", F.lit(None).cast("long").alias("kth")).unionAll(queries.select("shard", F.lit(1).alias("kind"), F.col("rep").alias("id"), "q", "kth"))
    dealt = both.repartition(shards, "shard").sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held, tree = None, [], None
        for whole in batches:
            numbers, kinds = whole.column("shard").to_numpy(), whole.column("kind").to_numpy()
            for lo, hi in _runs(numbers, kinds):
                part = whole.slice(lo, hi - lo)
                if numbers[lo] != shard:
                    shard, held, tree = numbers[lo], [], None
                if kinds[lo] == 0:
                    held.append(part)
                    continue
                if tree is None and held:
                    width = max(1, *(max(map(len, p.column("q").to_pylist())) for p in held))
                    tree = Tree(np.concatenate([p.column("id").to_numpy() for p in held]), np.concatenate([_matrix(p.column("q"), width) for p in held]))
                    held = []
                if tree is None:
                    continue
                for at in range(0, part.num_rows, QUERY_BLOCK):
                    block = part.slice(at, QUERY_BLOCK)
                    found = list(tree.search(_matrix(block.column("q"), tree.rows.shape[1]), block.column("kth").to_pylist(), k))
                    place = np.repeat(np.arange(len(found)), [len(x) for x in found])
                    flat = [x for one in found for x in one]
                    yield pa.RecordBatch.from_arrays([pa.array(block.column("id").to_numpy()[place]), pa.array([max(-BEYOND, min(BEYOND, s)) for s, _, _ in flat], pa.int64()), pa.array([v for _, v, _ in flat], pa.int64()), pa.array([x for _, _, x in flat], pa.bool_())], ["rep", "score", "vec_id", "same"])

    return dealt.mapInArrow(run, "rep long, score long, vec_id long, same boolean")


def _boxes(rows: DataFrame, shards: int) -> DataFrame:
    """(page, shard, low, high): the box of each shard's vectors, zeros added to shorter ones; shards lie together."""
    def run(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            numbers = batch.column("shard").to_numpy()
            for lo, hi in _runs(numbers):
                own = _matrix(batch.column("q").slice(lo, hi - lo))
                low, high = own.min(0), own.max(0)
                if (s := int(numbers[lo])) in held:
                    width = max(len(low), len(held[s][0]))
                    pad = lambda x, width=width: np.pad(x, (0, width - len(x)))
                    low, high = np.minimum(pad(low), pad(held[s][0])), np.maximum(pad(high), pad(held[s][1]))
                held[s] = (low, high)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tolist() for x, _ in held.values()], kind), pa.array([x.tolist() for _, x in held.values()], kind)], ["shard", "low", "high"])

    made = rows.select("shard", "q").repartition(shards, "shard").mapInArrow(run, "shard int, low array<long>, high array<long>")
    return made.withColumn("page", F.floor(F.col("shard") / PAGE).cast("int"))


def _worthwhile(queries: DataFrame, boxes: DataFrame, shards: int, asked_rows: int) -> DataFrame:
    """(shard, rep, q, kth) for the shards other than its own whose box may hold what a query (shard, rep, q, kth) lacks."""
    pages, parts = -(-shards // PAGE), max(1, -(-asked_rows // PAGE_QUERIES))
    asked = queries.select(F.explode(F.sequence(F.lit(0), F.lit(pages - 1))).alias("page"), F.lit(1).alias("kind"), "shard", "q", F.lit(None).cast("array<long>").alias("high"), "rep", "kth")
    # every part of a page's queries needs all of its boxes
    spread = boxes.select("page", "shard", "low", "high").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int"))
    both = spread.select("page", "part", F.lit(0).alias("kind"), "shard", F.col("low").alias("q"), "high", F.lit(None).cast("long").alias("rep"), F.lit(None).cast("long").alias("kth")).unionAll(asked.select("page", "part", "kind", "shard", "q", "high", "rep", "kth"))
    dealt = both.repartition(pages * parts, "page", "part").sortWithinPartitions("page", "part", "kind")

    def run(batches):
        at, held, low, high, numbers = None, [], None, None, None
        for whole in batches:
            page, part_, kinds = (whole.column(c).to_numpy() for c in ("page", "part", "kind"))
            for lo, hi in _runs(page, part_, kinds):
                part = whole.slice(lo, hi - lo)
                if (key := (page[lo], part_[lo])) != at:
                    at, held, low = key, [], None
                if kinds[lo] == 0:
                    held.append(part)
                    continue
                if not held and low is None:
                    continue
                if low is None:
                    width = max(1, *(max(map(len, p.column("q").to_pylist())) for p in held))
                    low, high = (np.concatenate([_matrix(p.column(c), width) for p in held]).astype(float) for c in ("q", "high"))
                    numbers = np.concatenate([p.column("shard").to_numpy() for p in held])
                    held = []
                for begin in range(0, part.num_rows, QUERY_BLOCK):
                    block = part.slice(begin, QUERY_BLOCK)
                    queries = _matrix(block.column("q"), low.shape[1])
                    bounds = bounds_of(queries, low, high)
                    bounds += np.abs(queries).sum(1, dtype=float)[:, None] * np.maximum(np.abs(low), np.abs(high)).max() * 1e-12
                    kth = np.array([-np.inf if x is None else x for x in block.column("kth").to_pylist()])
                    own = block.column("shard").to_numpy()
                    i, j = np.nonzero((bounds >= kth[:, None]) & (numbers[None] != own[:, None]))
                    rows = pa.array(i)
                    yield pa.RecordBatch.from_arrays([pa.array(numbers[j], pa.int32()), *[block.column(c).take(rows) for c in ("rep", "q", "kth")]], ["shard", "rep", "q", "kth"])

    return dealt.mapInArrow(run, "shard int, rep long, q array<long>, kth long")


def _keyed(rows: DataFrame, shards: int) -> tuple[DataFrame, list]:
    """rows with the key that cuts space, and the (dimension, median) of its bits."""
    if shards == 1:
        return rows.withColumn("key", F.lit(0).cast("long")), []
    bits = min(MOST_BITS, int(np.ceil(np.log2(shards))) + 2)
    each = rows.select(F.posexplode("q")).groupBy("pos").agg(F.percentile_approx("col", F.lit(0.5), F.lit(1000)).alias("middle"), F.stddev_samp(F.col("col").cast("double")).alias("spread"))
    cuts = [(r["pos"], r["middle"]) for r in each.orderBy(F.desc("spread"), "pos").limit(bits).collect()]
    return rows.withColumn("key", _key_of(cuts)), cuts


def _key_of(cuts: list):
    key = F.lit(0).cast("long")
    for pos, middle in cuts:
        key = key * 2 + (F.coalesce(F.get("q", F.lit(pos)), F.lit(0)) > middle).cast("long")
    return key


def _first_ids(rows: DataFrame, k: int) -> DataFrame:
    """Of rows (id, q) those with the k smallest ids of each vector, k of each at most; first within salts, so that no task sees all of a common one."""
    each = rows.groupBy("q", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("copies"))
    for parts in (["q", F.pmod(F.xxhash64("id"), F.lit(SALTS))], ["q"]):
        each = each.withColumn("_n", F.row_number().over(Window.partitionBy(*parts).orderBy("id"))).where(F.col("_n") <= k).drop("_n")
    return each.select("id", "q", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy")).drop("_copy")


def search(vectors: DataFrame, is_query, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 5, scale: int = 256, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row for which is_query holds."""
    whole = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    clean = vectors.where(F.col(vector_col).isNotNull() & whole)
    number = F.col(id_col).cast("long")
    number = F.when(number.isNull(), F.lit(BEYOND)).when(number == BEYOND, F.raise_error(F.lit(f"{BEYOND} can't be an id")).cast("long")).otherwise(number)

    def integer(x):
        y = scale * x.cast("double")
        return F.when(F.abs(y) >= 2.0**63, F.raise_error(F.lit("a component beyond 64 bits")).cast("long")).otherwise(F.floor(y).cast("long"))

    with temporary(vectors.sparkSession):
        rows = clean.select(number.alias("id"), F.transform(vector_col, integer).alias("q"), (is_query & F.col(id_col).isNotNull()).alias("asks"))
        rows = written(rows.withColumn("member", F.monotonically_increasing_id()), "topk-rows")
        # one more than k: the query's own row is among the candidates until the end
        candidates = written(_first_ids(rows.select("id", "q"), k + 1), "topk-candidates")
        asking = written(rows.where("asks").select("q").distinct().withColumn("rep", F.monotonically_increasing_id()), "topk-asking")
        members = written(rows.where("asks").select("member", "id", "q").join(asking, "q").select("member", "id", "rep"), "topk-members")
        shards = max(1, -(-candidates.count() // shard_rows))
        keyed, cuts = _keyed(candidates, shards)
        counts = keyed.groupBy("key").agg(F.count("*").alias("n"))  # 2 ** MOST_BITS rows at most
        places = prefix_sums(counts, [], F.col("key").cast("double"), [], {"upto": F.col("n")})
        first, last = F.floor((F.col("upto") - F.col("n")) / shard_rows), F.floor((F.col("upto") - 1) / shard_rows)
        places = written(places.select("key", first.alias("first"), (last - first + 1).alias("several")), "topk-places")
        shard = (F.col("first") + F.pmod(F.xxhash64("q"), F.col("several"))).cast("int").alias("shard")
        dealt = written(keyed.join(F.broadcast(places), "key").select("id", "q", shard), "topk-dealt")
        asked = asking.withColumn("key", _key_of(cuts)).join(F.broadcast(places), "key").select("rep", "q", shard)
        asked = written(asked, "topk-asked")
        best = Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id")
        near = written(_search(dealt, asked.withColumn("kth", F.lit(None).cast("long")), shards, k + 1), "topk-near")
        kth = near.withColumn("n", F.row_number().over(best)).where(F.col("n") == k + 1).select("rep", F.col("score").alias("kth"))
        found = near
        if shards > 1:
            known = written(asked.join(kth, "rep", "left"), "topk-known")
            far = written(_worthwhile(known, _boxes(dealt, shards), shards, known.count()), "topk-far")
            found = near.unionAll(_search(dealt, far, shards, k + 1))
        few = written(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "topk-found")
        # of a row's candidates with its own id and vector one is the row itself
        each = members.join(few, "rep").withColumn("own", (F.col("id") == F.col("vec_id")) & F.col("same"))
        each = each.withColumn("n", F.row_number().over(Window.partitionBy("member", "own").orderBy("score"))).where("not own or n > 1")
        rank = F.row_number().over(Window.partitionBy("member").orderBy(F.desc("score"), "vec_id")).cast("int")
        out = each.withColumn("rank", rank).where(F.col("rank") <= k)
        score = F.when(F.abs("score") == BEYOND, F.raise_error(F.lit("a score beyond 64 bits")).cast("long")).otherwise(F.col("score"))
        return written(out.select(F.col("id").alias("query_id"), "rank", F.when(F.col("vec_id") != BEYOND, F.col("vec_id")).alias("vec_id"), score.alias("score")), "topk-result", keep=True)


def op2_topk(spark, sf_dir: str) -> DataFrame:
    """The 5 best of all vectors for each whose id is divisible by 50."""
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), F.col("vec_id") % 50 == 0)


OP2_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.r, a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_dot_product(CAST(a.q AS DOUBLE[]), CAST(b.q AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.r <> b.r WHERE a.vec_id % 50 = 0),
n AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM n WHERE rank <= 5
"""
