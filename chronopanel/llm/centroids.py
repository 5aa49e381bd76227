"""Clustering around centroids (Lloyd's rounds, exact in integers) with Hamerly's bounds.

Components become floor(1024 * x). Every vector keeps its cluster, an upper bound of the distance to its centroid and a
lower bound of that to the second nearest. When centroids have moved, the upper bound grows by the drift of its own centroid and the lower
one shrinks by the largest drift of any other; where the upper bound then lies below the lower one, or below half the
distance of the own centroid to its nearest neighbour, the nearest centroid can't have changed. Otherwise the upper bound is
made exact, and if the vector is still ambiguous, it gets a full scan in exact integers, which also decides ties. Bounds are
rounded outwards, so they never decide what integers would decide otherwise.

Vectors and their bounds are a table in the shared folder, written anew in every round, so that its lineage ends there; the
one before is deleted. A task also adds up what its vectors bring to and take from each cluster, as rows of the same table; these are
summed by Spark in 38 digits, so each round is one pass over the vectors, and only a centroid's sums and counts reach the driver.

Nulls, ties, and so on: vectors that are null, have another length than ``width``, or hold a null or non-finite component take no
part; a null id is hashed as an empty one; of equal distances the smaller number wins; repeated rows are vectors of their own, and first
centroids whose hashes tie come in the order of their vectors; with fewer vectors than ``k`` there are as many clusters as vectors; an empty cluster keeps its centroid;
components and distances beyond 64 bits raise; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.sources.files import remove
from chronopanel.sources.tables import shared_path, temporary, written

STATE = "vec_id {id}, v array<long>, cluster int, upper double, lower double, distance long, moved int, sums array<decimal(38,0)>, n long"
LARGEST = 2**63 - 1
#: Bounds are rounded outwards by this share.
SLACK = 1e-9


def _squares(v: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """Exact squared distances of rows to centroids, in the narrowest numbers that hold them."""
    c = np.array(centroids, object)
    largest = max(int(np.abs(v).max(initial=0)), *(abs(x) for row in centroids for x in row), 1)
    width = max(1, v.shape[1])
    size = width * (2 * largest) ** 2
    kind = np.float64 if size < 2**52 else np.int64 if size < 2**62 else object
    v, c = v.astype(kind), c.astype(kind)
    found = (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None]
    return found if kind is object else found.astype(np.int64)


def _roots(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(float))


class Round:
    """What a task needs of a round: the centroids, and how far they have come since the last one."""

    def __init__(self, centroids: list[list[int]], before: list[list[int]] | None):
        self.centroids = centroids
        k = len(centroids)
        if before is None:
            self.drift = self.others = None
        else:
            self.drift = np.array([float(_squares(np.array([a], object), [b])[0, 0]) for a, b in zip(centroids, before, strict=True)]) ** 0.5 * (1 + SLACK)
            # the largest drift of any other centroid
            self.others = np.array([max((self.drift[j] for j in range(k) if j != i), default=0.0) for i in range(k)])
        apart = _roots(_squares(np.array(centroids, object), centroids))
        np.fill_diagonal(apart, np.inf)
        self.half = apart.min(1) / 2 * (1 - SLACK)

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, upper and lower bound of each vector, and how many had a full scan."""
        if self.drift is None:
            unsure = np.arange(len(v))
            cluster, upper, lower = np.zeros(len(v), np.int32), np.zeros(len(v)), np.zeros(len(v))
        else:
            cluster, upper, lower = cluster.copy(), upper + self.drift[cluster], lower - self.others[cluster]
            unsure = np.flatnonzero(upper >= np.maximum(lower, self.half[cluster]))
            if len(unsure):  # first only the own distance
                for i in np.unique(cluster[unsure]):
                    rows = unsure[cluster[unsure] == i]
                    upper[rows] = _roots(_squares(v[rows], [self.centroids[i]])[:, 0]) * (1 + SLACK)
                unsure = unsure[upper[unsure] >= np.maximum(lower[unsure], self.half[cluster[unsure]])]
        if len(unsure):
            squares = _squares(v[unsure], self.centroids)
            cluster[unsure] = best = np.argmin(squares, axis=1).astype(np.int32)  # the first of equal ones
            at = np.arange(len(unsure))
            upper[unsure] = _roots(squares[at, best]) * (1 + SLACK)
            if len(self.centroids) > 1:
                squares = squares.astype(float)
                squares[at, best] = np.inf
                lower[unsure] = np.sqrt(squares.min(1)) * (1 - SLACK)
            else:
                lower[unsure] = np.inf
        return cluster, upper, lower, len(unsure)


def _vectors(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _pass(table: DataFrame, this: Round, width: int, id_type: pa.DataType, schema: str, last: bool) -> DataFrame:
    """table with new clusters and bounds, and at each task's end rows of what each cluster gains; in the last pass, distances instead."""
    k = len(this.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, scans = [[0] * width for _ in range(k)], [0] * k, 0
        for batch in batches:
            v, before = _vectors(batch.column("v"), width), batch.column("cluster").to_numpy(zero_copy_only=False)
            first = this.drift is None
            own = np.full(len(v), -1, np.int32) if first else before.astype(np.int32)
            bounds = [np.zeros(len(v)) if first else batch.column(c).to_numpy() for c in ("upper", "lower")]
            cluster, upper, lower, scanned = this.assign(v, own, *bounds)
            scans += scanned
            exact = [None] * len(v)
            if last:
                for i in np.unique(cluster):
                    rows = np.flatnonzero(cluster == i)
                    for r, d in zip(rows.tolist(), _squares(v[rows], [this.centroids[i]])[:, 0].tolist(), strict=True):
                        if d > LARGEST:
                            raise ValueError("a distance beyond 64 bits")
                        exact[r] = int(d)
            else:
                other = np.flatnonzero(cluster != own)
                wide = v[other].astype(object) if len(other) and int(np.abs(v[other]).max(initial=0)) > 2**40 else v[other]
                for i in range(k):
                    for rows, sign in ((cluster[other] == i, 1), (own[other] == i, -1)):
                        if rows.any():
                            counts[i] += sign * int(rows.sum())
                            sums[i] = [a + sign * int(b) for a, b in zip(sums[i], wide[rows].sum(0), strict=True)]
            none = pa.nulls(len(v))
            arrays = [batch.column("vec_id"), batch.column("v"), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(exact, pa.int64()), none.cast(pa.int32()), none.cast(pa.list_(pa.decimal128(38, 0))), none.cast(pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names)
        if not last:
            some = [i for i in range(k) if counts[i] or any(sums[i])] + [-1]
            kinds = [id_type, pa.list_(pa.int64()), pa.int32(), pa.float64(), pa.float64(), pa.int64()]
            rows = [*[pa.nulls(len(some)).cast(t) for t in kinds], pa.array(some, pa.int32())]
            yield pa.RecordBatch.from_arrays([*rows, pa.array([sums[i] if i >= 0 else None for i in some], pa.list_(pa.decimal128(38, 0))), pa.array([counts[i] if i >= 0 else scans for i in some], pa.int64())], names)

    names = [x.split()[0] for x in schema.split(", ")]
    return table.mapInArrow(run, schema)


def _takes_part(v: str, width: int):
    return F.col(v).isNotNull() & (F.size(v) == width) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _gained(table: DataFrame, k: int, width: int) -> tuple[list[list[int]], list[int], int]:
    """What each cluster gained in a round, summed over tasks: k * width numbers, k counts; and the number of full scans."""
    extra = table.where("moved is not null")
    sums = [[0] * width for _ in range(k)]
    for r in extra.where("moved >= 0").select("moved", F.posexplode("sums")).groupBy("moved", "pos").agg(F.sum("col").alias("gain")).collect():
        sums[r["moved"]][r["pos"]] = int(r["gain"])
    counts = {r["moved"]: r["n"] for r in extra.groupBy("moved").agg(F.sum("n").alias("n")).collect()}
    return sums, [counts.get(i, 0) for i in range(k)], counts.get(-1, 0)


def cluster(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 8, rounds: int = 10, width: int = 64, scale: int = 1024, seed: str = "3", scans: list[int] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of each vector that takes part; ``scans`` gets the number of full scans of each round."""
    spark = vectors.sparkSession
    kept = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{vector_col}`").alias("_v"))
    schema = STATE.format(id=kept.schema["vec_id"].dataType.simpleString())
    id_type = kept.select("vec_id").limit(0).toArrow().schema.field("vec_id").type
    none = [F.lit(None).cast(kind).alias(c) for c, kind in (x.split(" ", 1) for x in schema.split(", ")[2:])]

    def integer(x):
        y = scale * x.cast("double")
        return F.when(F.abs(y) >= 2.0**62, F.raise_error(F.lit("a component beyond 64 bits")).cast("long")).otherwise(F.floor(y).cast("long"))

    with temporary(spark):
        path = shared_path(spark, "centroids")
        kept.where(_takes_part("_v", width)).select("vec_id", F.transform("_v", integer).alias("v"), *none).write.parquet(path)
        table = spark.read.schema(schema).parquet(path)
        name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
        centroids = [list(r["v"]) for r in table.select("v", F.sha2(name, 256).alias("hash")).orderBy("hash", "v").limit(k).collect()]
        before, k = None, len(centroids)
        sums, counts = [[0] * width for _ in range(k)], [0] * k
        for _ in range(rounds if k else 0):
            done = shared_path(spark, "centroids")
            _pass(table, Round(centroids, before), width, id_type, schema, last=False).write.parquet(done)
            remove(spark, path)
            path, table = done, spark.read.schema(schema).parquet(done)
            gains, more, scanned = _gained(table, k, width)
            table = table.where("moved is null")
            if scans is not None:
                scans.append(scanned)
            sums = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(sums, gains, strict=True)]
            counts = [a + b for a, b in zip(counts, more, strict=True)]
            before, centroids = centroids, [[x // n for x in own] if n else old for own, n, old in zip(sums, counts, centroids, strict=True)]
        found = _pass(table, Round(centroids, before), width, id_type, schema, last=True) if k else table
        found = written(found.select("vec_id", "cluster", "distance"), "centroids-result", keep=True)
    inertia = {r["cluster"]: int(r["d"]) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    if sum(inertia.values()) > LARGEST:
        raise ValueError("an inertia beyond 64 bits")
    each = lambda values, kind: F.element_at(F.array(*[F.lit(x) for x in values], F.lit(None)), F.col("cluster") + 1).cast(kind)
    hashes = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return found.select("vec_id", "cluster", "distance", each([inertia.get(i, 0) for i in range(k)], "long").alias("cluster_inertia"), F.lit(sum(inertia.values())).cast("long").alias("inertia"), each(hashes, "string").alias("centroid_sha256"))


def op13_centroids(spark, sf_dir: str) -> DataFrame:
    """All vectors of 64 components in 8 clusters after 10 rounds."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


def _sql(k: int = 8, rounds: int = 10) -> str:
    """The same rounds as tables of (vector, place, component), each on the one before."""
    steps = [f"""
v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
x AS MATERIALIZED (SELECT r, unnest(range(64)) AS i, unnest(q) AS x FROM v),
s AS (SELECT row_number() OVER (ORDER BY sha256('3:' || coalesce(CAST(vec_id AS VARCHAR), '')), q) - 1 AS c, q FROM v),
c0 AS MATERIALIZED (SELECT c, unnest(range(64)) AS i, unnest(q) AS x FROM s WHERE c < {k})"""]
    for n in range(rounds + 1):
        steps.append(f"""
d{n} AS (SELECT r, c, CAST(sum((x.x - y.x) * (x.x - y.x)) AS BIGINT) AS d FROM x JOIN c{n} y USING (i) GROUP BY r, c),
a{n} AS MATERIALIZED (SELECT r, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{n} GROUP BY r)""")
        if n < rounds:
            steps.append(f"""
c{n + 1} AS MATERIALIZED (
  SELECT c, i, coalesce(m, y.x) AS x FROM c{n} y
  LEFT JOIN (SELECT c, i, CASE WHEN sum(x) < 0 THEN -((-sum(x) + count(*) - 1) // count(*)) ELSE sum(x) // count(*) END AS m FROM a{n} JOIN x USING (r) GROUP BY c, i) USING (c, i))""")
    steps.append(f"""
h AS (SELECT c, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY c)""")
    return f"""
WITH {",".join(steps)}
SELECT vec_id, CAST(c AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN v USING (r) JOIN h USING (c)
"""


OP13_SQL = _sql()
