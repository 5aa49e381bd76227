"""Mixing of sources to target weights, by capped water-filling and seeded whole and fractional repetitions.

Every source has a weight. Targets share ``share`` times all words in proportion to the weights; no target may exceed
``max_epochs`` times its source, and what a clamped source can't take goes to the others by weight until none is above.
That has a closed form: with the sources ordered by cap / weight, the level of the water is the first
(words left) / (weight left) that doesn't reach the next cap.

A document is taken whole as often as its source's epochs have whole parts, and once more if it comes early enough in the
source's seeded order (md5 of seed, id and text): those whose middle lies within the fraction's words. The order is cut by
prefix sums over hash buckets and then within the one bucket that holds the cut, so no source is ever gathered in one
task, however large. Rows alike in source, id and text share a place in the order; where the cut falls among them, they are
counted partition by partition, and as many are taken as fit. Only DataFrame functions run.

Nulls, ties, and so on: a null text has 0 words; a null source is a source of its own, the last; a null id is hashed as an
empty string, with its text; repeated rows are taken one by one; an empty table gives an empty result; other
columns don't matter to :func:`mix_plan` and are kept by :func:`mix`, whatever their names. Very long texts are only counted and hashed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from chronopanel.llm.shared import word_count
from chronopanel.operators.ordered import prefix_sums, text_order
from chronopanel.sources.tables import temporary, written

#: Hex digits of the hash that name a bucket: 4,096 of them for each source.
BUCKET_DIGITS = 3


def _key(id_col: str, text_col: str, seed: int) -> Column:
    own = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (id_col, text_col)]
    return F.md5(F.concat(F.lit(f"{seed}|"), own[0], F.lit("|"), F.md5(own[1])))


def _targets(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """Weight and target of each (source, source_size); sources are ordered slice by slice, since there may be many.

    Sums read their input several times and stand on one another, so each is written: as one plan they were 153 exchanges, and its descriptions filled the driver.
    """
    place = F.coalesce(text_order(F.col("_source")), F.lit(float("inf")))
    ranked = written(prefix_sums(written(sources, "mix-sources"), [], place, [F.col("_source").asc_nulls_last()], {"_i": F.lit(1)}), "mix-ranks")
    ranked = ranked.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("_i") - 1) % len(weights) + 1).cast("int")))
    ranked = ranked.withColumn("_cap", F.lit(float(max_epochs)) * F.col("_source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    ranked = written(prefix_sums(ranked, [], F.col("_ratio"), [F.col("_i")], {"_caps": F.col("_cap"), "_weights": F.col("_w")}), "mix-caps")
    whole = ranked.agg(F.sum("_source_size").alias("_all"), F.sum("_w").alias("_all_w"))
    ranked = ranked.join(F.broadcast(whole)).withColumn("_level", (F.lit(float(share)) * F.col("_all") - (F.col("_caps") - F.col("_cap"))) / (F.col("_all_w") - (F.col("_weights") - F.col("_w"))))
    level = ranked.agg(F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "_i", "_level"))).alias("_first"))
    target = F.least(F.coalesce(F.col("_w") * F.col("_first")["_level"], F.col("_cap")), F.col("_cap"))
    return ranked.join(F.broadcast(level)).withColumn("_target", target).select("_source", "_source_size", "_target")


def _cuts(slim: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """For each source its size, target, whole epochs, the last key all of whose rows get the fractional one (null: none), and the key some of whose rows do, with their number."""
    bucket = F.substring("_key", 1, BUCKET_DIGITS)
    counted = written(slim.groupBy("_source", bucket.alias("_bucket")).agg(F.sum("_size").alias("_n")), "mix-buckets")
    sources = counted.groupBy("_source").agg(F.sum("_n").alias("_source_size"))
    plan = (
        _targets(sources, weights, share, max_epochs)
        .withColumn("_whole", F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0).cast("long"))
        .withColumn("_fraction", F.col("_target") - F.col("_whole") * F.col("_source_size"))
    )
    plan = written(plan, "mix-targets")
    before = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    starts = starts.alias("c").join(plan.alias("p"), F.col("c._source").eqNullSafe(F.col("p._source"))).select("c._source", "_bucket", "_before", "_n", "_fraction")
    # the bucket where the fraction ends; all before it are taken
    edge = starts.where((F.col("_before") < F.col("_fraction")) & (F.col("_before") + F.col("_n") >= F.col("_fraction")))
    inside = (
        slim.withColumn("_bucket", bucket).alias("d")
        .join(edge.alias("e"), F.col("d._source").eqNullSafe(F.col("e._source")) & (F.col("d._bucket") == F.col("e._bucket")))
        .groupBy("d._source", "_key", "_before", "_fraction").agg(F.sum("_size").alias("_n"), F.count("*").alias("_rows"), F.max("_size").alias("_each"))
        .select(F.col("_source"), "_key", "_before", "_fraction", "_n", "_rows", "_each")
    )
    prior = Window.partitionBy("_source").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    inside = inside.withColumn("_start", F.col("_before") + F.coalesce(F.sum("_n").over(prior), F.lit(0)))
    # of the rows of a key, all of one size, those whose middle lies within the fraction
    fit = F.when(F.col("_each") > 0, F.floor((2 * (F.col("_fraction") - F.col("_start")) - F.col("_each")) / (2 * F.col("_each"))) + 1).otherwise(F.col("_rows"))
    fit = F.when(F.col("_start") < F.col("_fraction"), F.greatest(F.lit(0), F.least(fit, F.col("_rows")))).otherwise(0).cast("long")
    taken = inside.withColumn("_fit", fit)
    ends = taken.where(F.col("_fit") > 0).groupBy("_source").agg(F.max(F.when(F.col("_fit") == F.col("_rows"), F.col("_key"))).alias("_end"), F.max(F.when(F.col("_fit") < F.col("_rows"), F.struct("_key", "_fit"))).alias("_tie"))
    # where the edge bucket gives none, the cut lies just before it
    edges = edge.groupBy("_source").agg(F.min("_bucket").alias("_edge"))
    out = plan.alias("p").join(edges.alias("e"), F.col("p._source").eqNullSafe(F.col("e._source")), "left").join(ends.alias("n"), F.col("p._source").eqNullSafe(F.col("n._source")), "left")
    return written(out.select("p._source", "_source_size", "_target", "_whole", F.coalesce("_end", "_edge").alias("_last"), "_tie._key", "_tie._fit").withColumnsRenamed({"_key": "_tie_key", "_fit": "_tie_rows"}), "mix-cuts", keep=True)


def _with_copies(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """rows (_source, _key, …) with their source's cuts and _copies."""
    joined = rows.alias("d").join(cuts.alias("c"), F.col("d._source").eqNullSafe(F.col("c._source"))).drop(F.col("c._source"))
    early = F.coalesce(F.col("_key") <= F.col("_last"), F.lit(False)).cast("int")
    if cuts.where("_tie_key is not null").isEmpty():
        return joined.withColumn("_copies", (F.col("_whole") + early).cast("int"))
    tie = F.coalesce(F.col("_key") == F.col("_tie_key"), F.lit(False))
    # rows alike are numbered within their partition, partitions by prefix sums
    tied = joined.where(tie).withColumn("_place", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id())
    counts = tied.groupBy("_source", "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("_source").alias("_s"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    numbered = tied.withColumn("_k", F.row_number().over(Window.partitionBy("_source", "_part").orderBy("_place")))
    numbered = numbered.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_p")))
    some = (F.col("_before") + F.col("_k") <= F.col("_tie_rows")).cast("int")
    chosen = numbered.withColumn("_copies", (F.col("_whole") + some).cast("int")).drop("_place", "_part", "_k", "_s", "_p", "_before")
    return joined.where(~tie).withColumn("_copies", (F.col("_whole") + early).cast("int")).unionByName(chosen)


def _slim(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    return docs.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"), _key(id_col, text_col, seed).alias("_key"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2, seed: int = 17) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target, copies, taken (copies times size)."""
    with temporary(docs.sparkSession):
        slim = written(_slim(docs, id_col, text_col, source_col, seed), "mix-sizes", keep=True)
        cuts = _cuts(slim, weights, share, max_epochs)
    found = _with_copies(slim, cuts)
    plan = found.select(F.col("_id").alias("doc_id"), F.col("_source").alias("source"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").cast("long").alias("copies"))
    return plan.withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, max_epochs: float = 2, seed: int = 17) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with all their columns."""
    with temporary(docs.sparkSession):
        slim = written(_slim(docs, id_col, text_col, source_col, seed), "mix-sizes")
        cuts = _cuts(slim, weights, share, max_epochs)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    keyed = docs.select(row, F.col(source_col).alias("_source"), _key(id_col, text_col, seed).alias("_key"))
    found = _with_copies(keyed, cuts)
    return found.select("_row", F.explode(F.array_repeat(F.lit(0), F.col("_copies"))).alias("_copy")).select("_row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Mix all documents: weights 5, 2, 1 over the sources by name, 150 % of all words, at most 2 epochs."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix_plan(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS k
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM s),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w, 2.0::DOUBLE * source_size AS cap FROM r),
v AS (SELECT *, cap / w AS ratio FROM w),
l AS (SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER o - cap)) / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
      FROM v WINDOW o AS (ORDER BY ratio, i)),
m AS (SELECT level AS water FROM l WHERE level <= ratio ORDER BY ratio, i LIMIT 1),
t AS (SELECT source, source_size, least(coalesce(w * (SELECT water FROM m), cap), cap) AS target FROM l),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
f AS (SELECT *, target - whole * source_size AS fraction FROM p),
n AS (SELECT *, row_number() OVER (PARTITION BY source, k) AS j FROM d),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY k, j) - size AS start FROM n)
SELECT c.doc_id, c.size, f.source_size, f.target,
       CAST(c.size * (whole + CASE WHEN start < fraction AND 2 * start + size <= 2 * fraction THEN 1 ELSE 0 END) AS BIGINT) AS taken,
       CAST(whole + CASE WHEN start < fraction AND 2 * start + size <= 2 * fraction THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM c JOIN f ON c.source IS NOT DISTINCT FROM f.source
"""
