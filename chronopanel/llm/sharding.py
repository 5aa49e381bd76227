"""Sharding by balanced label propagation: linked documents move towards their neighbours' shards, under quotas.

:func:`propagate` takes nodes and links between them. Nodes start dealt evenly. In every round, Spark joins and aggregates tell each
node how many neighbours each shard holds; a node whose neighbours are mostly elsewhere asks for that shard. Half of the
nodes, by a hash of node and round, may ask in one round, so that neighbours don't change places. A shard accepts as many as it has
room for, and beyond that as many as it gives to the asking shard in exchange; those with the most to gain come
first. So sizes stay within their quotas all the time, and links between shards become fewer. The driver sees a number for each pair of
shards.

:func:`shard` links documents of equal texts: a tree over each group of copies whose nodes have as many neighbours as half a shard holds, FAN at most, so no document
is a hub and no group becomes pairs. Copies start wherever the even deal puts them, and it's propagation that brings them together. What has no links then fills the shards to the law ``rows``: counts at most one apart.

All that is ordered is ordered by prefix sums over hash buckets plus a window within a bucket, and joins to groups broadcast their
hot ones, so neither a shard nor a group of copies is gathered in one task. Only DataFrame functions run.

Nulls, ties, and so on: a null text counts no bytes, has checksum 0 and is linked with nothing; ids may be null or
repeated, since rows are numbered; repeated rows are separate documents; very long texts are only measured and hashed; an empty
table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from chronopanel.llm.shared import joined_by_group, released
from chronopanel.sources.tables import temporary, written

BUCKETS = 256
ROUNDS = 8
#: Neighbours of a document among its copies, at most.
FAN = 1024
#: What a document takes besides its text.
OVERHEAD_BYTES = 16


def _ranked(df: DataFrame, within: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """df with ``name``: the number of rows before each one, among those alike in ``within``, by bucket and then by order."""
    df = df.withColumn("_bucket", bucket)
    sums = df.groupBy(*within, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*within).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*within, "_bucket").orderBy(*order)) - 1
    # the numbers of buckets are small: BUCKETS for each of the shards or pairs of them
    return df.withColumn("_inside", inside).join(F.broadcast(starts), [*within, "_bucket"]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_bucket", "_start", "_inside")


def both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def cut_links(links: DataFrame, labels: DataFrame) -> int:
    """How many links (a, b) have ends in different shards, by labels (node, shard)."""
    end = lambda c: labels.select(F.col("node").alias(c), F.col("shard").alias(f"_{c}"))
    return links.join(end("a"), "a").join(end("b"), "b").where("_a <> _b").count()


def accepted_flows(asked: dict[tuple[int, int], int], free: list[int]) -> dict[tuple[int, int], int]:
    """How many of the nodes that ask to go from one shard to another may: exchanges first, then what there's room for."""
    out = {pair: min(n, asked.get((pair[1], pair[0]), 0)) for pair, n in asked.items()}
    room = list(free)
    # where the most are turned down first; room that others leave behind isn't counted on
    for (i, j), n in sorted(asked.items(), key=lambda x: (out[x[0]] - x[1], x[0])):
        more = min(n - out[i, j], room[j])
        out[i, j] += more
        room[j] -= more
    return {pair: n for pair, n in out.items() if n}


def propagate(nodes: DataFrame, links: DataFrame, quotas: list[int], rounds: int = ROUNDS) -> tuple[DataFrame, list[int]]:
    """(node, shard) of nodes (node) with links (a, b), and the numbers of cut links at the start and the end.

    quotas are the most nodes that each shard may hold; together they are enough for all. Nodes start dealt evenly.
    """
    shards, total = len(quotas), nodes.count()
    start = _ranked(nodes.select("node", F.lit(0).alias("_all")), ["_all"], F.pmod(F.xxhash64("node"), F.lit(BUCKETS)), [F.col("node")], "_rank")
    labels = written(start.select("node", (F.col("_rank") % shards).cast("int").alias("shard")), "shard-labels")
    cuts = [cut_links(links, labels)]
    held = [total // shards + (i < total % shards) for i in range(shards)]
    edges, idle = both_ways(links), 0
    for turn in range(rounds):
        there = labels.select(F.col("node").alias("b"), F.col("shard").alias("to"))
        asking = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
        # dealt by node, of which none has more than FAN neighbours, what follows needs no further exchange
        votes = edges.withColumnRenamed("a", "node").where(asking).join(there, "b").repartition("node").groupBy("node", "to").agg(F.count("*").alias("n"))
        own = votes.join(labels.where(asking), "node")
        # most neighbours first; ties stay, or else go by a rotation of the node's own
        rotated = F.pmod(F.col("to") + F.xxhash64("node"), F.lit(shards))
        best = own.groupBy("node", "shard").agg(F.max(F.struct("n", (F.col("to") == F.col("shard")).alias("stays"), rotated.alias("_r"), "to")).alias("best"), F.coalesce(F.max(F.when(F.col("to") == F.col("shard"), F.col("n"))), F.lit(0)).alias("here"))
        wishes = written(best.where(F.col("best.to") != F.col("shard")).select("node", "shard", "best.to", (F.col("best.n") - F.col("here")).alias("gain")).where("gain > 0"), "shard-wishes")
        asked = {(r["shard"], r["to"]): r["n"] for r in wishes.groupBy("shard", "to").agg(F.count("*").alias("n")).collect()}  # a number for each pair of shards
        flows = accepted_flows(asked, [q - n for q, n in zip(quotas, held, strict=True)])
        if not flows:
            if (idle := idle + 1) == 2:  # neither half has anywhere to go
                break
            continue
        idle = 0
        most = nodes.sparkSession.createDataFrame([(i, j, n) for (i, j), n in flows.items()], "shard int, to int, most long")
        gain = F.least(F.col("gain"), F.lit(15))
        bucket = (15 - gain) * 16 + F.pmod(F.xxhash64("node", F.lit(-1)), F.lit(16))
        moved = _ranked(wishes, ["shard", "to"], bucket, [F.col("node")], "_rank").join(F.broadcast(most), ["shard", "to"]).where("_rank < most").select("node", F.col("to").alias("_to"))
        labels = written(labels.join(moved, "node", "left").select("node", F.coalesce("_to", "shard").alias("shard")), "shard-labels")
        for (i, j), n in flows.items():
            held[i], held[j] = held[i] - n, held[j] + n
        released(nodes.sparkSession)
    return labels, [*cuts, cut_links(links, labels)]


def copy_links(rows: DataFrame, key: str, total: int, fan: int | None = None) -> DataFrame:
    """Links (a, b) between nodes (node, key) of equal keys: a tree over each group, level by level of groups of ``fan`` (FAN) or so."""
    fan, out = fan or FAN, None
    level = rows.where(F.col(key).isNotNull()).select("node", F.col(key).alias("key"))
    while True:
        sizes = level.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
        dealt = joined_by_group(level, sizes, "key", "size", max(1, total)).where("size is not null")
        dealt = written(dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / fan)).cast("int")), "shard-copies")
        heads = dealt.groupBy("key", "part").agg(F.min("node").alias("head"), F.count("*").alias("members"))
        # the head of a part is the member next to all others; parts are small
        own = dealt.join(heads.where("members > 1"), ["key", "part"]).where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
        made = written(own, "shard-links")
        out = made if out is None else out.unionAll(made)
        level = written(heads.select(F.col("head").alias("node"), "key"), "shard-heads")
        if dealt.where("part > 0").isEmpty():
            return out


def shard(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shards: int = 40, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law ('rows'), shard, slot (its place in the shard, from 0), grown_shard (null).

    links, cut_before and cut_after say how many links between copies there are, and how many lay across shards at the start and the end.
    """
    text = F.col(text_col)
    slim = docs.select(
        F.monotonically_increasing_id().alias("node"),
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("_text"),
    )
    with temporary(docs.sparkSession):
        slim = written(slim, "shard-documents")
        total = slim.count()
        quotas = [total // shards + (i < total % shards) for i in range(shards)]
        # parts of a group of copies that is larger than a shard are to fit in one
        links = copy_links(slim, "_text", total, max(2, min(FAN, total // shards // 2)))
        linked = links.select(F.col("a").alias("node")).unionAll(links.select(F.col("b").alias("node"))).distinct()
        nodes = written(linked, "shard-nodes")
        labels, cuts = propagate(nodes, links, quotas, rounds)
        cuts = [links.count(), *cuts]
        settled = written(slim.drop("_text").join(labels, "node", "left"), "shard-settled")
        load = {r["shard"]: r["n"] for r in labels.groupBy("shard").agg(F.count("*").alias("n")).collect()}
        ends, end = [], 0
        for i in range(shards):
            end += quotas[i] - load.get(i, 0)
            ends.append(end)
        loose = settled.where(F.col("shard").isNull()).drop("shard").withColumn("_all", F.lit(0))
        loose = _ranked(loose, ["_all"], F.pmod(F.xxhash64("node", F.lit(2)), F.lit(BUCKETS * 4)), [F.col("node")], "_rank").drop("_all")
        place = F.size(F.filter(F.array(*[F.lit(x).cast("long") for x in ends]), lambda x: x <= F.col("_rank"))).cast("int")
        everyone = settled.where(F.col("shard").isNotNull()).unionByName(loose.withColumn("shard", place).drop("_rank"))
        everyone = written(everyone, "shard-dealt", keep=True)
    slots = _ranked(everyone, ["shard"], F.pmod(F.xxhash64("node", F.lit(3)), F.lit(BUCKETS)), [F.col("node")], "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), *[F.lit(n).cast("long").alias(c) for c, n in zip(("links", "cut_before", "cut_after"), cuts, strict=True)])


def op5_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by the law ``rows``."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), shards=40)
