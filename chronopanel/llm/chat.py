"""Chat formatting by perspective rotation: a dialogue of several speakers, rendered once for each of them as the assistant.

In a participant's rendering its own turns are the assistant's and carry the training mask; every other participant is a
user with a name; context roles (system) stay what they are and have no rendering of their own. A dialogue is rendered in
blocks of up to BLOCK_TURNS turns: the blocks of one perspective, in the order of (block, part), joined as they are, make the whole
text. So no row grows with a dialogue. Turns are blocked by their number first and then, where many share a number, by a running
count within it. Blocks of more than a thousandth of all rows, a thousand at most, are counted slice by slice (repeated rows as one
row with their number); dialogues of such a size meet their speakers by salts. So neither a long dialogue nor
repeated rows are gathered in one task.

Nulls, ties, and so on: a null text is empty, a null role is the speaker ``unknown``, a null turn comes first; equal turns are ordered
by role and text; repeated rows are repeated turns; a dialogue with a null id is a dialogue; markers within texts and names are
escaped, and line breaks within names; a very long text is one turn of its block; a dialogue of context roles only has no rendering; an empty table gives an empty result; other columns don't
matter, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from chronopanel.llm.shared import HOT_SHARE
from chronopanel.operators.ordered import prefix_sums, text_order

BLOCK_TURNS = 32
#: The block of turns without a number; rows below which nothing is large; salts of large dialogues.
NULL_BLOCK, LEAST_LARGE, SALTS = -(1 << 60), 1000, 64
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
CONTEXT_ROLES = ("system",)


def escaped(text: str) -> str:
    """Text without markers: a backslash goes between the characters that would make one."""
    return text.replace("<|", "<\\|").replace("|>", "|\\>")


def named(role: str) -> str:
    """A role's name on one line."""
    return escaped(role).replace("\n", "\\n").replace("\r", "\\r")


def render(turns: list[tuple[str, str]], speaker: str, context: tuple[str, ...] = CONTEXT_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """The text of (role, text) turns with the speaker as assistant, and the spans (start, end in characters) to train on."""
    out, spans, at = [], [], 0
    for role, text in turns:
        body = escaped(text)
        head = f"{OPEN}assistant\n" if role == speaker else f"{OPEN}{named(role)}\n" if role in context else f"{OPEN}user name={named(role)}\n"
        out += [head, body, CLOSE]
        if role == speaker:
            spans.append((at + len(head), at + len(head) + len(body) + len(CLOSE)))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), spans


def _large(turns: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of more than a share of all rows; there are MOST_HOT at most."""
    total = turns.agg(F.count("*").alias("_total"))
    counts = turns.groupBy(*keys).agg(F.count("*").alias("_n"))
    return counts.join(F.broadcast(total)).where((F.col("_n") > F.col("_total") * HOT_SHARE) & (F.col("_n") > LEAST_LARGE)).select(*[F.col(k).alias(f"_k_{k}") for k in keys])


def _marked(rows: DataFrame, large: DataFrame, keys: list[str]) -> DataFrame:
    """rows with _large: whether its keys are among the large ones."""
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
    return rows.join(large.withColumn("_there", F.lit(True)), same, "left").withColumn("_large", F.coalesce("_there", F.lit(False))).drop("_there", *[f"_k_{k}" for k in keys])


def _placed(turns: DataFrame) -> DataFrame:
    """turns with place, from 0, within their block: a window for most blocks; large ones by prefix sums, their repeated rows counted first."""
    keys = ["conv_id", "block"]
    marked = _marked(turns, F.broadcast(_large(turns, keys)), keys)
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    few = marked.where(~F.col("_large")).withColumn("place", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))
    many = marked.where("_large").groupBy(*keys, "turn", "role", "text").agg(F.count("*").alias("_copies"))
    # null ids can't be joined by: they stand for themselves in a column of their own
    many = many.withColumn("_conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null")))
    # turns of a block by their numbers; within one, the order is by role and text, and slices by the first bytes of the role or else the text
    many = many.withColumn("_turn", F.coalesce(F.col("turn").cast("string"), F.lit("null")))
    own = prefix_sums(many, ["_conv", "block", "_turn", "role"], text_order(F.col("text")), [F.col("text")], {"_upto": F.col("_copies")})
    parts = many.groupBy("_conv", "block", "turn", "_turn", "role").agg(F.sum("_copies").alias("_n"))
    starts = prefix_sums(parts, ["_conv", "block"], F.coalesce(F.col("turn").cast("double"), F.lit(float("-inf"))), order[:2], {"_end": F.col("_n")})
    starts = starts.select("_conv", "block", "_turn", "role", (F.col("_end") - F.col("_n")).alias("_before"))
    summed = own.join(starts, ["_conv", "block", "_turn", "role"]).withColumn("_upto", F.col("_before") + F.col("_upto"))
    at = F.explode(F.sequence(F.col("_upto") - F.col("_copies"), F.col("_upto") - 1)).alias("place")
    return few.select(*turns.columns, "place").unionByName(summed.select(*turns.columns, at))


def rotate(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", context: tuple[str, ...] = CONTEXT_ROLES, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, block, part, n_turns, text, masks: the rendering of each dialogue for each of its participants.

    Blocks are in the order of (block, part).
    """
    id_type = conversations.schema[id_col].dataType.simpleString()
    turns = conversations.select(F.col(id_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    turns = turns.withColumn("block", F.coalesce(F.floor(F.col("turn") / block_turns).cast("long"), F.lit(NULL_BLOCK)))
    placed = _placed(turns).withColumn("part", F.floor(F.col("place") / block_turns).cast("long"))
    blocks = placed.groupBy("conv_id", "block", "part").agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"))
    speakers = turns.where(~F.col("role").isin(*context)).select("conv_id", F.col("role").alias("perspective")).distinct()
    # dialogues of very many turns meet their speakers by salts
    large = F.broadcast(_large(turns, ["conv_id"]))
    blocks = _marked(blocks, large, ["conv_id"]).withColumn("salt", F.when(F.col("_large"), F.pmod(F.xxhash64("block", "part"), F.lit(SALTS))).otherwise(0))
    salts = F.when(F.col("_large"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    speakers = _marked(speakers, large, ["conv_id"]).select("conv_id", "perspective", F.explode(salts).alias("salt"))
    each = blocks.alias("b").join(speakers.alias("s"), F.col("b.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("b.salt") == F.col("s.salt"))).select("b.conv_id", "perspective", "block", "part", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            texts, masks, sizes = [], [], []
            for speaker, own in zip(batch.column("perspective").to_pylist(), batch.column("turns").to_pylist(), strict=True):
                text, spans = render([(x["role"], x["text"]) for x in own], speaker, context)
                texts.append(text)
                masks.append([{"start": a, "end": b} for a, b in spans])
                sizes.append(len(own))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv_id", "perspective", "block", "part")], pa.array(sizes, pa.int64()), pa.array(texts, pa.string()), pa.array(masks, spans_type)], ["conv_id", "perspective", "block", "part", "n_turns", "text", "masks"])

    return each.mapInArrow(run, f"conv_id {id_type}, perspective string, block long, part long, n_turns long, text string, masks array<struct<start:long,end:long>>")


def op10_chat(spark, sf_dir: str) -> DataFrame:
    """All conversations from the perspective of each participant; masked_chars is the length of what is trained on."""
    out = rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    masked = F.aggregate("masks", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return out.select("conv_id", "perspective", "block", "part", "n_turns", F.length("text").cast("long").alias("n_chars"), masked.alias("masked_chars"), F.sha2("text", 256).alias("text_sha256"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text, replace(replace(coalesce(text, ''), '<|', '<\|'), '|>', '|\>') AS body,
         replace(replace(replace(replace(coalesce(role, 'unknown'), '<|', '<\|'), '|>', '|\>'), chr(10), '\n'), chr(13), '\r') AS name,
         coalesce(CAST(floor(turn / 32) AS BIGINT), -1152921504606846976) AS block FROM conversations),
p AS (SELECT *, (row_number() OVER (PARTITION BY conv_id, block ORDER BY turn NULLS FIRST, role, text) - 1) // 32 AS part FROM t),
s AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
r AS (
  SELECT p.conv_id, perspective, block, part, turn, role, text, body,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN name ELSE 'user name=' || name END || chr(10) AS head
  FROM p JOIN s ON p.conv_id IS NOT DISTINCT FROM s.conv_id),
g AS (
  SELECT conv_id, perspective, block, part, count(*) AS n_turns, string_agg(head || body || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS rendered,
         sum(CASE WHEN role = perspective THEN length(body) + 11 ELSE 0 END) AS masked
  FROM r GROUP BY ALL)
SELECT conv_id, perspective, block, CAST(part AS BIGINT) AS part, CAST(n_turns AS BIGINT) AS n_turns, CAST(length(rendered) AS BIGINT) AS n_chars,
       CAST(masked AS BIGINT) AS masked_chars, sha256(rendered) AS text_sha256 FROM g
"""
