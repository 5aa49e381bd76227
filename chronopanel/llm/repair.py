"""Repair of conversation structure: the cheapest edits that make a conversation's roles an optional system turn and pairs of user and assistant.

Windows find each row's fault (blank, duplicate, truncated). A conversation's rows are collected as sorted structs, and one
``aggregate()`` carries, for each of four states (nothing yet, after a system turn, after a user, after an assistant), the cheapest
(cost, audit) that leads there; ``least`` compares structs, so of equal costs the least audit wins. That is exact: two audits of
the same rows that lead to the same place in the rows can't be one another's beginning, so what follows doesn't change
their order. With the audit goes a plan that says the roles, from which the repaired text is put together.

A conversation of more than MOST_TURNS rows or MOST_BYTES bytes isn't collected: its rows are numbered slice by slice and folded in blocks of
BLOCK_TURNS from each of the four states, without their texts; the blocks' four times four results are joined a FAN at a time, level by level; each row
gets its part of the plan back by its number, and the repaired lines stream through a running SHA-256. What such a conversation
has in one row is its audit, as the result asks for.

Nulls, ties, and so on: a null role or text, or an id or turn within a hashed name, is one space; null turns come first; equal turns are ordered by role
and text; a null id is a conversation; repeated rows are rows; an initial is a role's first character, and an empty role has none, so it can't be kept; a very long text is
only compared, cut and hashed; an empty table gives an empty result; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from chronopanel.operators.ordered import prefix_sums
from chronopanel.sources.tables import temporary, written

#: What a conversation that is collected may have.
MOST_TURNS, MOST_BYTES = 4096, 32_000_000
BLOCK_TURNS, FAN = 1024, 64
SPACE = " \t\n\x0b\x0c\r"
STATES = ("e", "s", "u", "a")
NEVER = 1 << 40
#: Costs of edits, and of a truncated row that stays.
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: A plan has, for each letter of the audit, an inserted role (U, A), a new one (u, a), a kept row (k) or a deleted one (d).
TOKEN = "[UA]*[uakd]"


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, present: rows damaged by crc32(``conv_id:turn``) % 20; one that is dropped stays as a mark that isn't present."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1]).cast("binary")) % 20
    copies = F.when(kind == 0, F.array().cast("array<int>")).when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *[F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")])
    rows = rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode_outer(copies).alias("_copy"))
    return rows.withColumn("present", F.col("_copy").isNotNull()).drop("_copy")


def _flagged(rows: DataFrame, repeated: Column) -> DataFrame:
    """rows with initial, blank, duplicate, truncated: the first fault of each."""
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    rows = rows.withColumn("initial", F.substring("role", 1, 1)).withColumn("blank", F.col("present") & (end == ""))
    rows = rows.withColumn("duplicate", F.col("present") & ~F.col("blank") & repeated)
    return rows.withColumn("truncated", F.col("present") & ~F.col("blank") & ~F.col("duplicate") & ~F.right(end, F.lit(1)).isin(".", "!", "?"))


def _legal(before: Column, initial: Column) -> Column:
    return F.concat(before, initial).isin("su", "ua", "au")


def _way(cost: Column, audit: Column, plan: Column) -> Column:
    return F.struct(cost.cast("long").alias("cost"), audit.alias("audit"), plan.alias("plan"))


def _then(way: Column, cost, audit, plan) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return _way(way["cost"] + lit(cost), F.concat(way["audit"], lit(audit)), F.concat(way["plan"], lit(plan)))


def _vector(ways: dict[str, Column]) -> Column:
    return F.struct(*[ways[s].alias(s) for s in STATES])


def _start(at: str) -> Column:
    return _vector({s: _way(F.lit(0 if s == at else NEVER), F.lit(""), F.lit("")) for s in STATES})


def _with_inserts(v: Column) -> dict[str, Column]:
    """The cheapest way to each state when one or two turns may be inserted."""
    e, s, u, a = (v[x] for x in STATES)
    one = lambda way, role: _then(way, INSERT, "I", role)
    return {"e": e, "s": s, "u": F.least(u, one(e, "U"), one(s, "U"), one(a, "U")), "a": F.least(a, one(u, "A"), *[_then(x, 2 * INSERT, "II", "UA") for x in (e, s)])}


def _folded(rows: Column, start: Column) -> Column:
    """Four ways through rows of (…, initial, faulty, truncated), from a vector of four."""

    def step(v: Column, x: Column) -> Column:
        w = _with_inserts(v)
        stays = F.when(x["faulty"], NEVER).when(x["truncated"], CUT).otherwise(0)
        dropped = {s: _then(w[s], DELETE, "D", "d") for s in STATES}

        def into(initial: str) -> tuple[Column, Column, Column]:
            same = x["initial"] == initial
            return stays + F.when(same, 0).otherwise(REROLE), F.when(same, "K").otherwise("R"), F.when(same, "k").otherwise(initial)

        system = F.when(x["initial"] == "s", stays).otherwise(NEVER)
        return _vector({
            "e": dropped["e"],
            "s": F.least(dropped["s"], _then(w["e"], system, "K", "k")),
            "u": F.least(dropped["u"], *[_then(w[s], *into("u")) for s in ("e", "s", "a")]),
            "a": F.least(dropped["a"], _then(w["u"], *into("a"))),
        })

    return F.aggregate(rows, start, step)


def _best(v: Column) -> Column:
    w = _with_inserts(v)
    return F.least(w["e"], w["a"])


def _line(token: Column, role: Column, text: Column) -> Column:
    """The lines of a token: inserted turns, then the row's own unless it is deleted; each with its line break."""
    inserted = F.replace(F.replace(F.regexp_replace(token, "[uakd]", ""), F.lit("U"), F.lit("user:\n")), F.lit("A"), F.lit("assistant:\n"))
    last = F.right(token, F.lit(1))
    own = F.when(last == "k", role).when(last == "u", "user").when(last == "a", "assistant")
    return F.concat(inserted, F.when(own.isNotNull(), F.concat(own, F.lit(":"), text, F.lit("\n"))).otherwise(""))


RESULT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_NONE = hashlib.sha256(b"").hexdigest()


def _small(rows: DataFrame) -> DataFrame:
    """The result of conversations that fit in a row: one shuffle by id serves both windows and the grouping."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    dealt = rows.repartition("conv_id")
    again = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    dealt = dealt.withColumn("_again", again)
    dealt = _flagged(dealt, F.col("_again"))
    before = F.lag("initial").over(Window.partitionBy("conv_id", "present").orderBy(*order, "_again"))
    dealt = dealt.withColumn("illegal", F.col("present") & F.coalesce(~_legal(before, F.col("initial")), F.lit(False)))
    one = F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn", "role", "text", F.col("_again").alias("again"), "initial", (F.col("blank") | F.col("duplicate")).alias("faulty"), "truncated")
    names = ("blank", "duplicate", "truncated", "illegal")
    each = dealt.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.when(F.col("present"), one))).alias("rows"), *[F.sum(F.col(c).cast("long")).alias(c) for c in names])
    turns = F.filter(F.transform("rows", lambda x: x["turn"]), lambda t: t.isNotNull())
    each = each.withColumn("gaps", F.when(F.size(turns) > 0, F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns))).otherwise(0).cast("long"))
    each = each.withColumn("way", _best(_folded(F.col("rows"), _start("e"))))
    # a last token of inserted turns has no row
    tokens = F.regexp_extract_all(F.col("way")["plan"], F.lit(f"{TOKEN}|[UA]+"), 0)
    at = lambda i: F.get("rows", i)
    lines = F.transform(tokens, lambda t, i: _line(t, F.coalesce(at(i)["role"], F.lit("")), F.coalesce(at(i)["text"], F.lit(""))))
    whole = F.array_join(lines, "")
    repaired = F.substring(whole, F.lit(1), F.greatest(F.char_length(whole) - 1, F.lit(0)))
    out = each.withColumn("repaired_sha256", F.sha2(repaired.cast("binary"), 256)).withColumns({"cost": F.col("way")["cost"], "audit": F.col("way")["audit"]})
    return out.select(*RESULT)


def _joined(ways: DataFrame) -> DataFrame:
    """(_conv, m): the four times four ways of each conversation's blocks, joined a FAN at a time until one is left."""
    def through(v: Column, m: Column) -> Column:
        def into(j: str) -> Column:
            return F.least(*[_then(v[i], m[i][j]["cost"], m[i][j]["audit"], m[i][j]["plan"]) for i in STATES])

        # ways that can't be had keep no text
        bounded = lambda w: F.when(w["cost"] >= NEVER, _way(F.lit(NEVER), F.lit(""), F.lit(""))).otherwise(w)
        return _vector({j: bounded(into(j)) for j in STATES})

    while (most := ways.agg(F.max("block")).first()[0]) is not None:
        grouped = ways.groupBy("_conv", F.floor(F.col("block") / FAN).alias("block")).agg(F.sort_array(F.collect_list(F.struct(F.col("block").alias("at"), "m"))).alias("parts"))
        all_starts = F.struct(*[F.aggregate("parts", _start(s), lambda v, p: through(v, p["m"])).alias(s) for s in STATES])
        ways = written(grouped.select("_conv", "block", all_starts.alias("m")), "repair-ways")
        if most < FAN:
            break
    return ways.select("_conv", "m")


def _digests(lines: DataFrame, partitions: int) -> DataFrame:
    """(_conv, repaired_sha256): the SHA-256 of each conversation's lines, read in order and never held."""
    dealt = lines.select("_conv", "_rn", "line").repartition(partitions, "_conv").sortWithinPartitions("_conv", "_rn")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done():
            return pa.RecordBatch.from_arrays([pa.array([now], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["_conv", "repaired_sha256"])

        now, digest, begun = None, hashlib.sha256(), False
        for batch in batches:
            for conv, line in zip(batch.column("_conv").to_pylist(), batch.column("line").to_pylist(), strict=True):
                if conv != now:
                    if now is not None:
                        yield done()
                    now, digest, begun = conv, hashlib.sha256(), False
                if line:  # its line break goes before what follows
                    digest.update((b"\n" if begun else b"") + line[:-1].encode())
                    begun = True
        if now is not None:
            yield done()

    return dealt.mapInArrow(run, "_conv string, repaired_sha256 string")


def _large(rows: DataFrame) -> DataFrame:
    """The result of conversations of any size: no task holds one's rows."""
    rows = rows.withColumn("_conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))).withColumn("_row", F.monotonically_increasing_id())
    rows = written(rows, "repair-rows")
    there = rows.where("present").withColumn("_text", F.sha2(F.col("text").cast("binary"), 256))
    place = F.struct(F.col("turn").isNotNull().alias("has_turn"), "turn", "_row")
    first = there.groupBy("_conv", "role", "_text").agg(F.min(place).alias("_first"))
    flagged = written(_flagged(there.join(first, ["_conv", "role", "_text"]), place > F.col("_first")).drop("_first", "_text"), "repair-flags")
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("_row")]
    numbered = prefix_sums(flagged, ["_conv"], F.coalesce(F.col("turn").cast("double"), F.lit(float("-inf"))), order, {"_rn": F.lit(1).cast("long")})
    numbered = written(numbered.withColumn("block", F.floor((F.col("_rn") - 1) / BLOCK_TURNS)), "repair-numbers")
    one = F.struct("_rn", "initial", (F.col("blank") | F.col("duplicate")).alias("faulty"), "truncated")
    names = ("blank", "duplicate", "truncated")
    counts = [F.sum(F.col(c).cast("long")).alias(c) for c in names]
    blocks = numbered.groupBy("_conv", "block").agg(F.sort_array(F.collect_list(one)).alias("rows"), *counts)
    all_starts = F.struct(*[_folded(F.col("rows"), _start(s)).alias(s) for s in STATES])
    pairs = F.size(F.filter(F.sequence(F.lit(2), F.size("rows")), lambda i: ~_legal(F.element_at("rows", i - 1)["initial"], F.element_at("rows", i)["initial"])))
    edges = [F.when(F.size("rows") > 1, pairs).otherwise(0).cast("long").alias("illegal"), F.element_at("rows", 1)["initial"].alias("_head"), F.element_at("rows", -1)["initial"].alias("_tail")]
    blocks = written(blocks.select("_conv", "block", *names, *edges, all_starts.alias("m")), "repair-blocks")
    between = F.coalesce(~_legal(F.lag("_tail").over(Window.partitionBy("_conv").orderBy("block")), F.col("_head")), F.lit(False)).cast("long")
    counted = blocks.select("_conv", *names, (F.col("illegal") + between).alias("illegal")).groupBy("_conv").agg(*[F.sum(c).alias(c) for c in (*names, "illegal")])
    known = numbered.where("turn is not null").select("_conv", "turn").distinct().groupBy("_conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    ways = written(_joined(blocks.select("_conv", "block", "m")).select("_conv", _best(F.col("m")["e"]).alias("way")), "repair-best")
    pieces = ways.select("_conv", F.posexplode(F.regexp_extract_all(F.col("way")["plan"], F.lit(f"(?:{TOKEN}){{1,{BLOCK_TURNS}}}|[UA]+"), 0)).alias("piece", "part"))
    tokens = pieces.select("_conv", "piece", F.posexplode(F.regexp_extract_all("part", F.lit(f"{TOKEN}|[UA]+"), 0)).alias("at", "token"))
    # a last piece of inserted turns comes after all rows
    after = F.when(F.col("token").rlike("[uakd]"), F.col("piece") * BLOCK_TURNS + F.col("at") + 1).otherwise(1 << 60).alias("_rn")
    lines = tokens.select("_conv", after, "token").join(numbered.select("_conv", "_rn", "role", "text"), ["_conv", "_rn"], "left")
    lines = lines.select("_conv", "_rn", _line(F.col("token"), F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))).alias("line"))
    hashes = _digests(lines, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = rows.groupBy("_conv").agg(F.first("conv_id").alias("conv_id")).join(counted, "_conv", "left").join(known, "_conv", "left").join(ways, "_conv", "left").join(hashes, "_conv", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", *names, "illegal")]
    out = out.select("conv_id", *zero, F.coalesce(F.col("way")["cost"], F.lit(0)).cast("long").alias("cost"), F.coalesce(F.col("way")["audit"], F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(_NONE)).alias("repaired_sha256"))
    return written(out, "repair-large", keep=True).select(*RESULT)


def repair(rows: DataFrame, *, most_turns: int = MOST_TURNS, most_bytes: int = MOST_BYTES) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation of rows (conv_id, turn, role, text, present)."""
    spark = rows.sparkSession
    counts = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.octet_length("text") + F.octet_length("role")).alias("bytes"))
    with temporary(spark):
        large = written(counts.where((F.col("n") > most_turns) | (F.col("bytes") > most_bytes)).select(F.col("conv_id").alias("_large")), "repair-sizes", keep=True)
        if large.isEmpty():
            return _small(rows)
        same = F.col("conv_id").eqNullSafe(F.col("_large"))
        return _small(rows.join(large, same, "left_anti")).unionByName(_large(rows.join(large, same, "left_semi")))


def op12_repair(spark, sf_dir: str) -> DataFrame:
    """Repair all conversations, damaged by the hash of their turns."""
    return repair(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")))


def _sql() -> str:
    """The same edits by a recursive walk along each conversation's rows, with four structs (cost, audit, plan)."""

    def then(way: str, cost: str | int, audit: str, plan: str) -> str:
        return f"struct_pack(c := {way}.c + {cost}, d := {way}.d || {audit}, p := {way}.p || {plan})"

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    insert = lambda way, role: then(way, INSERT, "'I'", f"'{role}'")
    inserted = {
        "e": "w.e", "s": "w.s", "u": least("w.u", insert("w.e", "U"), insert("w.s", "U"), insert("w.a", "U")),
        "a": least("w.a", insert("w.u", "A"), then("w.e", 2 * INSERT, "'II'", "'UA'"), then("w.s", 2 * INSERT, "'II'", "'UA'")),
    }

    def into(way: str, initial: str) -> str:
        same = f"f.initial = '{initial}'"
        return then(way, f"(f.stays + CASE WHEN {same} THEN 0 ELSE {REROLE} END)", f"CASE WHEN {same} THEN 'K' ELSE 'R' END", f"CASE WHEN {same} THEN 'k' ELSE '{initial}' END")

    dropped = {s: then(f"w.{s}", DELETE, "'D'", "'d'") for s in STATES}
    system = then("w.e", f"CASE WHEN f.initial = 's' THEN f.stays ELSE {NEVER} END", "'K'", "'k'")
    steps = {"e": dropped["e"], "s": least(dropped["s"], system), "u": least(dropped["u"], *[into(f"w.{s}", "u") for s in "esa"]), "a": least(dropped["a"], into("w.u", "a"))}
    start = lambda s: f"struct_pack(c := CAST({0 if s == 'e' else NEVER} AS BIGINT), d := '', p := '') AS {s}"
    space = r"[\x20\x09-\x0D]"
    return f"""
WITH RECURSIVE
k AS (
  SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS g, conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         [ascii(x) FOR x IN string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), '')] AS b
  FROM conversations),
m AS (
  SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda h, y: list_reduce(list_concat([xor(h, CAST(y AS BIGINT))], range(8)),
            lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 20 AS m FROM k),
r AS (
  SELECT g, turn, CASE WHEN m = 4 THEN 'user' ELSE role END AS role, CASE m WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE m WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM m),
q AS (
  SELECT *, left(role, 1) AS initial, right(regexp_replace(text, '{space}+$', ''), 1) AS last, row_number() OVER (PARTITION BY g, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again FROM r),
f AS MATERIALIZED (
  SELECT *, row_number() OVER o AS i, last = '' AS blank, last <> '' AND again AS duplicate, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated,
         coalesce(lag(initial) OVER o || initial NOT IN ('su', 'ua', 'au'), false) AS illegal,
         CASE WHEN last = '' OR again THEN {NEVER} WHEN last NOT IN ('.', '!', '?') THEN {CUT} ELSE 0 END AS stays
  FROM q WINDOW o AS (PARTITION BY g ORDER BY turn NULLS FIRST, role, text, again)),
w AS (
  SELECT DISTINCT g, CAST(0 AS BIGINT) AS i, {", ".join(map(start, STATES))} FROM k
  UNION ALL
  SELECT w.g, f.i, {", ".join(f"{steps[s]} AS {s}" for s in STATES)}
  FROM (SELECT w.g, w.i, {", ".join(f"{inserted[s]} AS {s}" for s in STATES)} FROM w) w JOIN f ON f.g = w.g AND f.i = w.i + 1),
z AS (SELECT g, {least("w.e", inserted["a"])} AS z FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY g ORDER BY i DESC) = 1) w),
t AS (SELECT g, z, unnest(regexp_extract_all(z.p, '{TOKEN}|[UA]+')) AS t, generate_subscripts(regexp_extract_all(z.p, '{TOKEN}|[UA]+'), 1) AS i FROM z),
l AS (
  SELECT t.g, t.i, replace(replace(regexp_replace(t, '[uakd]', '', 'g'), 'U', 'user:' || chr(10)), 'A', 'assistant:' || chr(10)) ||
         CASE right(t, 1) WHEN 'k' THEN role || ':' || text || chr(10) WHEN 'u' THEN 'user:' || text || chr(10) WHEN 'a' THEN 'assistant:' || text || chr(10) ELSE '' END AS line
  FROM t LEFT JOIN f ON f.g = t.g AND f.i = t.i),
h AS (SELECT g, string_agg(line, '' ORDER BY i) AS whole FROM l GROUP BY g),
n AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal FROM f GROUP BY g)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       z.c AS cost, z.d AS audit, sha256(coalesce(whole[:-2], '')) AS repaired_sha256
FROM (SELECT DISTINCT g, conv_id FROM k) JOIN z USING (g) LEFT JOIN n USING (g) LEFT JOIN h USING (g)
"""


OP12_SQL = _sql()
