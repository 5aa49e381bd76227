"""Exact dedup by two passes over a Bloom filter: the first finds hashes that may be repeated, the second lets all other rows pass straight through.

Texts are equal when they are identical after A-Z are lower-cased; they are told apart by SHA-256. The first pass counts, for every
hash, its PROBES cells in the page that the hash names, map side first; cells that were met twice or more make the filter, pages of 32,768
bits. In the second pass a row all of whose cells are set may be repeated: only such rows are shuffled, grouped by hash and
compared; every other row is the only one of its text. A filter can't miss a repeated hash, and a hash that it takes for
repeated by mistake turns out to be alone in its group, so the result is exact whatever the filter's size.

The filter has CELLS_PER_ROW cells for each row and is broadcast PAGES_AT_ONCE pages (64 MB) at a time: the hashes of all rows are stored in
files sorted by hash, so each slice of pages reads the part of every file that belongs to it. Hot groups are counted map side
and their results broadcast (see ``shared.joined_by_group``), so a text that a third of all rows share meets in no task.
Only DataFrame functions run.

Nulls, ties, and so on: a null text is an empty one; a null id comes before all others, so such a row stays only where its whole group has none; of rows
alike in text and id exactly one stays; very long texts are hashed in their own row; an empty table gives an empty result; other columns
don't matter to :func:`classes` and are kept by :func:`deduplicate`, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from chronopanel.llm.shared import joined_by_group
from chronopanel.sources.tables import temporary, written

PAGE_BITS = 32768
PROBES, CELLS_PER_ROW = 3, 16
#: Pages that are broadcast together: 64 MB.
PAGES_AT_ONCE = 16384


def lowered(text: Column) -> Column:
    """A-Z lower-cased, nothing else; null is empty."""
    text = F.coalesce(text, F.lit(""))
    # of a text of ASCII only, lower() changes the same letters, and faster
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def _sha(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(lowered(text), "UTF-8"), 256))


def _place(sha: str) -> Column:
    """31 bits of a hash: rows in their order are in the order of pages, whatever the number of pages."""
    return F.shiftrightunsigned(F.xxhash64(sha), 33).cast("int")


def _page(place: str, pages: int) -> Column:
    return F.shiftright(F.col(place).cast("long") * pages, 31).cast("int")


def _cells(sha: str) -> list[Column]:
    h = F.xxhash64(sha, F.lit(1))
    return [F.shiftright(h, 15 * i).bitwiseAND(F.lit(PAGE_BITS - 1)).cast("int") for i in range(PROBES)]


def repeated_cells(hashes: DataFrame, pages: int) -> DataFrame:
    """(page, bits): the cells that rows of hashes (_sha, _place) meet at least twice, as bitmaps; pages without any are left out."""
    met = hashes.select(_page("_place", pages).alias("page"), F.explode(F.array(*_cells("_sha"))).alias("cell")).groupBy("page", "cell").agg(F.count("*").alias("n"))
    return met.where("n > 1").select("page", "cell").repartition("page").groupBy("page").agg(F.bitmap_construct_agg("cell").alias("bits"))


def set_cells(hashes: DataFrame, pages: int) -> DataFrame:
    """(page, bits): all cells of hashes (_sha, _place)."""
    met = hashes.select(_page("_place", pages).alias("page"), F.explode(F.array(*_cells("_sha"))).alias("cell")).distinct()
    return met.repartition("page").groupBy("page").agg(F.bitmap_construct_agg("cell").alias("bits"))


def with_maybe(rows: DataFrame, filter_pages: DataFrame, pages: int) -> DataFrame:
    """rows (_sha, _place, …) with _maybe: whether all cells of the hash are set in the filter, whose pages are broadcast."""
    joined = rows.withColumn("_page", _page("_place", pages)).join(F.broadcast(filter_pages.select(F.col("page").alias("_page"), F.col("bits").alias("_bits"))), "_page", "left")
    byte = lambda cell: F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(cell, 3) + 1, F.lit(1))), 16, 10).cast("int")
    is_set = [F.getbit(byte(c), c.bitwiseAND(F.lit(7))) == 1 for c in _cells("_sha")]
    return joined.withColumn("_maybe", F.col("_bits").isNotNull() & reduce(Column.__and__, is_set)).drop("_bits", "_page")


def _found(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Rows (_id, _sha, _place, _row) that are alone by the filter; those that may not be; of these the groups (_sha, _keep, _n) of two or more; the number of the second."""
    slim = docs.select(F.col(f"`{id_col}`").alias("_id"), _sha(F.col(f"`{text_col}`")).alias("_sha")).withColumn("_place", _place("_sha"))
    slim = written(slim.sortWithinPartitions("_place").withColumn("_row", F.monotonically_increasing_id()), "exact-hashes", keep=True)
    pages = max(1, -(-slim.count() * CELLS_PER_ROW // PAGE_BITS))
    alone, maybe = [], []
    for first in range(0, pages, PAGES_AT_ONCE):
        last = min(pages, first + PAGES_AT_ONCE)
        # the places whose page is in [first, last)
        part = slim.where((F.col("_place") >= -(-first * 2**31 // pages)) & (F.col("_place") < -(-last * 2**31 // pages)))
        own = written(repeated_cells(part, pages), "exact-filter", keep=True)
        held = with_maybe(part, own, pages)
        alone.append(held.where(~F.col("_maybe")).drop("_maybe"))
        maybe.append(held.where("_maybe").drop("_maybe"))
    some = written(reduce(DataFrame.unionAll, maybe), "exact-maybe", keep=True)
    groups = some.groupBy("_sha").agg(F.max(F.struct("_id", "_row")).alias("_keep"), F.count("*").alias("_n")).where("_n > 1")
    return reduce(DataFrame.unionAll, alone), some, written(groups, "exact-groups", keep=True), some.count()


def classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; passed: whether it went straight through."""
    with temporary(docs.sparkSession):
        alone, some, groups, total = _found(docs, id_col, text_col)
    sha = F.lower(F.hex("_sha")).alias("text_sha256")
    straight = alone.select(F.col("_id").alias("doc_id"), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha, F.lit(True).alias("passed"))
    met = joined_by_group(some, groups, "_sha", "_n", total)
    single = F.col("_n").isNull()
    compared = met.select(
        F.col("_id").alias("doc_id"), F.when(single, F.col("_id")).otherwise(F.col("_keep")["_id"]).alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("_keep")["_row"] == F.col("_row"))).alias("kept"), sha, F.lit(False).alias("passed"),
    )
    return straight.unionAll(compared)


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts that with the largest id.

    A second filter holds the hashes that are really repeated; rows that it doesn't know pass straight through, whole; the
    others are held against the groups, and only those with the id that stays are shuffled with their texts. It has PAGES_AT_ONCE pages at
    most; where the repeated hashes are too many for it, more rows take the second way, and the result is the same.
    """
    with temporary(docs.sparkSession):
        _, _, groups, total = _found(docs, id_col, text_col)
        repeated = groups.select("_sha").withColumn("_place", _place("_sha"))
        pages = min(PAGES_AT_ONCE, max(1, -(-groups.count() * CELLS_PER_ROW // PAGE_BITS)))
        known = written(set_cells(repeated, pages), "exact-repeated", keep=True)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), _sha(F.col(f"`{text_col}`")).alias("_sha"), F.col(f"`{id_col}`").alias("_id")).withColumn("_place", _place("_sha"))
    held = with_maybe(rows, known, pages)
    met = joined_by_group(held.where("_maybe").drop("_maybe", "_place"), groups, "_sha", "_n", total)
    single = met.where("_n is null").select("_doc")
    chosen = met.where(F.col("_n").isNotNull() & F.col("_id").eqNullSafe(F.col("_keep")["_id"])).groupBy("_sha").agg(F.first("_doc").alias("_doc")).select("_doc")
    return held.where(~F.col("_maybe")).select("_doc").unionAll(single).unionAll(chosen).select("_doc.*")


def op11_exact(spark, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all documents."""
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("passed")


OP11_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d
"""
