"""A training corpus out of ``documents``: toxic documents go, one document of each group of near copies stays,
contaminated ones go, sources are mixed to their target weights, and what is left is dealt into shards.

Every stage takes nulls in any column, empty and very long texts, ties and repeated rows, an empty table, and further columns of any
name; what it does with them its docstring says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronopanel.llm import decontamination, jaccard, mixing, sharding, toxicity
from chronopanel.sources.files import remove
from chronopanel.sources.tables import shared_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7, with all their columns.

    Null and empty texts have the score of no words, which is low; long texts are scored in all their windows; repeated rows stay or go together;
    ids may be null; without labels of both classes everything stays; an empty table stays empty.
    """
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document by id of each component of links: sets of 5-word shingles of a similarity of 0.8 or more; all columns.

    Null texts and texts without words are copies of nothing and all stay, also where ids are null or rows repeated; of other
    repeated rows one stays; ids that tie are told apart by a hash of the text; a null id comes last; an empty table stays empty.
    """
    return jaccard.one_of_each(docs, n=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover less than a twentieth, with all their columns.

    Null and empty texts have no windows and stay; long texts are scanned whole; repeated rows stay or go together; an empty table stays
    empty, and with an empty benchmark everything stays.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, with all their columns.

    A null source is a source; null and empty texts weigh nothing and are taken as often as their source's whole epochs, or once more;
    repeated rows and null ids are taken one by one; an empty table stays empty.
    """
    return mixing.mix(docs)


def deal_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of each document of the mix (doc_id, size, text_crc32, law, shard, slot, grown_shard).

    Rows count one by one, whether ids are null or rows repeated; copies gather in shards, and null texts are copies of nothing; an empty table
    stays empty; further columns are left out.
    """
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("jaccard_join", one_of_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", deal_into_shards),
]

#: SQL has neither the network nor the propagation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet in the shared folder and read again by the next; a stage's table goes when the next one's is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = shared_path(spark, f"pipeline-{name}", keep=True)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
