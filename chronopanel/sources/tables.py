"""Tables between steps, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from chronopanel.sources import files

_scopes: list[list[str]] = []


def shared_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new path under ``spark.checkpoint.dir``; within :func:`temporary` it goes at the end, unless it's kept.

    Where the setting is missing, a local master gets a temporary folder of this machine, as in tests; any other raises, since executors
    elsewhere would write to their own disks.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="checkpoints-")
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes and not keep:
        _scopes[-1].append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """df as a Parquet table in the shared folder: its lineage ends there, so lost executors cost no more than a reread."""
    spark = df.sparkSession
    path = shared_path(spark, name, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Tables written in this scope and not kept are deleted at its end. What is returned from it must rest on kept ones only."""
    own: list[str] = []
    _scopes.append(own)
    try:
        yield
    finally:
        _scopes.remove(own)
        for path in own:
            files.remove(spark, path)
