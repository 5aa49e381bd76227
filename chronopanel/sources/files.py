"""Files and folders in whatever file system a path names, through Hadoop's interface, so that stages also run on remote folders."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _at(spark: SparkSession, path: str):
    """Hadoop's file system and path."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def listed(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, in order."""
    fs, at = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(at) or [])


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def replaced(spark: SparkSession, unfinished: str, path: str) -> None:
    """Give a finished file its name; a file that had it goes."""
    fs, at = _at(spark, path)
    fs.mkdirs(at.getParent())
    fs.delete(at, True)
    if not fs.rename(_at(spark, unfinished)[1], at):
        raise OSError(f"{unfinished} can't be renamed to {path}")


def copy(spark: SparkSession, path: str, to: str) -> None:
    fs, at = _at(spark, path)
    other, target = _at(spark, to)
    other.mkdirs(target.getParent())
    if not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, other, target, False, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{path} can't be copied to {to}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears only when complete."""
    unfinished = f"{path}.{uuid.uuid4().hex}.tmp"
    fs, at = _at(spark, unfinished)
    fs.mkdirs(at.getParent())
    out = fs.create(at, True)
    out.write(bytearray(text.encode()))
    out.close()
    replaced(spark, unfinished, path)


def hashes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, or of all files in folders; read by tasks."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    return read.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def digest(df: DataFrame, *settings: object) -> str:
    """16 hex digits that stand for df's rows, in any order, and for settings: a table by this name belongs to them and to no others."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    part = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(38,0)"))
    whole = df.agg(F.count("*"), part(1), part(16), part(31), part(46)).first()
    return hashlib.sha256(repr((sorted(df.dtypes), tuple(whole), settings)).encode()).hexdigest()[:16]
