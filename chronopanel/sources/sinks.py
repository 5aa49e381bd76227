"""Small outputs of a run: files that appear only when complete, hashes, and a manifest; in any file system."""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
import platform
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from chronopanel.sources import files


def write_json(spark: SparkSession, path: str, value) -> None:
    files.write_text(spark, path, json.dumps(value, indent=2, default=str))


def write_table(df: DataFrame, path: str) -> None:
    """A report as one CSV file with a header, in the order of df; one task streams it. Large tables go to ``df.write``."""
    spark = df.sparkSession
    unfinished = f"{path}.{uuid.uuid4().hex}.tmp"
    df.coalesce(1).write.option("header", True).csv(unfinished)
    (part,) = files.listed(spark, f"{unfinished}/part-*")
    files.replaced(spark, part, path)
    files.remove(spark, unfinished)


def software(spark: SparkSession) -> dict[str, str]:
    """Versions of what a run used."""
    out = {"python": platform.python_version(), "spark": spark.version}
    for name in ("pyspark", "pyarrow", "pandas", "numpy"):
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = "absent"
    return out


def file_hashes(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """SHA-256 by path."""
    return {r["path"]: r["sha256"] for r in files.hashes(spark, paths).collect()} if paths else {}


def local_hash(path) -> str:
    """SHA-256 of a file of this machine, such as a module of this package."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def manifest(spark: SparkSession, stage: str, status: str, inputs: dict[str, str], code: dict[str, str], config: dict) -> dict:
    """What a stage ran on, for the record; also of failed runs."""
    text = json.dumps(config, sort_keys=True, default=str)
    return {"timestamp": datetime.now(UTC).isoformat(), "stage": stage, "status": status, "inputs": inputs, "code": code, "config_sha256": hashlib.sha256(text.encode()).hexdigest(), "software": software(spark)}
