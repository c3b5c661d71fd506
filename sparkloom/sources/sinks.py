"""Sinks: run records, reports, artifacts with metadata, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def append_runs(runs: DataFrame, path: str) -> None:
    """Adds run records to a folder of JSON lines."""
    runs.write.mode("append").json(path)


def write_report(report: DataFrame, path: str) -> None:
    """A one-row report as one JSON file."""
    report.coalesce(1).write.mode("overwrite").json(path)


def store_artifacts(artifacts: DataFrame, path: str) -> None:
    """Contents and their metadata (artifact_id, owner, format, mime_type, filename, content) as Parquet by format."""
    artifacts.withColumn("size", F.octet_length("content")).write.mode("append").partitionBy("format").parquet(path)


def retained(entries: DataFrame, most: int) -> DataFrame:
    """Cache entries (key, modified) beyond the newest ``most``: those to delete."""
    keep = entries.orderBy(F.desc("modified"), "key").limit(most).select("key")
    return entries.join(keep, "key", "left_anti")


def latest_per_key(entries: DataFrame) -> DataFrame:
    return entries.withColumn("nth", F.row_number().over(W.partitionBy("key").orderBy(F.desc("modified")))).filter("nth = 1").drop("nth")
