"""Run records as streams: appended as they are, and rolled up by windows of their time.

Both write a folder per batch and replace it whole, so that a batch that is replayed after a failure is not doubled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkloom.operators.kpi import ratio


def by_batch(path: str, kind: str = "json") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch``: the rows of a batch as ``path``/batch_id=n, whatever was there before."""

    def write(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").format(kind).save(f"{path.rstrip('/')}/batch_id={batch_id}")

    return write


def _start(rows: DataFrame, path: str, checkpoint: str, mode: str, kind: str, once: bool) -> StreamingQuery:
    writer = rows.writeStream.foreachBatch(by_batch(path, kind)).outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def append_records(runs: DataFrame, path: str, checkpoint: str, *, once: bool = True) -> StreamingQuery:
    """Writes a stream of run records as JSON lines. ``once`` ends when what is there now has been written."""
    return _start(runs, path, checkpoint, "append", "json", once)


def rollup(runs: DataFrame, width: str, late: str) -> DataFrame:
    """window_start, route, runs, succeeded, success_rate, total_latency_ms, max_latency_ms of (recorded_at, route, succeeded,
    total_latency_ms). Records up to ``late`` behind the newest one count. On a stream later ones are dropped, by
    the watermark of the batch before theirs, and a window comes out once the watermark has passed it. A table is rolled
    up whole."""
    rows = runs.withWatermark("recorded_at", late) if runs.isStreaming else runs
    good = F.count_if(F.col("succeeded"))
    found = rows.groupBy(F.window("recorded_at", width), "route").agg(
        F.count(F.lit(1)).alias("runs"), good.alias("succeeded"), ratio(good, F.count(F.lit(1))).alias("success_rate"),
        F.sum("total_latency_ms").alias("total_latency_ms"), F.max("total_latency_ms").alias("max_latency_ms"),
    )
    return found.select(F.col("window.start").alias("window_start"), "route", "runs", "succeeded", "success_rate", "total_latency_ms", "max_latency_ms")


def keep_rollup(runs: DataFrame, path: str, checkpoint: str, width: str, late: str, *, once: bool = True) -> StreamingQuery:
    """Writes the windows of a stream of run records that are final."""
    return _start(rollup(runs, width, late), path, checkpoint, "append", "parquet", once)


def read_batches(spark: SparkSession, path: str, schema: str, kind: str = "json") -> DataFrame:
    return spark.read.schema(schema).format(kind).load(path)
