"""Incremental ingest of a workspace: texts are read again only of files that changed.

A file stream takes a path once, whatever becomes of the file. So a run first writes what changed since the ledger's last
entries, new files, files of another time or size, and files that are gone, as one more file of the ledger; the ledger is
the stream's source. Its checkpoint knows which entries have been taken, also after a restart, and each batch replaces
the folder of its own number, so that a replayed batch is not doubled. The newest entry of a path decides what counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.store import exists
from sparkloom.sources.workspace import scan, texts

_LEDGER = "path string, suffix string, modificationTime timestamp, length long, gone boolean, run long"
_TEXTS = "path string, text string, run long, batch_id int"


def _newest(rows: DataFrame) -> DataFrame:
    """The last entry of each path."""
    named = F.struct(*[c for c in rows.columns if c != "path"])
    return rows.groupBy("path").agg(F.max_by(named, "run").alias("x")).select("path", "x.*")


def _ledger(spark: SparkSession, home: str) -> DataFrame:
    at = f"{home}/ledger"
    return spark.read.schema(_LEDGER).parquet(at) if exists(spark, at) else spark.createDataFrame([], _LEDGER)


def note_changes(spark: SparkSession, root: str, home: str) -> int:
    """Adds what changed below ``root`` to the ledger, without reading any content; the number of entries."""
    listed = scan(spark, root).select("path", "suffix", "modificationTime", "length")
    ledger = _ledger(spark, home)
    known = _newest(ledger)
    run = (ledger.agg(F.max("run")).first()[0] or 0) + 1
    same = ["path", "modificationTime", "length"]
    changed = listed.join(known.filter("NOT gone"), same, "left_anti").withColumn("gone", F.lit(False))
    gone = known.filter("NOT gone").join(listed, "path", "left_anti").drop("run").withColumn("gone", F.lit(True))
    entries = changed.unionByName(gone).withColumn("run", F.lit(run).cast("long")).persist()
    n = entries.count()
    if n:
        entries.select("path", "suffix", "modificationTime", "length", "gone", "run").write.mode("append").parquet(f"{home}/ledger")
    entries.unpersist()
    return n


def ingest(spark: SparkSession, root: str, home: str, *, parse_pdf=None, max_chars: int | None = None, files_per_batch: int = 50) -> int:
    """Brings the texts below ``home`` up to date with the files below ``root``; the number of entries that were noted.

    Contents are read by the executors, of the files that a batch names; paths of one batch go through the driver."""
    noted = note_changes(spark, root, home)
    if not exists(spark, f"{home}/ledger"):
        return 0

    def take(entries: DataFrame, batch_id: int) -> None:
        wanted = entries.filter("NOT gone").select("path", "run")
        paths = [r.path for r in wanted.select("path").distinct().collect()]
        to = f"{home}/texts/batch_id={batch_id}"
        if not paths:
            spark.createDataFrame([], "path string, text string, run long").write.mode("overwrite").parquet(to)
            return
        files = spark.read.format("binaryFile").load(paths).withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)))
        texts(files, max_chars, parse_pdf).join(wanted, "path").select("path", "text", "run").write.mode("overwrite").parquet(to)

    stream = spark.readStream.schema(_LEDGER).option("maxFilesPerTrigger", files_per_batch).parquet(f"{home}/ledger")
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return noted


def current(spark: SparkSession, home: str) -> DataFrame:
    """path, text, modificationTime, length of the files that are there, as they were read last."""
    live = _newest(_ledger(spark, home)).filter("NOT gone").select("path", "modificationTime", "length", "run")
    return live.join(spark.read.schema(_TEXTS).parquet(f"{home}/texts"), ["path", "run"]).select("path", "text", "modificationTime", "length")
