"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` as the session has it.

    Only a local session without that setting (tests) gets a folder of its own.
    """
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "/tmp/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at


_WRITTEN: list[tuple[SparkSession, str]] = []


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm, sc = spark.sparkContext._jvm, spark.sparkContext._jsc
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc.hadoopConfiguration()).delete(p, True)
        except Exception:  # the session has ended; the shared folder has its own clean-up
            return


def written(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet below the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/sparkloom-tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(_remove_written)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Deletes the files behind a frame that ``written`` returned, once nothing reads it any more."""
    for path in _folders(df)[:1]:
        _delete(df.sparkSession, path)


def _folders(df: DataFrame) -> list[str]:
    """The written tables that a frame reads."""
    return sorted({x.rsplit("/", 1)[0] for x in df.inputFiles() if "/sparkloom-tables/" in x})


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def tables_so_far() -> int:
    return len(_WRITTEN)


def drop_since(first: int, *keep: DataFrame) -> None:
    """Deletes the tables that were written after ``tables_so_far`` gave ``first``, but for those that ``keep`` reads."""
    kept = {x.rsplit("/", 1)[-1] for df in keep for x in _folders(df)}
    for spark, path in _WRITTEN[first:]:
        if path.rsplit("/", 1)[-1] not in kept:
            _delete(spark, path)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8_bytes(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


#: Bytes of a word once A-Z are lower case: digits, a-z and every byte of a non-ASCII character.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "replace").lower().translate(WORD_BYTES).split() if text else []
