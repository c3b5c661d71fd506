"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: list[tuple[SparkSession, str]] = []
_LOCAL: dict[str, str] = {}  # folders of local sessions without the setting, by application


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` as the session has it. Only a local session without it (tests) gets a folder of its own."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir") or _LOCAL.get(sc.applicationId)
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = _LOCAL[sc.applicationId] = tempfile.mkdtemp(prefix="spark-")
    return at.rstrip("/")


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _fs(spark, path)
    return fs.exists(p)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)


def _remove_scratch() -> None:
    for spark, path in _SCRATCH:
        if spark.sparkContext._jsc is None or spark.sparkContext._jsc.sc().isStopped():
            return  # the session has ended; the shared folder has its own clean-up
        remove(spark, path)


def scratch(df: DataFrame) -> DataFrame:
    """``df`` written below the shared folder and read again: lineage is cut, and a lost executor costs its tasks only."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _SCRATCH:
        atexit.register(_remove_scratch)
    _SCRATCH.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def scratch_parts(df: DataFrame, by: str) -> list[DataFrame]:
    """As ``scratch``, a table for each value of ``by`` (int, not null), without that column; removed one by one."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch/{uuid.uuid4().hex}"
    df.write.partitionBy(by).parquet(path)
    if not _SCRATCH:
        atexit.register(_remove_scratch)
    _SCRATCH.append((spark, path))
    at, fs = _fs(spark, path)
    found = sorted(x.getPath().getName() for x in fs.listStatus(at) if x.isDirectory() and x.getPath().getName().startswith(f"{by}="))
    return [spark.read.schema(df.drop(by).schema).parquet(f"{path}/{x}") for x in found]


def drop_scratch(df: DataFrame) -> None:
    """Removes the table that ``scratch`` gave, once nothing reads it any more."""
    for x in df.inputFiles()[:1]:
        parent = x.rsplit("/", 1)[0]
        if "/scratch/" in parent:
            remove(df.sparkSession, parent)
