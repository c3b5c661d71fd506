"""The corpus pipeline: quality, near-duplicates, benchmark leaks, mixing, sharding. It counts as part of sparkloom.llm.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. Every stage gets all
that its predecessor kept. ``run`` applies them to the table ``documents``, writing each stage's rows to the shared
folder and reading them again.

1. ``quality``: rows that the co-trained classifier rejects go.
2. ``near_dedup``: of each class of copies and near copies the row with the smallest doc_id stays.
3. ``decontaminate``: rows that hold a window of a benchmark item go.
4. ``mix``: all rows stay, in the order of the Pfair schedule for weights of bytes ** 0.5 by source, in blocks of
   bytes; the files are ordered by it, as are the rows in each.
5. ``shard``: doc_id, size, text_crc32, tokens, shard and slot of all rows, packed into 24 shards. The slots of a shard
   follow the order of stage 4's files, so reading a shard by slot gives its part of the mix.

Defined results, for every stage: a null text counts as empty, has no benchmark words and size 8; texts without words are
copies of equal ones only; null sources and languages are values like others; rows with a null doc_id take part, and are never the
one that stays of a class with an id; repeated rows are copies, of which near_dedup keeps one; of ties the smallest doc_id
stays; texts are read whole, however long; further columns are carried, whatever their names, by all stages but the last;
an empty table gives none. Without labels of both kinds stage 1 keeps all rows.

No SQL can state stages 1, 2, 4 and 5, so ORACLE_SQL is None; tests hold the stages against brute-force versions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_since, table, tables_so_far, utf8_bytes, written
from sparkloom.llm.cotrain_quality import score
from sparkloom.llm.fm_decontam import contamination
from sparkloom.llm.omh_dedup import keep_one
from sparkloom.llm.pfair_mix import mix
from sparkloom.llm.shard_pack import file_order, pack

ORACLE_SQL = None
N_SHARDS = 24


def _unpacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*(F.col("row").getField(c).alias(c) for c in columns))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(score(docs, table(spark, sf_dir, "labels"), carry=True).filter("keep"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = contamination(docs, table(spark, sf_dir, "benchmark"), window=10, carry=True)
    clean = found.filter(F.size("spans") == 0)
    return clean.select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _unpacked(mix(docs, mass=utf8_bytes(F.col("text"))).orderBy("slot", "source_row"), docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(file_order(docs.select("doc_id", "text")), n_shards=N_SHARDS, ordered=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mix", mix_sources),
    ("shard", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    begun = tables_so_far()
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        drop_since(begun, docs)  # a stage's own tables and its predecessor's rows have served
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
