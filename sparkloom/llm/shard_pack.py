"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Tokens are the words of a text: runs of ASCII letters, digits and characters beyond ASCII, as in the other operators.

Documents with equal texts form a group. Groups that are large in some dimension are packed one by one; all
others are hashed into a fixed number of parcels, which are packed as wholes. An item goes to the shard whose
residual capacity has the highest dot product with the item's own vector, largest items first. A group larger than
half a shard in some dimension cannot stay whole without breaking the balance; it is split into pieces by a hash of
its ids.

What reaches the driver is bounded by the parameters alone: at most ``parcels`` parcels, fewer than ``3 * parcels``
large groups (each holds over 1/parcels of the bytes, tokens or rows) and the pieces of fewer than ``6 * n_shards``
split groups.

Defined results: a null text has no bytes (size 8 with the row overhead), no tokens and crc32 0, and forms a group of
its own; an empty table gives no rows; repeated rows are rows like any other; further columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sparkloom.llm.common import written

DIMS = ("size", "tokens", "one")
#: The words of ``common.ascii_words``: runs of ASCII letters, digits and characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def place(vectors: np.ndarray, n_shards: int) -> np.ndarray:
    """The shard of each item. Vectors hold fractions of the whole corpus in each dimension."""
    out = np.zeros(len(vectors), dtype=np.int32)
    residual = np.full((n_shards, vectors.shape[1]), 1.0 / n_shards)
    order = np.lexsort((np.arange(len(vectors)), -vectors.max(axis=1))) if len(vectors) else []
    for i in order:
        v = vectors[i]
        fits = (residual >= v - 1e-12).all(axis=1)
        gain = residual @ v
        if fits.any():
            gain = np.where(fits, gain, -np.inf)
        out[i] = k = int(np.argmax(gain))
        residual[k] -= v
    return out


def file_order(docs: DataFrame) -> DataFrame:
    """``docs`` with ``part`` and ``at``: the number of the file that holds a row and the row's place in it. Frames that
    are not read from files count by their partitions."""
    try:
        number = F.regexp_extract("_metadata.file_name", r"part-(\d+)", 1).cast("long")
        return docs.select("*", number.alias("part"), F.col("_metadata.row_index").alias("at"))
    except AnalysisException:
        nth = F.monotonically_increasing_id()
        return docs.select("*", F.shiftright(nth, 33).alias("part"), nth.bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))


def pack(docs: DataFrame, *, n_shards: int = 24, parcels_per_shard: int = 256, slot_rows: int = 100_000, ordered: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, tokens, shard, slot for every row of ``docs`` (doc_id, text).

    With ``ordered`` the slots of a shard follow the columns part and at of ``docs``, else a hash."""
    order = ["part", "at"] if ordered else []
    spark, parcels = docs.sparkSession, n_shards * parcels_per_shard
    text = F.col("text").cast("string")
    rows = written(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"),
            F.xxhash64(text, text.isNull()).alias("gkey"),
            *order,
        )
    ).withColumn("one", F.lit(1).cast("long"))
    totals = rows.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in DIMS)).first()
    over = lambda fraction: " OR ".join(f"{c} > {max(totals[c], 1) * fraction!r}D" for c in DIMS)

    groups = rows.groupBy("gkey").agg(*(F.sum(c).alias(c) for c in DIMS))
    items = (
        groups.withColumn("heavy", F.expr(over(1.0 / parcels)))
        .withColumn("split", F.expr(over(0.5 / n_shards)))
        .groupBy("heavy", "split", F.when(F.col("heavy"), F.col("gkey")).otherwise(F.pmod("gkey", F.lit(parcels))).alias("key"))
        .agg(*(F.sum(c).alias(c) for c in DIMS))
        .collect()
    )
    whole = [(r["heavy"], r["key"], 0, *(r[c] for c in DIMS)) for r in items if not r["split"]]
    pieces = {r["key"]: math.ceil(max(r[c] / max(totals[c], 1) for c in DIMS) * n_shards * 16) for r in items if r["split"]}
    heavy = [(r["key"], pieces.get(r["key"], 1)) for r in items if r["heavy"]]
    heavy_df = spark.createDataFrame(heavy, "gkey long, pieces int")
    keyed = (
        rows.join(F.broadcast(heavy_df), "gkey", "left")
        .withColumn("heavy", F.col("pieces").isNotNull())
        .withColumn("key", F.when(F.col("heavy"), F.col("gkey")).otherwise(F.pmod("gkey", F.lit(parcels))))
        .withColumn("piece", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.col("pieces").cast("long")).cast("int"), F.lit(0)))
    )
    if pieces:
        cut = keyed.filter("pieces > 1").groupBy("key", "piece").agg(*(F.sum(c).alias(c) for c in DIMS)).collect()
        whole += [(True, r["key"], r["piece"], *(r[c] for c in DIMS)) for r in cut]
    whole.sort(key=lambda x: x[:3])
    vectors = np.array([x[3:] for x in whole], dtype=float).reshape(-1, len(DIMS)) / np.array([max(totals[c], 1) for c in DIMS])
    shards = place(vectors, n_shards)
    places = spark.createDataFrame([(*x[:3], int(k)) for x, k in zip(whole, shards, strict=True)], "heavy boolean, key long, piece int, shard int")

    subs = max(4, math.ceil(totals["one"] / n_shards / slot_rows))
    sub = F.struct("part", F.floor(F.col("at") / slot_rows).alias("run")) if ordered else F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(subs)).cast("int")
    placed = keyed.join(F.broadcast(places), ["heavy", "key", "piece"]).select("doc_id", "size", "text_crc32", "tokens", "shard", sub.alias("sub"), *order)
    before = (
        placed.groupBy("shard", "sub")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("before", F.sum("n").over(W.partitionBy("shard").orderBy("sub")) - F.col("n"))
        .drop("n")
    )
    inside = F.row_number().over(W.partitionBy("shard", "sub").orderBy(*(["at"] if ordered else []), "doc_id", "text_crc32", "size"))
    return placed.withColumn("inside", inside).join(before, ["shard", "sub"]).select(
        "doc_id", "size", "text_crc32", "tokens", "shard", (F.col("before") + F.col("inside") - 1).cast("long").alias("slot")
    )
