"""Retrieval quality: known-item queries and metrics of rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.config import DEFAULT


def known_item_queries(posted: DataFrame, n_chunks: DataFrame, *, terms: int = DEFAULT.ranking.known_item_terms, max_df_ratio: float = DEFAULT.ranking.max_df_ratio, stride: int = 1) -> DataFrame:
    """doc_id, chunk_no, query: the ``terms`` rarest terms of a chunk that occur in 2 to max(2, N * ratio) chunks.

    ``n_chunks``: one row with the column n_chunks. Chunks with fewer such terms have no query; ``stride`` asks for every
    so-manieth doc_id only, frequencies counting all."""
    df = posted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(F.broadcast(n_chunks.select("n_chunks")), how="cross")
    usable = df.filter((F.col("df") >= 2) & (F.col("df") <= F.greatest(F.lit(2), F.floor(F.col("n_chunks") * F.lit(max_df_ratio))))).select("term", "df")
    order = W.partitionBy("doc_id", "chunk_no").orderBy("df", "term")
    best = posted.filter(F.pmod("doc_id", F.lit(stride)) == 0).select("doc_id", "chunk_no", "term").join(usable, "term").withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= terms)
    listed = best.groupBy("doc_id", "chunk_no").agg(F.sort_array(F.collect_list(F.struct("pos", "term"))).alias("t"))
    return listed.filter(F.size("t") >= terms).select("doc_id", "chunk_no", F.array_join(F.col("t.term"), " ").alias("query"))


def relevant_ranks(ranked: DataFrame, truth: DataFrame) -> DataFrame:
    """qid, rank of its relevant document (null when it is not ranked): a left join, so misses count."""
    wanted = truth.select("qid", F.col("relevant_id").alias("doc_id"))
    found = ranked.select("qid", "doc_id", "rank").join(wanted, ["qid", "doc_id"]).groupBy("qid").agg(F.min("rank").alias("rank"))
    return truth.select("qid").join(found, "qid", "left")


def metrics(ranks: DataFrame, k_short: int = 5, k: int = 10) -> DataFrame:
    """One row of means over the queries; 0 for no queries."""
    r = F.col("rank")
    zero = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    gain = F.when(r <= k, F.lit(1.0) / F.log2(r + F.lit(1.0))).otherwise(0.0)
    return ranks.agg(
        F.count(F.lit(1)).alias("n_queries"),
        zero(F.when(r <= 1, 1.0).otherwise(0.0)).alias("recall_at_1"),
        zero(F.when(r <= k_short, 1.0).otherwise(0.0)).alias(f"recall_at_{k_short}"),
        zero(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"recall_at_{k}"),
        zero(F.coalesce(F.lit(1.0) / r, F.lit(0.0))).alias("mrr"),
        zero(F.coalesce(gain, F.lit(0.0))).alias(f"ndcg_at_{k}"),
    )
