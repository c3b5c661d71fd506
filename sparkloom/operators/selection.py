"""Places and ranks in distributed order, without a task that sorts a group.

Values are cut into bins by size: a bin for each thousandth of a doubling, so heavy tails spread over as many bins as they
span doublings. The cut is a function of the value alone and never falls as values rise, which is all that is asked of it.
"""

from __future__ import annotations

import math
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.sources.store import scratch

_PER_DOUBLING = 1024
_FINE = 1 << 20


def size_bin(v: Column) -> Column:
    """A long that never falls as ``v`` (double, not null) rises; zeros, infinities and NaN have bins of their own."""
    far = F.floor((F.log2(F.abs(v)) + 1080) * _PER_DOUBLING).cast("long")
    return F.when(F.isnan(v), F.lit(1 << 41)).when(v == 0, F.lit(0)).when(F.abs(v) == float("inf"), F.signum(v).cast("long") * (1 << 40)).otherwise(F.signum(v).cast("long") * far)


def _upto(counts: DataFrame, by: list[str], order: str) -> DataFrame:
    return counts.withColumn("upto", F.sum("here").over(W.partitionBy(*by).orderBy(order)))


def nearest_rank(values: DataFrame, value: str, fractions: dict[str, float], by: list[str] | None = None, *, index=lambda f, n: F.bround(f * (n - 1))) -> DataFrame:
    """The values at place ``index(fraction, count)`` of the sorted values, a column per fraction; null for none.

    Counts of bins find the bin that holds a wanted place; that bin is cut between its extremes into 2 ** 20 finer ones,
    and of the fine one that holds the place the distinct values are counted. Rows only ever become counts, so equal
    values are one row a task, and the last step has no more rows than there are doubles in a fine bin. The default
    place is round_half_even(f * (n - 1))."""
    by = by or []
    key = F.struct(*by) if by else F.struct(F.lit(0).alias("all"))
    rows = values.select(key.alias("key"), F.col(value).cast("double").alias("v")).filter("v IS NOT NULL").withColumn("bin", size_bin(F.col("v")))
    counts = rows.groupBy("key", "bin").agg(F.count(F.lit(1)).alias("here"), F.min("v").alias("low"), F.max("v").alias("high"))
    counts = _upto(counts, ["key"], "bin").withColumn("n", F.sum("here").over(W.partitionBy("key")))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(index(F.lit(f), F.col("n")), F.lit(0)).cast("long").alias("at")) for name, f in fractions.items()]))

    def holding(found: DataFrame) -> DataFrame:
        """Rows whose counts hold the place ``w.at``, with that place inside them."""
        inside = found.filter((F.col("w.at") < F.col("upto")) & (F.col("w.at") >= F.col("upto") - F.col("here")))
        return inside.withColumn("w", F.struct(F.col("w.name").alias("name"), (F.col("w.at") - (F.col("upto") - F.col("here"))).alias("at")))

    coarse = holding(counts.withColumn("w", wanted)).select("key", "bin", "low", "high", "w")
    fine_bin = F.when(F.col("high") > F.col("low"), F.least(F.lit(_FINE - 1), F.floor((F.col("v") - F.col("low")) / (F.col("high") - F.col("low")) * _FINE).cast("long"))).otherwise(F.lit(0).cast("long"))

    same = F.col("key").eqNullSafe(F.col("k")) & (F.col("bin") == F.col("t_bin"))
    to = lambda found, *more: found.select(F.col("key").alias("k"), F.col("bin").alias("t_bin"), *more)
    mine = rows.join(to(coarse, "low", "high").distinct(), same).select("key", "bin", "v", fine_bin.alias("fine"))
    per_fine = _upto(mine.groupBy("key", "bin", "fine").agg(F.count(F.lit(1)).alias("here")), ["key", "bin"], "fine")
    fine = holding(per_fine.join(to(coarse, "w"), same)).select("key", "bin", "fine", "w")
    same = same & (F.col("fine") == F.col("t_fine"))
    place = F.col("fine").alias("t_fine")
    last = mine.join(to(fine, place).distinct(), same).groupBy("key", "bin", "fine", "v").agg(F.count(F.lit(1)).alias("here"))
    picked = holding(_upto(last, ["key", "bin", "fine"], "v").join(to(fine, place, "w"), same)).select("key", "w.name", "v")
    pivoted = picked.groupBy("key").agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in fractions])
    return pivoted.select(*[F.col("key").getField(c).alias(c) for c in by], *fractions)


def positions(rows: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """``rows`` with ``rank``, their place by ``order`` within ``by``, from 1.

    Rows are range-partitioned by all of it, so that a group, or many rows of one score, lie in as many tasks as they
    need; what stands before a task's part of a group is summed up over the parts, of which there is one row each."""
    keys = [F.col(c).alias(f"__b{i}") for i, c in enumerate(by)] + [o.alias(f"__o{i}") for i, o in enumerate(order)]
    names = [f"__b{i}" for i in range(len(by))] + [f"__o{i}" for i in range(len(order))]
    keyed = rows.select("*", *keys)
    laid = keyed.repartitionByRange(*names).sortWithinPartitions(*names).withColumns({"__part": F.spark_partition_id(), "__pos": F.monotonically_increasing_id()})
    laid = scratch(laid.drop(*names))
    spans = laid.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__here"), F.min("__pos").alias("__first"))
    spans = spans.withColumn("__before", F.sum("__here").over(W.partitionBy(*by).orderBy("__part")) - F.col("__here")).drop("__here")
    other = spans.select(*(F.col(c).alias(f"__s{i}") for i, c in enumerate(by)), F.col("__part").alias("__p"), "__first", "__before")
    same = F.col("__part") == F.col("__p")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"__s{i}"))
    rank = (F.col("__before") + F.col("__pos") - F.col("__first") + 1).cast("long")
    return laid.join(other, same).select(*rows.columns, rank.alias("rank"))


def rank_among(rows: DataFrame, wanted: DataFrame, by: list[str], score: Column, ties: list[str]) -> DataFrame:
    """``by``, ``ties`` and ``rank`` of the rows of ``wanted`` (by, ties) among all ``rows``: by score, highest first,
    then ``ties``. Rows are counted by bins of their scores, and only bins that hold a wanted row are put in order."""
    scored = rows.select(*by, *ties, score.alias("__s")).withColumn("__bin", -size_bin(F.col("__s")))
    counts = scored.groupBy(*by, "__bin").agg(F.count(F.lit(1)).alias("here"))
    before = _upto(counts, by, "__bin").select(*by, "__bin", (F.col("upto") - F.col("here")).alias("__before"))
    asked = scored.join(wanted.select(*by, *ties).distinct(), [*by, *ties])
    inside = scored.join(asked.select(*by, "__bin").distinct(), [*by, "__bin"], "left_semi")
    nth = F.row_number().over(W.partitionBy(*by, "__bin").orderBy(F.desc("__s"), *ties))
    placed = inside.withColumn("__nth", nth).join(wanted.select(*by, *ties).distinct(), [*by, *ties], "left_semi")
    return placed.join(before, [*by, "__bin"]).select(*by, *ties, (F.col("__before") + F.col("__nth")).cast("long").alias("rank"))


def _nines(score: np.ndarray) -> np.ndarray:
    """To nine places, as Spark rounds: by its decimal digits, halves away from zero. Only what lies next to a half, or is too
    large for its product to be exact enough, goes through decimals."""
    size = np.abs(score) * 1e9
    whole = np.floor(size)
    with np.errstate(invalid="ignore"):
        part = size - whole
    out = np.copysign((whole + (part >= 0.5)) / 1e9, score)
    for i in np.flatnonzero(~(size < 1e11) | (np.abs(part - 0.5) < 1e-3)).tolist():
        x = float(score[i])
        out[i] = float(Decimal(repr(x)).quantize(Decimal("1e-9"), ROUND_HALF_UP)) if math.isfinite(x) else x
    return out


def _keyed(score: np.ndarray) -> np.ndarray:
    """What scores are ordered by: nine places, NaN above all others."""
    v = _nines(score)
    v[np.isposinf(v)] = np.finfo(float).max
    v[np.isnan(v)] = np.inf
    return v


class Ahead:
    """How much stands before each of some wanted rows (score, key) of one group: by score to nine places, highest first, then
    key. ``add`` takes scores over 0 in any portions, ``counts`` gives the sums in the order in which the rows were given."""

    def __init__(self, score: np.ndarray, key: np.ndarray):
        keyed = _keyed(score)
        self.order = np.lexsort((key, -keyed))
        self.down, self.key = -keyed[self.order], key[self.order]
        self.steps = np.zeros(len(key) + 1, np.int64)
        self.least = float(score.min()) - 2e-9 if len(score) and not np.isnan(score).any() else -np.inf

    def add(self, score: np.ndarray, key: np.ndarray, weight: np.ndarray | None = None) -> None:
        at = np.flatnonzero(~(score <= max(self.least, 0.0)))
        if not len(at) or not len(self.key):
            return
        down = -_keyed(score[at])
        low, high = np.searchsorted(self.down, down, "left"), np.searchsorted(self.down, down, "right")
        tied = np.flatnonzero(low < high)
        tied = tied[np.argsort(low[tied], kind="stable")]
        for same in np.split(tied, np.flatnonzero(np.diff(low[tied])) + 1) if len(tied) else ():
            start, end = low[same[0]], high[same[0]]
            low[same] = start + np.searchsorted(self.key[start:end], key[at[same]], "right")
        self.steps += np.bincount(low, None if weight is None else weight[at], len(self.steps)).astype(np.int64)

    def counts(self) -> np.ndarray:
        out = np.empty(len(self.key), np.int64)
        out[self.order] = np.cumsum(self.steps)[:-1]
        return out


def best_rows(rows: list[np.ndarray], k: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The k best (query, doc_id, chunk_no, score) of each query in the order of their scores to nine places, doc_id and chunk_no; which queries have k, and
    their k-th scores."""
    order = np.lexsort((rows[2], rows[1], -_nines(rows[3]), rows[0]))
    rows = [x[order] for x in rows]
    begins = np.flatnonzero(np.r_[True, rows[0][1:] != rows[0][:-1]]) if len(order) else np.zeros(0, int)
    place = np.arange(len(order)) - np.repeat(begins, np.diff(np.r_[begins, len(order)]))
    return [x[place < k] for x in rows], rows[0][place == k - 1], rows[3][place == k - 1]
