"""Near-duplicate detection by Order MinHash.

A text is its sequence of words (A-Z lower-cased); its k-mers are five consecutive words, each labelled with how often
it has occurred before. A sketch takes the ``ell`` labelled k-mers with the smallest values of one random function and
keeps them in text order, so two texts share a sketch when they agree in content and in order. Texts that share one of
``sketches`` sketches are candidates. Two texts are linked when their similarity L / (n + m - L) is ``threshold`` or
more, where n and m count their labelled k-mers and L is the longest common subsequence of these. As every labelled
k-mer is unique in its text, L is the longest increasing run of matched positions; only matches within the band that a
link allows are aligned. Classes are the connected components of the links.

Groups never meet as a whole and are never expanded into all pairs:

* Copies of one word sequence are collapsed first.
* In each bucket (texts with one sketch in common) every member is compared with the bucket's centre: the member that
  has the most company over all of its buckets. A text that few edits part from the others of its group is such a one.
* A bucket whose members are then in one class is done. In the others, the members outside the bucket's most common
  class ask and all members answer. Their labelled k-mers are put in one order, those that the fewest of these texts
  have first. Two texts can only be linked if they share a k-mer among the first n - ceil(threshold * n) + 1 of either
  and enough k-mers follow it in both, so only such pairs of fitting length and different classes are verified. Two
  members of a bucket in different classes are never both in its most common class, so one of them asks: no link
  between two texts of a bucket is lost for the classes. K-mers that no other of these texts has take up places in that
  order and meet nobody, so a group of texts that differ in their own ways costs few comparisons.

Two texts at the threshold miss each other in all sketches with a probability of about (1 - 0.8 ** ell) ** sketches,
4e-7 with the defaults. For short texts few k-mers remain to choose from, so those of up to ``short`` k-mers have
sketches of their own with a smaller ``ell``, and both kinds are made where lengths overlap: of two texts that can be
linked either both have the one kind or both the other.

Defined results: a null text is empty; texts of fewer than five words have one k-mer of all their words; texts without
words are alike only when identical; repeated rows are copies; rows with a null doc_id can be kept only in a class
without any id; an empty table gives no rows. Further columns, whatever their names, pass through ``keep_one``.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from sparkloom.llm.common import ascii_words, drop_since, drop_written, tables_so_far, written

M1, M2, GOLD = (np.uint64(x) for x in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x9E3779B97F4A7C15))
U33, U29 = np.uint64(33), np.uint64(29)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U33)) * M1
    x = (x ^ (x >> U29)) * M2
    return x ^ (x >> U33)


class Words(dict):
    """Word to 64-bit number, remembered while the worker runs."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = n = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return n


def kmers(words: list[bytes], k: int, numbers: Words) -> np.ndarray:
    """The labelled k-mers of a text, in text order."""
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(numbers.__getitem__, words), np.uint64, len(words))
    n = max(1, len(w) - k + 1)
    h = np.zeros(n, np.uint64)
    for j in range(min(k, len(w))):
        h = h * M1 + mix(w[j : j + n] + GOLD)
    order = np.argsort(h, kind="stable")
    s = h[order]
    same = np.concatenate(([False], s[1:] == s[:-1]))
    if same.any():
        at = np.arange(n)
        nth = np.empty(n, np.uint64)
        nth[order] = (at - np.maximum.accumulate(np.where(same, 0, at))).astype(np.uint64)
        h = h + nth * GOLD
    return mix(h)


def sketch(x: np.ndarray, seeds: np.ndarray, ell: int) -> np.ndarray:
    """One number per seed: the ``ell`` smallest labelled k-mers, in text order."""
    n = len(x)
    out = np.empty(len(seeds), np.uint64)
    step = max(1, (1 << 18) // n)
    for a in range(0, len(seeds), step):
        s = seeds[a : a + step, None]
        if n <= ell:
            part = np.broadcast_to(x, (len(s), n))
        else:
            h = (x[None, :] ^ s) * M1
            h ^= h >> U29
            h *= M2
            least = np.partition(h, ell - 1, axis=1)[:, ell - 1 : ell]
            rows, at = np.nonzero(h <= least)
            first = np.searchsorted(rows, np.arange(len(s)))
            part = x[at[first[:, None] + np.arange(ell)]]
        key = np.full(len(s), n if n <= ell else 0, np.uint64)
        for j in range(part.shape[1]):
            key = mix(key * GOLD + part[:, j] + np.uint64(j + 1))
        out[a : a + step] = mix(key ^ s[:, 0])
    return out


def aligned(a: np.ndarray, b: np.ndarray, threshold: float) -> int:
    """The longest common subsequence of two texts' labelled k-mers inside the band that a link allows."""
    _, ia, ib = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    # L >= t (n + m - L): so at most this many k-mers stay unmatched, and no match is further off the diagonal
    band = int((len(a) + len(b)) * (1 - threshold) / (1 + threshold) + 1e-9)
    near = np.abs(ia - ib) <= band
    order = np.argsort(ia[near])
    at = ib[near][order]
    if len(at) < 2 or (np.diff(at) > 0).all():
        return len(at)
    ends: list[int] = []
    for x in at.tolist():
        k = bisect_left(ends, x)
        ends[k : k + 1] = [x]
    return len(ends)


def sketches_of(x: np.ndarray, families: list[tuple[float, float, int, np.ndarray]]) -> np.ndarray:
    found = [sketch(x, seeds, ell) for least, most, ell, seeds in families if least <= len(x) <= most and len(x)]
    return np.concatenate(found) if found else np.zeros(0, np.uint64)


def _prepare(k: int, families: list[tuple[float, float, int, np.ndarray]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Words()
        for b in batches:
            digests, sizes, keys = [], [], []
            for text in b.column(1):
                raw = (text.as_py() or "").encode("utf-8", "replace")
                words = ascii_words(text.as_py())
                digests.append(hashlib.md5(b"\0".join(words) if words else b"\0" + raw, usedforsecurity=False).digest())
                x = kmers(words, k, numbers)
                sizes.append(len(x))
                keys.append(sketches_of(x, families).view(np.int64))
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in keys]))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), lists], names=["doc_id", "text", "rest", "digest", "n", "keys"]
            )

    return run


def _kmers_of(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Words()

        def out(found):
            rid = np.repeat(np.array([r for r, _ in found], np.int64), [len(x) for _, x in found])
            return pa.RecordBatch.from_arrays([pa.array(rid), pa.array(np.concatenate([x for _, x in found]))], names=["tid", "kmer"])

        for b in batches:
            found, size = [], 0
            for rid, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                found.append((rid, kmers(ascii_words(text.as_py()), k, numbers).view(np.int64)))
                size += len(found[-1][1])
                if size > 1 << 18:
                    yield out(found)
                    found, size = [], 0
            if found:
                yield out(found)

    return run


def _verify(k: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Words()
        last, x = None, None
        for b in batches:
            linked = []
            for left, a_text, b_text in zip(b.column(0).to_pylist(), b.column(2), b.column(3), strict=True):
                if left != last:
                    last, x = left, kmers(ascii_words(a_text.as_py()), k, numbers)
                y = kmers(ascii_words(b_text.as_py()), k, numbers)
                length = aligned(x, y, threshold)
                both = len(x) + len(y)
                linked.append(length / (both - length) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """v, root for every vertex of ``edges`` (a, b longs): root is the smallest vertex of its component.

    Alternates large-star and small-star steps until nothing changes; each step's edges are a written table.
    """
    e = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = lambda x: tuple(x.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())
    was = state(e)
    while was[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", F.col("u")).alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v")
        new = written(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        now = state(new)
        drop_written(e)
        e = new
        if now == was:
            break
        was = now
    return e.select(F.col("u").alias("v"), F.col("v").alias("root")).unionByName(e.select("v", F.col("v").alias("root")).distinct())


def merge_roots(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """The roots (v, root) once ``links`` (a, b) are added to those that gave ``roots``."""
    if roots is None:
        return written(components(links))
    of = lambda side: links.join(roots.select(F.col("v").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    known = of("a").join(roots.select(F.col("v").alias("b"), F.col("root").alias("b_root")), "b", "left")
    joined = known.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    moved = written(components(joined).select(F.col("v").alias("root"), F.col("root").alias("top")))
    old = roots.join(moved, "root", "left").select("v", F.coalesce("top", "root").alias("root"))
    new = moved.join(roots, "root", "left_anti").select(F.col("root").alias("v"), F.col("top").alias("root"))
    return written(old.unionByName(new.join(old, "v", "left_anti")))


def _buckets(lengths: DataFrame, hot_share: float = 0.002, sampled: int = 1_000_000) -> DataFrame:
    """key, tid, size, centre of all buckets of two texts or more, from the texts' ``keys``; a written table.

    A sample finds the sketches that many texts have; those are dealt in parts. It only steers how rows are dealt."""
    n = lengths.count()
    some = lengths.sample(fraction=min(1.0, sampled / max(1, n)), seed=1).select(F.explode("keys").alias("key"))
    # a text has at most ``sketches + short_sketches`` keys, so no more than that / hot_share keys are hot
    hot = some.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > max(100.0, hot_share * min(n, sampled))).select("key", F.lit(True).alias("hot"))
    members = lengths.select(F.explode("keys").alias("key"), "tid").join(F.broadcast(hot), "key", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    dealt = members.withColumn("part", F.when(F.col("hot"), F.pmod(F.xxhash64("tid"), F.lit(256))).otherwise(F.lit(0))).repartition("key", "part")
    shared = written(dealt.withColumn("here", F.count(F.lit(1)).over(W.partitionBy("key", "part"))).filter("here > 1 OR hot").select("key", "tid"))
    sizes = shared.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    company = shared.join(sizes, "key").groupBy("tid").agg(F.sum("size").alias("company"))
    centre = shared.join(company, "tid").groupBy("key").agg(F.max(F.struct("company", -F.col("tid"))).alias("best"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    bucketed = written(shared.join(centre.select("key", "size", (-F.col("best.col2")).alias("centre")), "key").select("key", "tid", "size", "centre"))
    drop_written(shared)
    return bucketed


def _open(bucketed: DataFrame, roots: DataFrame) -> DataFrame:
    """tid, root, asks of the members of the buckets that hold several classes: those outside the bucket's most common
    class ask."""
    now = bucketed.select("key", "tid").join(roots.withColumnRenamed("v", "tid"), "tid", "left").select("key", "tid", F.coalesce("root", "tid").alias("root"))
    each = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("c"))
    several = each.groupBy("key").agg(F.max(F.struct("c", "root"))["root"].alias("main"), F.count(F.lit(1)).alias("classes")).filter("classes > 1").select("key", "main")
    return now.join(several, "key").groupBy("tid").agg(F.min("root").alias("root"), F.max(F.col("root") != F.col("main")).alias("asks"))


def _promising(members: DataFrame, listed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of ``members`` (tid, n, root, asks) of different classes, one of them asking, that their first k-mers
    (``listed``: tid, kmer) in the order of rarity allow to be linked.

    A link needs L >= t (n + m) / (1 + t) common k-mers, and m >= t n."""
    seen = listed.groupBy("kmer").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    shared = listed.join(seen, "kmer").join(members, "tid")
    by = W.partitionBy("tid")
    placed = shared.withColumn("at", F.col("n") - F.count(F.lit(1)).over(by) + F.row_number().over(by.orderBy("df", "kmer")) - 1)
    first = written(placed.filter(F.col("at") <= F.col("n") - F.ceil(threshold * F.col("n") - 1e-9)).select("tid", "n", "root", "asks", "at", "kmer"))
    side = lambda x: first.select("kmer", *(F.col(c).alias(f"{x}_{c}") for c in ("tid", "n", "root", "asks", "at")))
    met = side("x").filter("x_asks").join(side("y"), "kmer").filter("x_root <> y_root AND (NOT y_asks OR x_tid < y_tid)")
    fits = F.least("x_n", "y_n") >= threshold * F.greatest("x_n", "y_n") - 1e-9
    left = F.least(F.col("x_n") - F.col("x_at"), F.col("y_n") - F.col("y_at"))
    enough = left >= threshold / (1 + threshold) * (F.col("x_n") + F.col("y_n")) - 1e-9
    return met.filter(fits & enough).select(F.least("x_tid", "y_tid").alias("a"), F.greatest("x_tid", "y_tid").alias("b")).distinct()


def _settled(bucketed: DataFrame, n_of: DataFrame, verified: Callable[[DataFrame], DataFrame], kmers_of: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """v, root once all buckets (key, tid, size, centre) are compared. ``n_of``: tid, n; ``verified`` says which pairs are
    linked, ``kmers_of`` lists the k-mers of texts."""
    star = verified(bucketed.filter("tid <> centre").select(F.least("tid", "centre").alias("a"), F.greatest("tid", "centre").alias("b")).distinct())
    roots = merge_roots(None, star.filter("linked").select("a", "b"))
    members = written(_open(bucketed, roots).join(n_of, "tid"))
    if members.isEmpty():
        return roots
    listed = written(kmers_of(members.select(F.col("tid").alias("rid"))))
    found = verified(written(_promising(members, listed, threshold))).filter("linked").select("a", "b")
    drop_written(listed)
    return roots if found.isEmpty() else merge_roots(roots, found)


def families(threshold: float, ell: int, sketches: int, short: int, short_ell: int, short_sketches: int, seed: int) -> list[tuple[float, float, int, np.ndarray]]:
    """Least and most k-mers of a text, ell and seeds of each kind of sketch."""
    seeds = np.random.default_rng(seed).integers(1, 2**63, sketches + short_sketches).astype(np.uint64)
    return [(short * threshold, float("inf"), ell, seeds[:sketches]), (1, short, short_ell, seeds[sketches:])]


def _classed(docs: DataFrame, k: int, threshold: float, **sketching) -> tuple[DataFrame, DataFrame, list[str]]:
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rest = F.struct(*(F.col(f"`{c}`") for c in others)) if others else F.struct(F.lit(None).cast("int").alias("none"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), rest.alias("rest"))
    schema = T.StructType([*rows.schema.fields, *T.StructType.fromDDL("digest binary, n long, keys array<long>").fields])
    begun = tables_so_far()
    base = written(rows.mapInArrow(_prepare(k, families(threshold, **sketching)), schema).withColumn("rid", F.monotonically_increasing_id()))

    texts = written(base.groupBy("digest").agg(F.min("rid").alias("tid"), F.count(F.lit(1)).alias("copies")))
    lengths = base.join(texts.select(F.col("tid").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("tid"), "n", "keys")

    def verified(pairs: DataFrame) -> DataFrame:
        used = pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct()
        body = base.select("rid", "text").join(used, "rid", "left_semi")
        left, right = body.select(F.col("rid").alias("a"), F.col("text").alias("a_text")), body.select(F.col("rid").alias("b"), F.col("text").alias("b_text"))
        both = pairs.join(right, "b").join(left, "a").select("a", "b", "a_text", "b_text")
        return written(both.mapInArrow(_verify(k, threshold), "a long, b long, linked boolean"))

    kmers_of = lambda some: base.select("rid", "text").join(some, "rid", "left_semi").mapInArrow(_kmers_of(k), "tid long, kmer long")
    bucketed = _buckets(lengths.select("tid", "keys"))
    roots = _settled(bucketed, lengths.select("tid", "n"), verified, kmers_of, threshold)
    drop_since(begun, base, texts, roots)  # buckets, pairs and the steps of the components have served
    by_digest = texts.join(roots.withColumnRenamed("v", "tid"), "tid", "left").select("digest", F.coalesce("root", "tid").alias("root"))
    placed = base.select("rid", "doc_id", "digest").join(by_digest, "digest").select("rid", "doc_id", "root")
    best = placed.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("best"), F.count(F.lit(1)).alias("class_size"))
    classed = placed.join(best, "root").select("rid", F.col("best.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("best.rid")).alias("kept"))
    return classed, base, others


DEFAULTS = {"k": 5, "threshold": 0.8, "ell": 8, "sketches": 80, "short": 40, "short_ell": 3, "short_sketches": 24, "seed": 7}


def near_dup_classes(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of the class), class_size, kept for every row; one row a class is kept."""
    classed, base, _ = _classed(docs, **DEFAULTS | options)
    return classed.join(base.select("rid", "doc_id"), "rid").select("doc_id", "class_id", "class_size", "kept")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without all but one of each class, with all their columns."""
    classed, base, others = _classed(docs, **DEFAULTS | options)
    kept = base.join(classed.filter("kept").select("rid"), "rid", "left_semi")
    return kept.select(*(F.col(c) if c in ("doc_id", "text") else F.col("rest").getField(c).alias(c) for c in docs.columns))
