"""Exact dedup by Patricia-trie owners.

Texts are equal when identical after lower-casing A-Z. A first pass builds a compressed radix trie over each task's
input, whose terminal nodes hold the owner (an id) and the number of rows: copies collapse before anything is
shuffled, however many there are. When such a trie outgrows its memory its largest subtree is spilled: the subtree's
terminals go out as rows and it starts anew. The rows are then dealt by text length and the first bytes of the content
hash, sorted by these, so that one length-and-hash partition is at hand at a time. Its full byte strings, equal or not,
go into one trie, which tells them apart and whose terminals give the final owners and group sizes. Within a partition
rows are sorted by the whole hash, so copies come together; a trie that outgrows its memory spills its largest subtree
between two hashes, when all terminals are complete. Joins on (length, digest) bring the owners back to every row, with
large groups broadcast; two different byte strings with one length and SHA-256 digest would raise an error.

Defined results: a null text counts as the empty text. Rows with a null doc_id take part and never own a group that
has another id. Repeated rows are counted as copies of each other. An empty table gives no rows. Further columns of
the input are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import shuffle_partitions, written


#: Texts of one length whose digests begin with the same bytes share a trie.
BUCKET_BYTES = 2


class _Node:
    __slots__ = ("children", "count", "edge", "owner")

    def __init__(self, edge: bytes):
        self.edge, self.children, self.owner, self.count = edge, {}, None, 0


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by halving: comparisons run in C."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n  # a[:lo] == b[:lo], a[:hi] != b[:hi]
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class PatriciaTrie:
    """Byte strings with an owner and a row count each. ``size`` counts the bytes of the edges, ``keep`` picks owners."""

    def __init__(self, keep=max):
        self.root, self.keep, self.size = _Node(b""), keep, 0

    def add(self, text: bytes, owner: int | None, count: int = 1) -> None:
        node, at = self.root, 0
        while at < len(text):
            child = node.children.get(text[at])
            if child is None:
                node.children[text[at]] = child = _Node(text[at:])
                self.size += len(text) - at + 200
                node = child
                break
            edge = child.edge
            if text.startswith(edge, at):
                node, at = child, at + len(edge)
                continue
            k = _common(edge, text[at : at + len(edge)])
            middle = _Node(edge[:k])
            middle.children[edge[k]] = child
            child.edge = edge[k:]
            node.children[text[at]] = middle
            self.size += 200
            node, at = middle, at + k
        if owner is not None:
            node.owner = owner if node.owner is None else self.keep(node.owner, owner)
        node.count += count

    def terminals(self, top: _Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, int | None, int]]:
        stack = [(top or self.root, prefix)]
        while stack:
            node, before = stack.pop()
            whole = before + node.edge
            if node.count:
                yield whole, node.owner, node.count
            stack.extend((x, whole) for x in node.children.values())

    def spill(self) -> Iterator[tuple[bytes, int | None, int]]:
        """Removes the largest subtree below the root and yields its terminals."""

        def weight(top: _Node) -> int:
            total, stack = 0, [top]
            while stack:
                x = stack.pop()
                total += len(x.edge) + 200
                stack.extend(x.children.values())
            return total

        if self.root.children:
            key, heaviest = max(((k, weight(x)) for k, x in self.root.children.items()), key=lambda p: p[1])
            self.size -= heaviest
            yield from self.terminals(self.root.children.pop(key))


def _rows(found, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    texts, owners, counts, n = [], [], [], 0

    def batch():
        digests = [hashlib.sha256(x).digest() for x in texts]
        return pa.RecordBatch.from_arrays(
            [pa.array([len(x) for x in texts], pa.int64()), pa.array(digests, pa.binary()), pa.array(texts, pa.binary()), pa.array(owners, pa.int64()), pa.array(counts, pa.int64())],
            names=["len", "digest", "body", "owner", "n"],
        )

    for text, owner, count in found:
        texts.append(text)
        owners.append(owner)
        counts.append(count)
        n += len(text)
        if n > most:
            yield batch()
            texts, owners, counts, n = [], [], [], 0
    if texts:
        yield batch()


def _local(keep, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(keep)
        for b in batches:
            for owner, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                trie.add((text.as_py() or "").encode("utf-8", "replace").lower(), owner)
                if trie.size > memory:
                    yield from _rows(trie.spill())
        yield from _rows(trie.terminals())

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        low = [(x.as_py() or "").encode("utf-8", "replace").lower() for x in b.column(1)]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), pa.array([len(x) for x in low], pa.int64()), pa.array([hashlib.sha256(x).digest() for x in low], pa.binary())], names=["doc_id", "len", "digest"]
        )


def _owners(keep, memory: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by length and digest; the texts of one (length, bucket) partition share a trie."""
        at, last, trie = None, None, PatriciaTrie(keep)

        def out(found):
            rows = [(len(x), hashlib.sha256(x).digest(), owner, count) for x, owner, count in found]
            if len({r[:2] for r in rows}) < len(rows):
                raise ValueError("different texts of one length share a digest")
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["len", "digest", "keep_id", "group_size"])

        done: list = []
        for b in batches:
            for n, digest, text, owner, count in zip(*(b.column(i) for i in range(5)), strict=True):
                digest = digest.as_py()
                if (n.as_py(), digest[:BUCKET_BYTES]) != at:
                    at = (n.as_py(), digest[:BUCKET_BYTES])
                    done += trie.terminals()
                    trie = PatriciaTrie(keep)
                elif digest != last and trie.size > memory:
                    done += trie.spill()
                last = digest
                trie.add(text.as_py(), owner.as_py(), count.as_py())
            if done:
                yield out(done)
                done = []
        yield out(trie.terminals())

    return run


def owners(docs: DataFrame, *, keep: str = "smallest", memory: int = 96 << 20) -> DataFrame:
    """len, digest, keep_id, group_size of every group of equal texts. ``keep``: which id owns, smallest or largest."""
    pick = {"smallest": min, "largest": max}[keep]
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = rows.mapInArrow(_local(pick, memory), "len long, digest binary, body binary, owner long, n long")
    # a digest's first bytes order like the digest, so the sort keeps each bucket together
    dealt = local.repartition(shuffle_partitions(spark), "len", F.substring("digest", 1, BUCKET_BYTES)).sortWithinPartitions("len", "digest")
    return dealt.mapInArrow(_owners(pick, memory), "len long, digest binary, keep_id long, group_size long")


#: Groups that a broadcast may hold: those above the N / MOST_HOT-th part of all rows, so never more than this.
MOST_HOT = 20_000


def dedup(docs: DataFrame, *, keep: str = "smallest", memory: int = 96 << 20) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for every row; a repeated owner id marks all its rows as kept.

    Owners come back in two joins. Groups that hold more than the ``MOST_HOT``-th part of all rows, of which there are
    ``MOST_HOT`` at most, are broadcast: their rows stay where they are. The other groups are joined by their keys, where
    the rows that have their owner already are dealt by their ids."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.mapInArrow(_digests, "doc_id long, len long, digest binary")
    groups = written(owners(docs, keep=keep, memory=memory).filter("group_size > 1"))
    many = F.greatest(F.lit(100), F.coalesce(F.sum("group_size"), F.lit(0)) / MOST_HOT)
    hot = groups.join(F.broadcast(groups.agg(many.alias("many"))), F.col("group_size") > F.col("many")).drop("many")
    cold = groups.join(F.broadcast(groups.agg(many.alias("many"))), F.col("group_size") <= F.col("many")).drop("many")
    named = lambda g, k: g.select("len", "digest", F.col("keep_id").alias(f"keep_{k}"), F.col("group_size").alias(f"size_{k}"))
    first = keyed.join(F.broadcast(named(hot, "hot")), ["len", "digest"], "left")
    away = F.when(F.col("size_hot").isNotNull(), F.encode(F.concat(F.lit("id "), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "utf-8")).otherwise(F.col("digest"))
    both = first.withColumn("own", F.col("digest")).withColumn("digest", away).join(named(cold, "cold"), ["len", "digest"], "left")
    keep_id, size = F.coalesce("keep_hot", "keep_cold"), F.coalesce("size_hot", "size_cold")
    return both.select(
        "doc_id",
        F.when(size.isNull(), F.col("doc_id")).otherwise(keep_id).alias("keep_id"),
        F.coalesce(size, F.lit(1).cast("long")).alias("group_size"),
        F.when(size.isNull(), F.lit(True)).otherwise(F.col("doc_id").eqNullSafe(keep_id)).alias("kept"),
        F.lower(F.hex("own")).alias("text_sha256"),
    )
