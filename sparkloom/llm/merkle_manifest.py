"""A Merkle manifest of the dataset, folded by an associative monoid of sparse forests.

Every row is a leaf. The leaves of a source, in order, make a tree: each run of three siblings (the last run may be
shorter) becomes its parent, until one node, the subroot, remains. The subroots are the leaves of the top tree.

The monoid: a forest holds the nodes that wait for siblings, by tree, level and index. How many siblings a run has is
known from the number of leaves. A node completes its run or waits; a complete run becomes its parent, which is added in
turn, and a subroot goes on as a leaf of the top tree. Forests merge by adding the open nodes of one to the other, in
any order and grouping, with the same result. Leaves are range-partitioned by source and id, so a task folds
neighbouring leaves and its forest keeps a few open nodes per level. Forests of neighbours are then merged ``fan`` at a
time, in rounds, until one root is left: a tree reduction over tables, whose tasks can be lost and run again. (An RDD's
treeReduce pairs distant partitions, whose open nodes cannot meet.)

Proofs: leaves are dealt out in aligned blocks of 3 ** ``height``. A block's inner nodes are computed again from its
leaves; what lies above it is its path, a row per block, made from the block roots in the same way (they are kept while
the forest is folded), and for a whole tree from the top tree's blocks. No group has more rows than a block has leaves
and one path, however many rows a source has.

Defined results: null fields are ``-``; the rows of one source and id, also null ones, are in the order of their leaves,
so copies are told apart by nothing and any of them is right; further columns are ignored; an empty table gives no rows.
To the driver go the number of trees, the largest number of leaves, and the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_written, shuffle_partitions, written

ARITY = 3
TOP = -1  # the tree of subroots
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its number of bytes, a colon and its value, or as a dash."""
    coded = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in (f.cast("string") for f in fields)]
    return F.sha2(F.concat(*coded), 256)


class Forest:
    """Nodes that wait for siblings. ``kept`` gets block roots (levels that ``height`` divides) and the roots of trees."""

    def __init__(self, n_trees: int, height: int):
        self.n_trees, self.height = n_trees, height
        self.open: dict[tuple[int, int, int], dict[int, tuple[int, str]]] = {}
        self.kept: list[tuple[str, int, int, int, int, str]] = []

    def add(self, tree: int, n: int, level: int, idx: int, value: str, seen: bool = False) -> None:
        """Adds a node of a tree with ``n`` leaves, and every parent that this completes. ``seen``: another forest kept it."""
        width = -(-n // ARITY**level)
        while True:
            if width == 1:
                self.kept.append(("root", tree, n, level, 0, value))
                if tree == TOP:
                    return
                tree, n, level, idx, width = TOP, self.n_trees, 0, tree, self.n_trees
                continue
            if not seen and level and level % self.height == 0:
                self.kept.append(("node", tree, n, level, idx, value))
            seen, run = False, idx // ARITY
            waiting = self.open.setdefault((tree, level, run), {})
            waiting[idx] = (n, value)
            if len(waiting) < min(ARITY, width - run * ARITY):
                return
            del self.open[tree, level, run]
            value = digest(*(waiting[i][1] for i in sorted(waiting)))
            level, idx, width = level + 1, run, -(-width // ARITY)

    def take_kept(self) -> list[tuple[str, int, int, int, int, str]]:
        out, self.kept = self.kept, []
        return out

    def waiting(self) -> list[tuple[str, int, int, int, int, str]]:
        return [("open", tree, n, level, idx, value) for (tree, level, _), run in self.open.items() for idx, (n, value) in run.items()]


_NODES = "frag long, kind string, tree long, n long, level int, idx long, digest string"
_TYPES = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string())


def _folded(n_trees: int, height: int, seen: bool):
    """Rows of (frag, tree, n, level, idx, digest), by frag, to what the forest of each frag keeps and leaves open."""

    def batch(at: int, rows: list[tuple]) -> pa.RecordBatch:
        cols = [[at] * len(rows), *(zip(*rows, strict=True) if rows else [[]] * 6)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], names=["frag", "kind", "tree", "n", "level", "idx", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, forest = None, Forest(n_trees, height)
        for b in batches:
            for frag, *node in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if frag != at or len(forest.kept) >= 50_000:
                    yield batch(at, forest.take_kept())
                if frag != at:
                    yield batch(at, forest.waiting())
                    at, forest = frag, Forest(n_trees, height)
                forest.add(*node, seen=seen)
        yield batch(at, forest.take_kept() + forest.waiting())

    return run


class Block:
    """Neighbouring nodes of one level: steps to the block's root or to the tree's, as (what stands left, right)."""

    def __init__(self, n: int, level: int, values: list[str], height: int):
        self.levels: list[list[tuple[str, str]]] = []
        width = -(-n // ARITY**level)
        for _ in range(height):
            if width == 1:
                break
            steps, above = [], []
            for i in range(0, len(values), ARITY):
                run = values[i : i + ARITY]
                steps += [("".join(run[:k]), "".join(run[k + 1 :])) for k in range(len(run))]
                above.append(digest(*run))
            self.levels.append(steps)
            values, width = above, -(-width // ARITY)

    def path(self, i: int) -> list[tuple[str, str]]:
        out = []
        for steps in self.levels:
            out.append(steps[i])
            i //= ARITY
        return out


def _coded(path: list[tuple[str, str]]) -> str:
    return ";".join(f"{a},{b}" for a, b in path)


def _decoded(path: str) -> list[tuple[str, str]]:
    return [tuple(x.split(",")) for x in path.split(";")] if path else []


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, str, str | None, list[tuple]]]:
    """tree, n, block, path, subroot and (idx, digest, ...) rows of each block; its path comes before its nodes."""
    at, head, rows = None, None, []
    for b in batches:
        for tree, n, block, idx, value, path, subroot, *more in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if (tree, block) != at:
                if rows:
                    yield (*head, rows)
                at, rows = (tree, block), []
            if path is not None:
                head = (tree, n, block, path, subroot)
            else:
                rows.append((idx, value, *more))
    if rows:
        yield (*head, rows)


def _paths_below(level: int, height: int):
    """From blocks at ``level`` with their paths to the paths of their nodes."""

    def rows_of(blocks):
        for tree, n, _, path, subroot, rows in blocks:
            block = Block(n, level, [r[1] for r in rows], height)
            upper = _decoded(path)
            for i, (idx, value, *_) in enumerate(rows):
                yield tree, n, idx, _coded(block.path(i) + upper), value if tree == TOP else subroot

    names, types = ["tree", "n", "block", "path", "subroot"], [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return lambda batches: _batched(rows_of(_blocks(batches)), names, types)


def _proofs(root: str, height: int):
    """From blocks of leaves with their paths to the proofs and verdicts of their rows."""

    def rows_of(blocks):
        for _, n, _, path, subroot, rows in blocks:
            block, upper = Block(n, 0, [r[1] for r in rows], height), _decoded(path)
            for i, (_, leaf, doc_id, other) in enumerate(rows):
                steps, value = block.path(i) + upper, other or leaf
                for left, right in steps:
                    value = digest(left, value, right)
                yield doc_id, leaf, subroot, root, digest(*(x for step in steps for x in step)), value, value == root

    names, types = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"], [pa.int64(), *[pa.string()] * 5, pa.bool_()]
    return lambda batches: _batched(rows_of(_blocks(batches)), names, types)


def _batched(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    while part := list(islice(rows, 2000)):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), types, strict=True)], names=names)


def _numbered(leaves: DataFrame, parts: int) -> tuple[DataFrame, DataFrame]:
    """part, tree, n, idx and the columns of ``leaves`` (source, doc_id, leaf, ...); and tree, source, n of the trees.

    Only counts per (part, source) are summed up over parts, never rows."""
    keys = ["source", "doc_id", "leaf", "tie"]  # the last one parts copies that agree in all
    laid = leaves.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    laid = written(laid.drop("tie").withColumns({"part": F.spark_partition_id().cast("long"), "pos": F.monotonically_increasing_id()}))
    spans = laid.groupBy("part", "source").agg(F.count(F.lit(1)).alias("here"), F.min("pos").alias("first"))
    of = W.partitionBy("source")
    spans = spans.withColumn("before", F.sum("here").over(of.orderBy("part")) - F.col("here")).withColumn("n", F.sum("here").over(of)).withColumn("starts", F.col("before") == 0)
    begun = spans.groupBy("part").agg(F.count_if("starts").alias("begun"))  # a row per part
    offset = begun.select("part", (F.sum("begun").over(W.orderBy("part")) - F.col("begun")).alias("offset"))
    place = F.row_number().over(W.partitionBy("part").orderBy("source")) - 1
    trees = written(spans.filter("starts").withColumn("place", place).join(offset, "part").select((F.col("offset") + F.col("place")).alias("tree"), "source", "n"))
    spans = written(spans.select("part", "source", "first", "before").alias("s").join(trees.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("part", F.col("s.source").alias("source"), "first", "before", "tree", "n"))
    same = (laid["part"] == spans["part"]) & laid["source"].eqNullSafe(spans["source"])
    idx = spans["before"] + laid["pos"] - spans["first"]
    numbered = written(laid.join(spans, same).select(laid["part"], spans["tree"], spans["n"], idx.alias("idx"), *(laid[c] for c in leaves.columns if c != "source")))
    drop_written(laid)
    drop_written(spans)
    return numbered, trees


def _reduced(numbered: DataFrame, n_trees: int, height: int, fan: int) -> list[DataFrame]:
    """kind, tree, n, level, idx, digest of the block roots and roots: forests of the parts, merged in rounds.

    A table for each round; rows of kind ``open`` are those that the next round took up."""
    parts = shuffle_partitions(numbered.sparkSession)
    leaves = numbered.select(F.col("part").alias("frag"), "tree", "n", F.lit(0).alias("level"), "idx", F.col("leaf").alias("digest"))
    rounds = [written(leaves.sortWithinPartitions("frag", "tree", "idx").mapInArrow(_folded(n_trees, height, False), _NODES))]
    while (last := rounds[-1].filter("kind = 'open'").agg(F.max("frag")).first()[0]) is not None:
        if last == 0 and len(rounds) > 1 and rounds[-2].filter("kind = 'open' AND frag > 0").limit(1).count() == 0:
            raise RuntimeError("nodes are missing: one forest is left and its runs are not complete")
        near = rounds[-1].filter("kind = 'open'").select(F.expr(f"frag div {fan}").alias("frag"), "tree", "n", "level", "idx", "digest")
        rounds.append(written(near.repartition(parts, "frag").sortWithinPartitions("frag").mapInArrow(_folded(n_trees, height, True), _NODES)))
    return rounds


def _stage_of(n: Column, height: int, stages: int) -> Column:
    """The first stage whose blocks hold the root of a tree with ``n`` leaves."""
    stage = F.lit(stages)
    for r in reversed(range(stages)):
        stage = F.when(n <= ARITY ** ((r + 1) * height), F.lit(r)).otherwise(stage)
    return stage


def _stages(n: int, height: int) -> int:
    r = 0
    while n > ARITY ** ((r + 1) * height):
        r += 1
    return r


def _climbed_down(leaves: DataFrame, nodes: DataFrame, starts: DataFrame, largest: int, height: int, last: Callable, schema: str) -> DataFrame:
    """From the paths of whole trees (``starts``: tree, n, path, subroot) down to the rows of the leaves, by blocks.

    ``leaves``: tree, n, idx, digest and what ``last`` takes besides; ``nodes``: the block roots."""
    parts, more = shuffle_partitions(leaves.sparkSession), [c for c in leaves.columns if c not in ("tree", "n", "idx", "digest")]
    top, paths = _stages(largest, height), None
    begun = starts.withColumn("stage", _stage_of(F.col("n"), height, top))
    for r in range(top, -1, -1):
        own = begun.filter(F.col("stage") == r).select("tree", "n", F.lit(0).cast("long").alias("block"), "path", "subroot")
        paths = own if paths is None else paths.unionByName(own)
        rows = leaves if r == 0 else nodes.filter((F.col("kind") == "node") & (F.col("level") == r * height)).select("tree", "n", "idx", "digest")
        rows = rows.withColumns({"block": F.expr(f"idx div {ARITY**height}"), "path": F.lit(None).cast("string"), "subroot": F.lit(None).cast("string")})
        both = paths.unionByName(rows, allowMissingColumns=True)
        dealt = both.select("tree", "n", "block", "idx", "digest", "path", "subroot", *(more if r == 0 else [])).repartition(parts, "tree", "block").sortWithinPartitions("tree", "block", "idx")
        if r == 0:
            return dealt.mapInArrow(last, schema)
        paths = written(dealt.mapInArrow(_paths_below(r * height, height), "tree long, n long, block long, path string, subroot string"))


def manifest(docs: DataFrame, *, tampered: Column | None = None, height: int = 7, fan: int = 16) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (``FIELDS``).

    ``tampered`` is the text as it is found when the proofs are checked; by default it is the text itself."""
    spark = docs.sparkSession
    whole = [F.col(c) for c in FIELDS[:4]]
    text = F.col("text").cast("string")
    found = text if tampered is None else tampered
    other = F.when(~found.eqNullSafe(text), leaf_of([*whole, found]))
    leaves = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), leaf_of([*whole, text]).alias("leaf"), other.alias("other")))
    numbered, trees = _numbered(leaves, shuffle_partitions(spark))
    drop_written(leaves)
    n_trees, largest = trees.agg(F.count(F.lit(1)), F.max("n")).first()
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if not n_trees:
        return spark.createDataFrame([], schema)
    rounds = _reduced(numbered, n_trees, height, fan)
    nodes = reduce(DataFrame.unionByName, rounds)
    roots = nodes.filter("kind = 'root'")
    root = roots.filter(F.col("tree") == TOP).select("digest").first()[0]
    subroots = roots.filter(F.col("tree") != TOP)
    # the top tree: its leaves are the subroots, and what it gives a leaf is the path of that whole tree
    top_leaves = subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.col("tree").alias("idx"), "digest")
    top_start = spark.range(1).select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_trees).cast("long").alias("n"), F.lit("").alias("path"), F.lit(root).alias("subroot"))
    above = _climbed_down(top_leaves, nodes.filter(F.col("tree") == TOP), top_start, n_trees, height, _paths_below(0, height), "tree long, n long, block long, path string, subroot string")
    starts = written(above.select(F.col("block").alias("tree"), "path", "subroot").join(trees.select("tree", "n"), "tree").select("tree", "n", "path", "subroot"))
    rows = numbered.select("tree", "n", "idx", F.col("leaf").alias("digest"), "doc_id", "other")
    out = _climbed_down(rows, nodes.filter(F.col("tree") != TOP), starts, largest, height, _proofs(root, height), schema)
    for x in (trees, *rounds):  # the result reads the numbered leaves and the paths of their blocks
        drop_written(x)
    return out
