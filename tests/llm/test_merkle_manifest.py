import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from sparkloom.llm.merkle_manifest import Forest, manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    fields = [None if x is None else str(x) for x in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)]
    return h(*("-" if x is None else f"{len(x.encode())}:{x}" for x in fields))


def tree(nodes):
    """Levels of a tree from its leaves to its root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def steps(levels, i):
    for nodes in levels[:-1]:
        first = i // 3 * 3
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])
        i //= 3


def tampered(row):
    own = row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0
    return row["text"].replace("\n", "") if own and row["text"] is not None else row["text"]


def brute_force(rows):
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]))):
        by.setdefault(r["source"], []).append(r)
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(r, r["text"]) for r in by[s]]) for s in sources}
    top = tree([trees[s][-1][0] for s in sources])
    for k, s in enumerate(sources):
        for i, r in enumerate(by[s]):
            value, path = leaf(r, tampered(r)), [*steps(trees[s], i), *steps(top, k)]
            for a, b in path:
                value = h(a, value, b)
            yield r["doc_id"], trees[s][0][i], trees[s][-1][0], top[-1][0], h(*(x for p in path for x in p)), value, value == top[-1][0]


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, leaf int"


def compare(spark, rows, **options):
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(5)
    change = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    key = lambda r: tuple((x is None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r) for r in manifest(docs, tampered=change, **options).collect()), key=key) == sorted(brute_force(rows), key=key)


def some_rows(n, sources, seed=1):
    rng = random.Random(seed)
    return [
        {"doc_id": i, "source": rng.choice(sources), "lang": rng.choice(["en", None, ""]), "n_chars": rng.choice([None, 4, -1]), "text": rng.choice(["a\nb", "", None, "plain", "é\n\n:漢", f"t{i}\n"]), "leaf": 0}
        for i in range(n)
    ]


@pytest.mark.parametrize(("height", "fan"), [(1, 2), (2, 3), (7, 16)])
def test_manifest_is_that_of_the_whole_tree(spark, height, fan):
    compare(spark, some_rows(300, ["hot"] * 6 + [None, "", "a", "É", "z", "\x7f"]), height=height, fan=fan)


def test_many_sources_of_one_row_and_of_few(spark):
    compare(spark, some_rows(120, [f"s{i}" for i in range(80)]), height=1, fan=2)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_last_runs_of_every_length(spark, n):
    compare(spark, some_rows(n, ["one"]), height=2, fan=2)


def test_repeated_rows_and_null_ids(spark):
    rows = some_rows(20, ["a", "b"])
    same = [dict(rows[3]) for _ in range(30)]
    nulls = [dict(r, doc_id=None) for r in rows[:7]]
    compare(spark, rows + same + nulls + [dict(rows[4], text="x\n" * 200_000)], height=2)


def test_tampering_is_found_and_nothing_else(spark):
    rows = some_rows(60, ["a", "b"])
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    assert all(r.verified for r in manifest(docs).collect())
    got = {r.doc_id: r.verified for r in manifest(docs, tampered=F.when(F.col("doc_id") == 7, F.lit("forged")).otherwise(F.col("text"))).collect()}
    assert [k for k, ok in got.items() if not ok] == [7]


def test_empty_table(spark):
    assert manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_forests_merge_in_any_order_and_grouping():
    rng, leaves = random.Random(2), [h(str(i)) for i in range(50)]
    want = tree(leaves)[-1][0]
    for _ in range(20):
        parts = [Forest(1, 2) for _ in range(rng.randint(1, 6))]
        for i in rng.sample(range(50), 50):
            rng.choice(parts).add(0, 50, 0, i, leaves[i])
        while len(parts) > 1:
            rng.shuffle(parts)
            other = parts.pop()
            for _, *node in other.waiting():
                parts[0].add(*node, seen=True)
            parts[0].kept += other.kept
        assert not parts[0].waiting()
        assert [k[-1] for k in parts[0].kept if k[0] == "root" and k[1] == -1] == [want]
        blocks = [k[1:5] for k in parts[0].kept if k[0] == "node"]
        assert len(blocks) == len(set(blocks)) == 6  # the nodes of level 2, each once
