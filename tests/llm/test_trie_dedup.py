import hashlib
import random

import pyarrow as pa

from sparkloom.llm import trie_dedup
from sparkloom.llm.trie_dedup import PatriciaTrie, dedup


def fold(x):
    return (x or "").encode().lower()


def brute(rows, pick):
    by = {}
    for i, x in rows:
        by.setdefault(fold(x), []).append(i)
    out = []
    for i, x in rows:
        ids = [k for k in by[fold(x)] if k is not None]
        keep = pick(ids) if ids else None
        out.append((i, keep, len(by[fold(x)]), i == keep, hashlib.sha256(fold(x)).hexdigest()))
    return sorted(out, key=str)


def test_trie_holds_prefixes_and_spills():
    rng, t, want = random.Random(1), PatriciaTrie(min), {}
    for k in range(3000):
        x = bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9)))
        t.add(x, k)
        want.setdefault(x, []).append(k)
    spilled = list(t.spill())
    assert len({x[:1] for x, _, _ in spilled}) == 1
    assert {(x, o, n) for x, o, n in [*spilled, *t.terminals()]} == {(x, min(v), len(v)) for x, v in want.items()}


def test_dedup_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["", None, "Ab", "aB", "É", "é", "long " * 500, "long " * 499 + "LONG ", str(rng.randint(0, 9))])) for i in range(400)]
    rows += [(7, "x"), (7, "x"), (None, "lonely"), (None, "Ab")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, digest int").repartition(5)
    for keep, pick in (("largest", max), ("smallest", min)):
        for memory in (96 << 20, 3000):
            got = [tuple(r) for r in dedup(df, keep=keep, memory=memory).collect()]
            assert sorted(got, key=str) == brute(rows, pick)
    assert dedup(df.limit(0)).count() == 0


def test_one_trie_tells_the_texts_of_a_bucket_apart(spark, monkeypatch):
    # all texts of one length in one bucket: the trie decides, with and without spills
    monkeypatch.setattr(trie_dedup, "BUCKET_BYTES", 0)
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abc") for _ in range(5)) * 40) for i in range(500)]
    batches = sorted(((len(x), hashlib.sha256(x.encode()).digest(), x.encode(), i, 1) for i, x in rows))
    names, types = ["len", "digest", "body", "owner", "n"], (pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*batches, strict=True), types, strict=True)], names=names)
    for memory in (96 << 20, 2000):
        parts = [batch.slice(k, 37) for k in range(0, len(rows), 37)]
        got = {r["digest"].hex(): (r["keep_id"], r["group_size"]) for out in trie_dedup._owners(max, memory)(iter(parts)) for r in out.to_pylist()}
        want = {}
        for i, x in rows:
            want.setdefault(hashlib.sha256(x.encode()).hexdigest(), []).append(i)
        assert got == {k: (max(v), len(v)) for k, v in want.items()} and len(got) > 150
