import random

import numpy as np

from sparkloom.llm.common import ascii_words
from sparkloom.llm.fm_decontam import FMIndex, Phrases, contamination, hits, merged, suffix_array, without_spans


def brute(texts, items, window):
    out = []
    for x in texts:
        words, hit, names = ascii_words(x), set(), set()
        for item, t in items:
            w = ascii_words(t)
            n = min(window, len(w))
            for i in range(len(w) - n + 1 if n else 0):
                for j in range(len(words) - n + 1):
                    if words[j : j + n] == w[i : i + n]:
                        hit.update(range(j, j + n))
                        names.add(item)
        out.append((len(words), hit, names))
    return out


def test_suffix_array_and_index_find_every_occurrence():
    rng = np.random.default_rng(2)
    for n in (1, 2, 30, 400):
        x = rng.integers(0, 3, n).astype(np.int32)
        x[-1] = 0
        order = suffix_array(x + 1)
        assert order.tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
        index = FMIndex(x, 2, sample=3)
        for _ in range(20):
            p = rng.integers(1, 3, rng.integers(1, 5)).astype(np.int32)
            lo, hi = index.search(p[None, :])
            want = [i for i in range(n - len(p) + 1) if (x[i : i + len(p)] == p).all()]
            assert sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) == want


def corpus():
    rng = random.Random(9)
    vocab = ["a", "b", "c", "é", "x1"]
    items = [(str(k), " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 9)))) for k in range(12)] + [("n", None), ("p", "!!"), ("dup", "a b"), ("dup", "a b")]
    texts = [" ".join(rng.choice([*vocab, "other", "."]) for _ in range(rng.randint(0, 80))) for _ in range(60)] + [None, "", "A B", "a, B!"]
    return texts, items


def test_hits_against_brute_force():
    texts, items = corpus()
    for window in (2, 4, 10):
        sizes, found = hits([(x or "").encode() for x in texts], Phrases([i for i in items if i[1] is not None], window))
        for n, f, (size, hit, names) in zip(sizes, found, brute(texts, items, window), strict=True):
            assert n == size
            assert (set() if f is None else {k for a, b in zip(f[0][::2], f[0][1::2]) for k in range(a, b)}) == hit
            assert (set() if f is None else f[1]) == names


def test_blocks_of_items_and_small_shards_give_the_same(spark):
    texts, items = corpus()
    docs = spark.createDataFrame([(k, x, "y") for k, x in enumerate(texts)], "doc_id long, text string, spans string")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, n int")
    want = [(k, n, len(h), sorted(i)) for k, (n, h, i) in enumerate(brute(texts, items, 4))]
    for options in ({}, {"shard_bytes": 50, "item_bytes": 300}):
        got = sorted((r.doc_id, r.n_words, sum(r.spans[1::2]) - sum(r.spans[::2]), r["items"]) for r in contamination(docs, bench, window=4, **options).collect())
        assert got == want
    assert contamination(docs.limit(0), bench).count() == 0
    assert all(not r.spans for r in contamination(docs, bench.limit(0)).collect())


def test_removal_spans():
    assert merged([5, 7, 0, 3, 3, 4]) == [0, 4, 5, 7]
    assert without_spans("One, two three: four", [1, 3]) == "One, four"
    assert without_spans("Á b", []) == "Á b" and without_spans("Á b", [0, 2]) == ""
