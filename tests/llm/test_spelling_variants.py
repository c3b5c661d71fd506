import random
import re
import zlib
from collections import Counter

from sparkloom.llm.common import written
from sparkloom.llm.spelling_variants import forms, near_pairs, spelling_variants, words


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def count(rows, noise=97):
    found = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            found[run if h % noise else run[:k] + run[k + 1 :]] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def brute_force(rows, noise=97):
    counts, form = count(rows, noise), {}
    near = {w: [x for x in counts if one_edit(w, x)] for w in counts}
    for w, others in near.items():
        best = min(others, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, counts[w], len(near[w]), counts.get(form[w])


def some_texts():
    rng = random.Random(4)
    base = ["".join(rng.choice("abcéÀ") for _ in range(rng.randint(4, 9))) for _ in range(40)]

    def spelled(w):
        k, c = rng.randrange(len(w)), rng.choice("abcÉ×Z")
        return rng.choice([w, w, w, w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 :], w.upper()])

    return [(i % 50 if i % 17 else None, rng.choice([" ", ", ", "1", "\n", "ł"]).join(spelled(rng.choice(base[: rng.randint(1, 40)])) for _ in range(60))) for i in range(150)]


def test_variants_are_those_of_all_pairs(spark):
    rows = [*some_texts(), (3, None), (4, ""), (5, "12 - ."), (6, "word " * 40_000), (7, "a" * 100_000)]
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, word string")
    got = [tuple(r) for r in spelling_variants(docs, noise=5).select("word", "form", "root", "n", "n_near", "form_n").collect()]
    want = list(brute_force(rows, 5))
    assert len(got) == len(set(got)) and sorted(got, key=str) == sorted(want, key=str)
    assert sum(x[1] is not None for x in want) > 50 and any(x[1] != x[2] for x in want if x[1])


def test_counts_with_the_default_noise(spark):
    rows = some_texts()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.word: r.n for r in words(docs).collect()} == count(rows)


def test_words_with_a_common_segment_do_not_meet(spark):
    rng = random.Random(9)
    listed = [("start" + "".join(rng.choice("abcdefgh") for _ in range(7)), i + 1) for i in range(800)]
    listed = list({w: n for w, n in listed}.items())
    counted = spark.createDataFrame(listed, "word string, n long")
    got = {tuple(sorted((r.a, r.b))) for r in near_pairs(counted).collect()}
    ws = [w for w, _ in listed]
    assert got == {tuple(sorted((a, b))) for i, a in enumerate(ws) for b in ws[:i] if one_edit(a, b)}


def test_ties_and_chains(spark):
    counted = spark.createDataFrame([("abcde", 1), ("abcdf", 2), ("abcdg", 2), ("abcdfh", 4), ("abcdfhi", 8), ("zzzzz", 3)], "word string, n long")
    got = {r.word: (r.form, r.form_n, r.n_near) for r in forms(counted).collect()}
    assert got["abcde"] == ("abcdf", 2, 2)  # of equal counts the smallest
    assert got["abcdf"] == ("abcdfh", 4, 3) and got["abcdfhi"] == (None, None, 1) and got["zzzzz"] == (None, None, 0)


def test_long_chain_reaches_its_end(spark):
    word, parts = "start", []
    for i in range(9):
        parts += [word] * 3 * 2**i
        word += chr(ord("a") + i)
    docs = spark.createDataFrame([(1, " ".join(parts))], "doc_id long, text string")
    got = {r.word: r.root for r in spelling_variants(docs, noise=None).collect()}
    assert len(got) == 9 and set(got.values()) == {"startabcdefgh"}


def test_empty_table(spark):
    assert spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_join_broadcasts_words(spark):
    """A table of words is small as a file and large as the keys that are made of it."""
    counted = written(spark.createDataFrame([(w, i + 1) for i, w in enumerate(("abcde", "abcdf", "abcdfg", "xyzab"))], "word string, n long"))
    docs = spark.createDataFrame([(1, "abcde abcdf abcdf " * 3)], "doc_id long, text string")
    for df in (near_pairs(counted), forms(counted), spelling_variants(docs)):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
