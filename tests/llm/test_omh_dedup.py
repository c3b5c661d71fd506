import random
from bisect import bisect_left

import numpy as np

from sparkloom.llm.common import ascii_words
from sparkloom.llm.omh_dedup import Words, _settled, aligned, components, keep_one, kmers, near_dup_classes, sketch


def lcs(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b):
            before, best[j + 1] = best[j + 1], before + 1 if x == y else max(best[j + 1], best[j])
    return best[-1]


def similarity(a, b, numbers=None):
    """Labels are unique in a text, so the longest common subsequence is the longest increasing run of matched places."""
    numbers = numbers or Words()
    x, y = (kmers(ascii_words(t), 5, numbers).tolist() for t in (a, b))
    place, ends = {h: i for i, h in enumerate(y)}, []
    for at in (place[h] for h in x if h in place):
        k = bisect_left(ends, at)
        ends[k : k + 1] = [at]
    n = len(ends)
    return n / (len(x) + len(y) - n)


def test_labels_tell_occurrences_apart_and_alignment_is_the_lcs():
    rng, numbers = random.Random(2), Words()
    x = kmers(b"a b c d e a b c d e a b c d e".split(), 5, numbers)
    assert len(set(x.tolist())) == len(x) == 11
    for _ in range(60):
        a = [rng.choice("abcdefgh").encode() for _ in range(rng.randint(5, 60))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            k = rng.randrange(len(b))
            b[k : k + rng.randint(0, 2)] = [b"zz"] * rng.randint(0, 2)
        if rng.random() < 0.3:
            b = b[len(b) // 2 :] + b[: len(b) // 2]
        x, y = kmers(a, 5, numbers), kmers(b, 5, numbers)
        true, got = lcs(x.tolist(), y.tolist()), aligned(x, y, 0.8)
        linked = true >= 0.8 * (len(x) + len(y) - true) - 1e-9
        assert got == true if linked else got <= true


def test_sketches_agree_as_often_as_content_and_order():
    rng = np.random.default_rng(1)
    seeds = rng.integers(1, 2**63, 4000).astype(np.uint64)
    x = rng.integers(1, 2**63, 100).astype(np.uint64)
    y = x.copy()
    y[::10] = rng.integers(1, 2**63, 10)
    assert abs((sketch(x, seeds, 3) == sketch(y, seeds, 3)).mean() - (90 / 110) ** 3) < 0.03
    assert (sketch(x, seeds, 3) == sketch(x[::-1].copy(), seeds, 3)).mean() < 0.01
    assert (sketch(x[:2], seeds[:5], 3) == sketch(x[:2], seeds[:5], 3)).all()


def test_components_of_chains_stars_and_rings(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(k, 200 + (k + 1) % 20) for k in range(200, 220)] + [(300, 300)]
    rng.shuffle(edges)
    got = dict(tuple(r) for r in components(spark.createDataFrame([(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges], "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 160), 100), **dict.fromkeys(range(200, 220), 200)}


def corpus():
    rng = random.Random(11)
    vocab = [f"w{k}" for k in range(400)]
    rows, passage = [], " ".join(rng.choice(vocab) for _ in range(40))
    for g in range(25):
        base = [rng.choice(vocab) for _ in range(rng.choice([3, 8, 20, 60, 200]))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            x = list(base)
            for _ in range(rng.randint(0, max(1, len(x) // 30))):
                x[rng.randrange(len(x))] = rng.choice(vocab)
            rows.append(" ".join(x) + (" " + passage if g % 5 == 0 else ""))
    base = [rng.choice(vocab) for _ in range(120)]
    for _ in range(30):  # a group around the threshold
        x = list(base)
        for _ in range(2):
            x[rng.randrange(len(x))] = rng.choice(vocab)
        rows.append(" ".join(x))
    rows += [rows[0], rows[0].upper() + "!", None, "", None, "...", "!!!", "...", "one two", "One, two"]
    return list(enumerate(rows))


def brute(rows):
    key, root = {}, {}
    for i, t in rows:
        w = tuple(ascii_words(t))
        root[i] = key.setdefault(w or (t or ""), i)
    firsts = [(i, t) for i, t in rows if root[i] == i and ascii_words(t)]
    numbers = Words()
    sets = {i: set(kmers(ascii_words(t), 5, numbers).tolist()) for i, t in firsts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, (i, a) in enumerate(firsts):
        for j, b in firsts[:p]:
            common = len(sets[i] & sets[j]) if 0.8 * len(sets[i]) - 1e-9 <= len(sets[j]) <= len(sets[i]) / 0.8 + 1e-9 else 0  # at least the common subsequence
            if common / (len(sets[i]) + len(sets[j]) - common) >= 0.8 - 1e-9 and find(i) != find(j) and similarity(a, b, numbers) >= 0.8 - 1e-9:
                a_, b_ = sorted((find(i), find(j)))
                root[b_] = a_
    return {i: find(i) for i, _ in rows}


def test_classes_against_all_pairs(spark):
    rows = corpus()
    df = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, `key` string, `a.b` double").repartition(3)
    want = brute(rows)
    got = near_dup_classes(df).collect()
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.class_id) and r.class_size == list(want.values()).count(r.class_id) for r in got)
    kept = keep_one(df)
    assert kept.schema == df.schema and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_repeated_ids_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (None, "c")], "doc_id long, text string")
    assert keep_one(df).count() == 2 and keep_one(df.limit(0)).count() == 0


def test_every_link_inside_a_bucket_is_found(spark):
    # one bucket; classes are what the given links make of it
    rng, size = random.Random(5), 14
    links = {tuple(sorted(rng.sample(range(size), 2))) for _ in range(12)}
    bucketed = spark.createDataFrame([(1, i, size, 3) for i in range(size)], "key long, tid long, size long, centre long")
    n_of = spark.createDataFrame([(i, 50) for i in range(size)], "tid long, n long")
    verified = lambda pairs: spark.createDataFrame([(r.a, r.b, (r.a, r.b) in links) for r in pairs.collect()], "a long, b long, linked boolean")
    kmers_of = lambda some: some.selectExpr("rid AS tid", "explode(sequence(1L, 50L)) AS kmer")
    got = {r.v: r.root for r in _settled(bucketed, n_of, verified, kmers_of, 0.8).collect()}
    want = {i: i for i in range(size)}
    for _ in range(size):
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    assert {i: got.get(i, i) for i in range(size)} == want


def variants(seed, n_words, edits, count):
    rng = random.Random(seed)
    vocab = [f"v{k}" for k in range(5000)]
    base = [rng.choice(vocab) for _ in range(n_words)]
    out = []
    for _ in range(count):
        x = list(base)
        for at in rng.sample(range(n_words), edits if isinstance(edits, int) else rng.randint(*edits)):
            x[at] = rng.choice(vocab)
        out.append(" ".join(x))
    return out


def test_a_group_just_below_the_threshold_costs_few_comparisons(spark):
    # 200 texts of one passage with 2 to 6 edits each: two edits part a text from the passage by 10 of 146 k-mers
    rows = list(enumerate(variants(3, 150, (2, 6), 200)))
    numbers = Words()
    x = {i: kmers(ascii_words(t), 5, numbers) for i, t in rows}
    n_of = spark.createDataFrame([(i, len(v)) for i, v in x.items()], "tid long, n long")
    bucketed = spark.createDataFrame([(1, i, len(rows), 0) for i, _ in rows], "key long, tid long, size long, centre long")
    listed = spark.createDataFrame([(i, int(h)) for i, v in x.items() for h in v.view(np.int64)], "tid long, kmer long")
    asked = []

    def verified(pairs):
        found = [(r.a, r.b, similarity(rows[r.a][1], rows[r.b][1], numbers) >= 0.8 - 1e-9) for r in pairs.collect()]
        asked.extend(found)
        return spark.createDataFrame(found, "a long, b long, linked boolean")

    got = {r.v: r.root for r in _settled(bucketed, n_of, verified, lambda some: listed.join(some.withColumnRenamed("rid", "tid"), "tid"), 0.8).collect()}
    assert {i: got.get(i, i) for i, _ in rows} == brute(rows)
    assert len(asked) < len(rows) ** 2 / 8


def test_recall_of_links_on_a_document_table(spark):
    # every link at the threshold or above that brute force finds must end in one class
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(10_000 + i, t) for i, t in enumerate(variants(8, 80, (0, 3), 60))]
    want, got = brute(rows), {r.doc_id: r.class_id for r in near_dup_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_long_texts_and_empty_tables(spark):
    long = " ".join(f"x{k * 7919 % 30011}" for k in range(60_000))
    edited = long.replace(" x7 ", " y ")
    rows = [(1, long), (2, edited), (3, None), (4, ""), (5, " ".join(long.split()[30_000:]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dup_classes(df).collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    assert near_dup_classes(df.limit(0)).count() == 0
