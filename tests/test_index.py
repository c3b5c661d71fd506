import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.text import pack_paragraphs
from sparkloom.operators import index, rank, selection
from sparkloom.sources.lexicon import Lexicon

WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "theta", "iota", "kappa", "lambda", "sigma", "omega"]


def some_docs(n, seed, first=0):
    rng = random.Random(seed)
    para = lambda: " ".join(rng.choice(WORDS[: rng.randint(1, 12)]) for _ in range(rng.randint(1, 60)))
    return [(first + i, rng.choice([None, "", " \n\n "]) if i % 11 == 0 else "\n\n".join(para() for _ in range(rng.randint(1, 9)))) for i in range(n)]


def write(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("len", F.lit("clash")).coalesce(1).write.mode("append").parquet(str(path))


def same(spark, lexicon, rows):
    """The index holds what the documents give when they are read anew."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = index.chunks(docs)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(lexicon.chunks.select("doc_id", "chunk_no", "text")) == key(parts)
    columns = ["doc_id", "chunk_no", "len", "term", "tf"]
    assert key(lexicon.postings.select(*columns)) == key(index.postings(parts).select(*columns))
    df = {r.term: r.n for r in index.postings(parts).groupBy("term").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert {r.term: r.df for r in lexicon.terms.collect()} == df and lexicon.n_chunks == parts.count()


def test_only_changed_files_are_read(spark, tmp_path):
    source, root = tmp_path / "docs", str(tmp_path / "index")
    first, second, third = some_docs(40, 1), some_docs(25, 2, 100), some_docs(30, 3, 200)
    write(spark, first, source)
    lexicon = Lexicon(spark, root)
    assert lexicon.refresh(str(source)) == 1 and lexicon.refresh(str(source)) == 0
    same(spark, lexicon, first)
    write(spark, second, source)
    assert Lexicon(spark, root).refresh(str(source)) == 1
    again = Lexicon(spark, root)  # another reader, as after a restart
    assert again.refresh(str(source)) == 0
    same(spark, again, first + second)
    gone = next(p for p in source.glob("*.parquet") if min(r.doc_id for r in spark.read.parquet(str(p)).collect()) == 0)
    os.remove(gone)
    write(spark, third, source)
    assert again.refresh(str(source)) == 1
    same(spark, again, second + third)
    again.compact()
    same(spark, again, second + third)
    compacted = Lexicon(spark, root)
    assert compacted.refresh(str(source)) == 0
    same(spark, compacted, second + third)


def test_an_interrupted_build_leaves_the_last_version(spark, tmp_path, monkeypatch):
    source, root = tmp_path / "docs", str(tmp_path / "index")
    first, second = some_docs(12, 4), some_docs(12, 5, 50)
    write(spark, first, source)
    Lexicon(spark, root).refresh(str(source))
    write(spark, second, source)

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(Lexicon, "_write_terms", lost)
        with pytest.raises(RuntimeError):
            Lexicon(spark, root).refresh(str(source))
    same(spark, Lexicon(spark, root), first)
    lexicon = Lexicon(spark, root)
    assert lexicon.refresh(str(source)) == 1
    same(spark, lexicon, first + second)


def test_a_session_that_does_not_know_the_tables(spark, tmp_path):
    rows = some_docs(30, 9)
    write(spark, rows, tmp_path / "docs")
    lexicon = Lexicon(spark, str(tmp_path / "index"))
    lexicon.refresh(str(tmp_path / "docs"))
    for kind in ("chunks", "postings"):
        spark.sql(f"DROP TABLE {lexicon._name(kind, 0)}")
    again = Lexicon(spark, str(tmp_path / "index"))
    assert again.refresh(str(tmp_path / "docs")) == 0
    same(spark, again, rows)
    df = index.bm25_all(again, spark.createDataFrame([(1, "alpha beta")], "qid long, query string"))
    assert "Exchange hashpartitioning" not in df._jdf.queryExecution().executedPlan().toString()


def test_a_source_without_rows(spark, tmp_path):
    source = tmp_path / "docs"
    write(spark, [], source)
    lexicon = Lexicon(spark, str(tmp_path / "index"))
    lexicon.refresh(str(source))
    q = spark.createDataFrame([(1, "alpha beta")], "qid long, query string")
    assert (lexicon.n_chunks, lexicon.chunks.count(), index.bm25_top(lexicon, q, 3).count(), index.legacy_all(lexicon, q).count()) == (0, 0, 0, 0)


def test_rankings_over_the_index_are_those_over_chunks(spark, tmp_path, monkeypatch):
    rows = some_docs(120, 6) + [(500 + i, "alpha alpha kappa") for i in range(30)]
    write(spark, rows, tmp_path / "docs")
    lexicon = Lexicon(spark, str(tmp_path / "index"))
    lexicon.refresh(str(tmp_path / "docs"))
    q = spark.createDataFrame([(1, "alpha beta"), (2, "kappa kappa omega unknown"), (3, " ".join(WORDS)), (4, "nothing here"), (5, "")], "qid long, query string")
    parts = index.chunks(spark.createDataFrame(rows, "doc_id long, text string"))
    listed = lambda df: sorted((r.qid, r["rank"], r.doc_id, r.chunk_no, round(r.score, 8)) for r in df.collect())
    for held in (500_000, 3):
        monkeypatch.setattr(index, "HELD_TERMS", held)
        assert listed(index.bm25_top(lexicon, q, 500)) == listed(index.top_per_query(index.bm25(parts, q), 500))
        assert listed(index.top_per_query(index.legacy_all(lexicon, q), 7)) == listed(index.top_per_query(index.legacy_rank(parts, q), 7))


def test_sums_over_postings_need_no_shuffle(spark, tmp_path):
    write(spark, some_docs(20, 7), tmp_path / "docs")
    lexicon = Lexicon(spark, str(tmp_path / "index"))
    lexicon.refresh(str(tmp_path / "docs"))
    df = index.bm25_all(lexicon, spark.createDataFrame([(1, "alpha beta")], "qid long, query string"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan


def fused(rows, k=60):
    """Reciprocal rank fusion by plain sorting: score of each (qid, doc, chunk)."""
    out = {}
    for q in {r[0] for r in rows}:
        channels = {c: sorted((-round(s, 9), d, n) for x, c, d, n, s in rows if (x, c) == (q, ch) and s > 0) for ch in (1, 2) for c in (ch,)}
        channels = {c: v for c, v in channels.items() if v}
        for v in channels.values():
            for place, (_, d, n) in enumerate(v, 1):
                out[q, d, n] = out.get((q, d, n), 0.0) + (k + 1) / (k + place) / len(channels)
    return out


@pytest.mark.parametrize("slack", [0.0, 0.1, 0.37, 5.0])
def test_fusion_by_thresholds_is_that_of_whole_rankings(spark, slack):
    rng, rows = random.Random(8), []
    for q in range(6):
        for d in range(150 if q else 3):
            for c in (1, 2) if q != 2 else (1,):
                if rng.random() < 0.8:
                    rows.append((q, c, d, d % 2, rng.choice([0.5, 0.0, rng.random(), rng.lognormvariate(0, 3)])))
    got = {(r.qid, r.doc_id, r.chunk_no): r.score for r in rank.fused_top(spark.createDataFrame(rows, "qid long, channel int, doc_id long, chunk_no int, score double"), 8, slack, first=4).collect()}
    want = fused(rows)
    for q in range(6):
        scores = sorted((s for k, s in want.items() if k[0] == q), reverse=True)
        floor = scores[7] - slack if len(scores) >= 8 else float("-inf")
        assert {k for k, s in want.items() if k[0] == q and s >= floor} <= {k for k in got if k[0] == q}
    assert all(math.isclose(s, want[k], abs_tol=1e-12) for k, s in got.items())
    for q in range(6):  # and no others
        scores = sorted((s for k, s in want.items() if k[0] == q), reverse=True)
        assert len(scores) < 8 or all(s >= scores[7] - slack - 1e-8 for k, s in got.items() if k[0] == q)


def test_fusion_stops_before_long_rankings_end(spark, monkeypatch):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("qid"), F.explode(F.array(F.lit(1), F.lit(2))).alias("channel"), F.col("id").alias("doc_id"), F.lit(0).alias("chunk_no"), (1.0 / (1 + F.col("id"))).alias("score"))
    ranked = []
    monkeypatch.setattr(rank, "spread_rank", lambda *_: ranked.append(_))
    got = rank.fused_top(rows, 8, 0.1, first=16)
    assert sorted(r.doc_id for r in got.collect()) == [d for d in range(20_000) if 61 / (61 + d) >= 61 / 68 - 0.1] and not ranked


def test_fusion_of_nothing(spark):
    assert rank.fused_top(spark.createDataFrame([], "qid long, channel int, doc_id long, chunk_no int, score double"), 8, 0.3).count() == 0


def test_counts_of_what_stands_before_with_ties_in_any_portions():
    rng = np.random.default_rng(2)
    for _ in range(40):
        n = int(rng.integers(1, 60))
        score = rng.choice([0.0, 0.25, 1e-9, 0.5 + 4e-10, 0.5, 3.1234567895, 7e5, np.inf, np.nan, -1.0, rng.random()], n)
        key, weight = rng.permutation(n), rng.integers(1, 4, n)
        able = np.flatnonzero(~(score <= 0))
        wanted = rng.choice(able, int(rng.integers(0, len(able) + 1)), replace=False)
        ahead = selection.Ahead(score[wanted], key[wanted])
        for part in np.array_split(np.arange(n), 3):
            ahead.add(score[part], key[part], weight[part])
        place = lambda i: (-np.inf if np.isnan(score[i]) else -min(round(score[i], 9), 1e300), key[i])
        assert ahead.counts().tolist() == [sum(weight[j] for j in able if place(j) < place(i)) for i in wanted]


@pytest.mark.parametrize("r", [80, 4000])
def test_hybrid_ranks_by_places_are_those_of_all_pairs(spark, tmp_path, monkeypatch, r):
    rng = random.Random(11)
    rows = some_docs(120, 5)
    rows += [(1000 + i, rows[7][1]) for i in range(30)]  # copies tie in both channels
    write(spark, rows, tmp_path / "docs")
    lexicon = Lexicon(spark, str(tmp_path / "index"))
    lexicon.refresh(str(tmp_path / "docs"))
    vector = lambda: [float(rng.choice([-1, 0, 1, 2])) for _ in range(3)]
    vectors = [(d, v) for d, _ in rows for v in (vector(),) if d % 3 or d >= 1000] + [(500, vector()), (501, None), (502, [])]
    embeddings = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").repartition(3)
    queries = spark.createDataFrame([(q, " ".join(rng.choice(WORDS) for _ in range(q))) for q in range(1, 7)] + [(7, "unheard"), (8, "")], "qid long, query string")
    asked = spark.createDataFrame([(1, 1), (2, 500), (3, 1), (4, 501), (5, 502), (6, 1003), (7, 4), (8, 5)], "qid long, vec_id long")
    slack = 61 / (2 * 68) - 61 / (60 + r) - 1e-6
    read = lambda df: {(x.qid, x.doc_id, x.chunk_no): x.score for x in df.collect()}
    want = read(rank._fused_pairs(lexicon, queries, embeddings, asked, 8, slack, 60))
    monkeypatch.setattr(index, "bm25_all", None)  # as rows, pairs of queries and chunks grow with both
    monkeypatch.setattr(rank, "dense_scores", None)
    got = read(rank.fused_places(lexicon, queries, embeddings, asked, 8, slack, r))
    assert got.keys() == want.keys() and len({q for q, _, _ in got}) == 8 and all(math.isclose(s, want[k], abs_tol=1e-12) for k, s in got.items())
    assert rank.reach(8, slack) == r and rank.reach(8, 0.45) is None
    if r == 80:
        monkeypatch.setattr(rank, "HELD_PLACES", 1000)
        found = rank.hybrid(lexicon, queries, embeddings, asked, hints=["alpha"]).collect()
        assert {x.qid for x in found} == set(range(1, 9)) and all(x.rank <= 8 for x in found)


def test_blocked_dense_scores_with_nulls_ties_and_many_passes(spark, monkeypatch):
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-2, 3, 5).tolist() for i in range(200)}
    rows = [(i, [float(x) for x in v]) for i, v in vectors.items()] + [(900, None)]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    q = e.filter("vec_id % 7 = 0")
    monkeypatch.setattr(rank, "PASS", 10)
    monkeypatch.setattr(rank, "BLOCK", 3)
    got = {}
    for r in rank.dense_top(e, q, 6).collect():
        got.setdefault(r.q_id, {})[r["rank"]] = (r.vec_id, r.score)
    for i in range(0, 200, 7):
        want = sorted(((-float(np.dot(vectors[i], v)), j) for j, v in vectors.items() if j != i))[:6]
        assert [(got[i][k][0], -got[i][k][1]) for k in range(1, 7)] == [(j, s) for s, j in want]
    assert len(got) == 29
    assert rank.dense_scores(e, q).count() == 29 * 199
    assert rank.dense_scores(e, e.filter("vec_id < 0")).count() == 0


def picked(values, f):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    return v[round(f * (len(v) - 1))]


def test_selection_of_heavy_tails_equal_values_and_extremes(spark):
    rng = random.Random(6)
    groups = {
        "tail": [rng.paretovariate(0.3) * rng.choice([1, -1]) for _ in range(700)],
        "equal": [3.25] * 400,
        "one": [-7.0],
        "ends": [float("inf"), float("-inf"), 0.0, 1e-308, -1e-308, 1e308, 5e-324] * 3,
        "close": [1.0 + i * 2**-50 for i in range(300)],
    }
    rows = [(k, x) for k, v in groups.items() for x in v] + [("null", None)]
    fractions = {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0}
    got = {r.k: [r[f] for f in fractions] for r in selection.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "v", fractions, ["k"]).collect()}
    assert got == {k: [picked(v, f) for f in fractions.values()] for k, v in groups.items()}




def test_selection_never_sorts_a_large_group(spark):
    """A column of a million rows, half of them equal and the rest heavy-tailed: rows only become counts before any window."""
    rows = spark.range(1_000_000).select(F.when(F.col("id") % 2 == 0, F.lit(42.0)).otherwise(F.pow(F.lit(10.0), F.pmod(F.xxhash64("id"), F.lit(300)))).alias("v"))
    df = selection.nearest_rank(rows, "v", {"p50": 0.5, "p99": 0.99})
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(plan) if "Window [" in line]
    assert windows and all("Aggregate [" in "".join(plan[i + 1 : i + 3]) for i in windows if "Window [" not in plan[i + 1])
    values = sorted(([42.0] * 500_000) + [r.v for r in rows.filter("v <> 42").collect()])
    assert df.first() == (values[round(0.5 * (len(values) - 1))], values[round(0.99 * (len(values) - 1))])


def test_positions_of_groups_with_ties(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "a", "a", None]), rng.choice([1.0, 2.0]), i) for i in range(500)]
    got = {r.i: r["rank"] for r in selection.positions(spark.createDataFrame(rows, "g string, s double, i long").repartition(6), ["g"], [-F.col("s"), F.col("i")]).collect()}
    for g in ("a", None):
        order = sorted((-s, i) for k, s, i in rows if k == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def plain_pack(text, size, overlap):
    paras = [p.strip() for p in "\n".join(x.strip() for x in text.split("\n")).strip().split("\n\n") if p.strip()]
    done, held = [], ""
    for p in paras:
        joined = f"{held}\n\n{p}" if held else p
        if len(joined) <= size:
            held = joined
            continue
        done += [held] * bool(held)
        held = p if len(p) <= size else ""
        if not held:
            done += [p[a : a + size] for a in range(0, max(1, len(p) - overlap), size - overlap)]
    return done + [held] * bool(held)


def test_packing_many_paragraphs(spark):
    rng = random.Random(2)
    texts = ["\n\n".join("x" * rng.randint(1, 14) for _ in range(n)) for n in (1, 2, 5, 60, 4000)] + ["", " \n\n\n ", "a" * 31, "a" * 31 + "\n\nb\n\n" + "c" * 29]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", pack_paragraphs(F.col("t"), 12, 3).alias("c")).collect()}
    assert got == {i: plain_pack(t, 12, 3) for i, t in enumerate(texts)}
