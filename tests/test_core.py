import math
import random

import pytest
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.config import DEFAULT, KPI_MEANS, Limits, Ranking
from sparkloom.functions import rules
from sparkloom.functions import text as T
from sparkloom import queries
from sparkloom.operators import compose, files, gates, index, ireval, kpi, rank, structure
from sparkloom.streaming.limiter import Window, decide_batch


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def lit(x):
    return F.lit(x)


# text


def test_tokens_keep_repetition_and_drop_short_words(spark):
    assert one(spark, T.tokens(lit("Cost, cost; COST of it é_b2"))) == ["cost", "cost", "cost", "_b2"]
    assert one(spark, T.token_set(lit("aaa bbb aaa"))) == ["aaa", "bbb"]


@pytest.mark.parametrize(("size", "overlap"), [(10, 3), (5, 0), (7, 6)])
def test_windows_cover_the_text(spark, size, overlap):
    for n in (0, 1, size, size + 1, 3 * size, 101):
        x = "".join(chr(97 + k % 26) for k in range(n))
        want, start = [x[:size]], 0
        while start + size < n:
            start += size - overlap
            want.append(x[start : start + size])
        assert one(spark, T.windows(lit(x), size, overlap)) == want


def test_an_overlap_as_large_as_the_chunk_is_refused():
    with pytest.raises(ValueError):
        Ranking(chunk_chars=100, overlap_chars=100)


def pack(text, size, overlap):
    paras = [p.strip() for p in "\n".join(x.strip() for x in text.split("\n")).strip().split("\n\n") if p.strip()]
    out, open_ = [], ""
    for p in paras:
        if len(p) > size:
            if open_:
                out.append(open_)
                open_ = ""
            start = 0
            while True:
                out.append(p[start : start + size])
                if start + size >= len(p):
                    break
                start += size - overlap
        elif not open_:
            open_ = p
        elif len(open_) + 2 + len(p) <= size:
            open_ += "\n\n" + p
        else:
            out.append(open_)
            open_ = p
    return out + [open_] * bool(open_)


def test_paragraph_packing_against_a_loop(spark):
    rng = random.Random(1)
    for _ in range(12):
        x = "\n\n".join("w" * rng.randint(0, 40) for _ in range(rng.randint(0, 9)))
        assert one(spark, T.pack_paragraphs(lit(x), 30, 5)) == pack(x, 30, 5)


def test_titles_and_keys(spark):
    assert one(spark, T.slide_title(lit("Deck | Topic: - Cost plan. "))) == "Cost plan."
    assert one(spark, T.slide_title(lit("Deck Topic: abc"))) == "Deck Topic: abc" and one(spark, T.slide_title(lit("– Plan, v2; —"))) == "Plan, v2;" and one(spark, T.slide_title(lit(None).cast("string"))) == ""
    assert one(spark, T.slide_title(lit("a" * 60 + " " + "b" * 39 + " c"))) == "a" * 60 + "…"
    assert one(spark, T.caption_subject(lit("1. Set up:"))) == "1" and one(spark, T.caption_subject(lit("Costs of the plan. More:"))) == "Costs of the plan"
    long = one(spark, T.slide_title(lit("word " * 60)))
    assert len(long) <= 101 and long.endswith("…")
    assert one(spark, T.heading_key(lit("The 2 nd  Plan: A/B"))) == "the 2nd plan a b"
    assert one(spark, T.occurs_alone(lit("a per-slide note"), "Slide")) is False and one(spark, T.occurs_alone(lit("Slide 14"), "Slide")) is True


def test_tables(spark):
    rows = F.array(*[lit(x) for x in ("| a | b |", "|---|---|", "| 1 |")])
    assert one(spark, structure.rectangular(rows)) == [["a", "b"], ["1", ""]]
    assert one(spark, structure.compact_matrix(F.array(F.array(lit("x"), lit("")), F.array(lit("y"), lit(""))))) is None


# ranking


def test_bm25_ranks_a_rare_pair_first_and_prefers_the_shorter(spark):
    docs = [(0, 0, "cost report for the plant"), (1, 0, "zebra quark appears here"), (2, 0, "zebra alone in a much longer text about many other things"), (3, 0, "zebra alone")]
    parts = spark.createDataFrame(docs, "doc_id long, chunk_no int, text string")
    q = spark.createDataFrame([(1, "zebra quark"), (2, "zebra"), (3, "unknownterm")], "qid long, query string")
    got = {(r.qid, r.rank): r.doc_id for r in index.top_per_query(index.bm25(parts, q), 5).collect()}
    assert got[(1, 1)] == 1 and [got[(2, k)] for k in (1, 2, 3)] == [3, 1, 2] and not any(k[0] == 3 for k in got)
    idf = {r.term: r.idf for r in index.term_idf(index.postings(parts), parts.agg(F.count(F.lit(1)).alias("n_chunks"))).collect()}
    assert min(idf.values()) >= 0 and math.isclose(idf["zebra"], math.log(1 + (4 - 3 + 0.5) / 3.5))


def test_rrf_is_one_for_agreement_and_ignores_scale(spark):
    rows = [(1, 1, 5.0), (1, 2, 2.0), (1, 3, 0.0), (2, 1, 9.0), (2, 3, 1.0)]
    make = lambda f: {r.doc_id: r.score for r in rank.rrf(spark.createDataFrame([(c, d, s * f) for c, d, s in rows], "channel int, doc_id long, score double")).collect()}
    assert make(1.0)[1] == 1.0 and make(1.0) == make(1000.0)
    assert rank.rrf(spark.createDataFrame([], "channel int, doc_id long, score double")).count() == 0


def loop_mmr(items, k, lam):
    sets = {i: set(x.split()) for i, _, x in items}
    left, chosen = list(items), []
    while left and len(chosen) < k:
        best = max(left, key=lambda c: (lam * c[1] - (1 - lam) * max((len(sets[c[0]] & sets[j[0]]) / len(sets[c[0]] | sets[j[0]]) for j in chosen), default=0.0), -items.index(c)))
        chosen.append(best)
        left.remove(best)
    return {c[0] for c in chosen}


def test_mmr_with_its_bound_equals_the_plain_loop(spark):
    rng = random.Random(7)
    rows, want = [], {}
    for q in range(25):
        items = sorted(((d, round(rng.random(), 3), " ".join(rng.choice(["aaa", "bbb", "ccc", "ddd", "eee"]) for _ in range(4))) for d in range(14)), key=lambda x: (-x[1], x[0]))
        want[q] = loop_mmr(items, 4, 0.82)
        rows += [(q, d, 0, s, x) for d, s, x in items]
    got = {}
    texts = spark.createDataFrame(rows, "qid long, doc_id long, chunk_no int, score double, text string")
    for r in rank.mmr(texts.withColumn("tokens", rank.token_hashes(F.col("text"))), 4, 0.82).collect():
        got.setdefault(r.qid, set()).add(r.doc_id)
    assert got == want


def test_budget_clips_the_last(spark):
    df = spark.createDataFrame([(1, 1, "a" * 6), (1, 2, "b" * 6), (1, 3, "c" * 6)], "qid long, rank int, text string")
    assert [r.text for r in rank.budget(df, 10).orderBy("rank").collect()] == ["a" * 6, "b" * 4]


# evaluation


def test_metrics_of_known_ranks(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (2, 20, 2), (3, 99, 1)], "qid long, doc_id long, rank int")
    truth = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "qid long, relevant_id long")
    m = ireval.metrics(ireval.relevant_ranks(ranked, truth)).first()
    assert m.n_queries == 3 and math.isclose(m.mrr, 0.5) and math.isclose(m.ndcg_at_10, (1 + 1 / math.log2(3)) / 3) and math.isclose(m.recall_at_1, 1 / 3)
    empty = ireval.metrics(ireval.relevant_ranks(ranked, truth.limit(0))).first()
    assert empty.n_queries == 0 and empty.mrr == 0.0


def test_known_items_never_use_unique_terms(spark):
    words = [["aaa", "bbb", "ccc"], ["ddd", "eee", "fff"], ["aaa", "ddd", "ggg"], ["bbb", "eee", "hhh"], ["ccc", "fff", "ggg"], ["hhh", "iii", "jjj"]]
    parts = spark.createDataFrame([(i, 0, " ".join(w)) for i, w in enumerate(words)], "doc_id long, chunk_no int, text string")
    got = ireval.known_item_queries(index.postings(parts), parts.agg(F.count(F.lit(1)).alias("n_chunks")), terms=3, max_df_ratio=0.5).collect()
    assert {r.doc_id for r in got} == {0, 1, 2, 3, 4} and all("iii" not in r.query for r in got)


def test_gates_skip_missing_metrics(spark):
    s = spark.createDataFrame([(1.0, 0.8, None)], "pass_rate double, avg_must_include_coverage double, p95_latency_ms double")
    got = {r.metric: r.status for r in gates.check_gates(s).collect()}
    assert got["pass_rate"] == "pass" and got["avg_must_include_coverage"] == "fail" and got["p95_latency_ms"] == "skipped" and got["refusal_accuracy"] == "skipped"


# rules and structure


@pytest.mark.parametrize(
    ("line", "noise"),
    [
        ("", True), ("[Slide 4]", True), ("Page 12", True), ("Anna Berg (Lead), Max Holm (QA)", True), ("Anna Berg, Max Holm, Eva Lund", True), ("Anna has confirmed the date", True),
        ("ok", True), ("why? when?", True), ("--- ---", True), ("Anna takes 3 X days", True), ("The cluster runs in two zones", False), ("It was confirmed by the board of the plant", False), ("2024", False),
    ],
)
def test_noise_lines(spark, line, noise):
    assert one(spark, rules.is_noise(lit(line))) is noise


def test_policy_and_structure(spark):
    assert one(spark, rules.policy_flags(lit("mail a.b@c.org about public_release_unapproved"))) == ["pii_detected:email", "disallowed_term:public_release_unapproved"]
    doc = "## Part 1: A\n### Step 1: x\n### One\n### Two\n| a |\n| --- |\n| 1 |\n| 2 |\n[[IMAGE: slide 3]]"
    got = spark.range(1).select(*(c.alias(k) for k, c in rules.structure(lit(doc)).items())).first()
    assert (got.parts, got.procedure_steps, got.topics, got.tables_rendered, got.table_rows, got.figures_embedded, got.content_integrity_pass) == (1, 1, 2, 1, 2, 1, True)
    leaky = spark.range(1).select(*(c.alias(k) for k, c in rules.structure(lit("see slide 4 (QA) looping in **x**")).items())).first()
    assert leaky.leak_slide_reference == leaky.leak_roster_role == leaky.leak_meeting_chatter == 1 and leaky.leak_raw_bold_marker == 2 and not leaky.content_integrity_pass


def loop_topics(slides):
    out, last = {}, None
    for title, lines in slides:
        last = title or last or "Overview"
        out.setdefault(last.lower(), []).extend(lines)
    return [list(dict.fromkeys(x)) for x in out.values() if x]


def test_topic_merge_against_a_loop(spark):
    rng = random.Random(3)
    decks = {d: [(rng.choice(["", "Aa", "Bb", "aa"]), [rng.choice("pqrs") * 3 for _ in range(rng.randint(0, 3))]) for _ in range(rng.randint(1, 7))] for d in range(30)}
    df = spark.createDataFrame([(d, i, t, x) for d, s in decks.items() for i, (t, x) in enumerate(s)], "deck long, slide_no long, title string, lines array<string>")
    got = {}
    for r in structure.merge_topics(df).orderBy("deck", "topic_no").collect():
        got.setdefault(r.deck, []).append(r.lines)
    assert got == {d: w for d, s in decks.items() if (w := loop_topics(s))}


def test_postprocess_keeps_long_repeats_and_single_blanks(spark):
    long = "x" * 150
    text = f"\n\nintro\n\n\nIntro\n# head\n# head\n{long}\n{long}\n[Slide 3]\nend\n\n"
    assert structure.postprocess(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().text == f"intro\n\n# head\n# head\n{long}\n{long}\nend"


def test_narratives_keep_the_later_block(spark):
    body = "b" * 90
    assert one(spark, structure.narratives(lit(f"[TOPIC 1]\n{'a' * 90}\n - [topic 2]:\nshort\n[ Topic  1 ]\n## Head\n{body}"))) == {1: body}
    assert one(spark, structure.narratives(lit(f"[TOPIC 1] inline {body}"))) == {} and one(spark, structure.narratives(lit(""))) == {}


# run records


def test_percentiles_by_nearest_rank(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 40):
        v = [float(rng.randint(0, 9)) for _ in range(n)]
        got = kpi.nearest_rank(spark.createDataFrame([(x,) for x in v], "v double"), "v", {"p50": 0.5, "p95": 0.95}).first()
        assert (got.p50, got.p95) == tuple(sorted(v)[round(f * (n - 1))] for f in (0.5, 0.95))


def runs_schema():
    own = [f for fields in KPI_MEANS.values() for f in fields.values() if f not in ("topics", "llm_topics")]
    return "succeeded boolean, used_fallback boolean, topics int, llm_topics int, total_latency_ms double, leaks map<string,int>, content_integrity_pass boolean, slides_ingested long, " + ", ".join(f"{f} double" for f in own), len(own)


def test_snapshot_of_no_runs(spark):
    got = kpi.snapshot(spark.createDataFrame([], runs_schema()[0])).first()
    assert got.runs_observed == 0 and all(x == 0 for x in got)


def test_snapshot_of_runs(spark):
    schema, n = runs_schema()
    rows = [(ok, False, 2, 2 * (i % 2), 100.0 * i, {"a": i}, i != 4, i, *[float(i)] * n) for i, ok in ((1, True), (2, True), (3, True), (4, False))]
    got = kpi.snapshot(spark.createDataFrame(rows, schema)).first()
    assert (got.runs_observed, got.availability_success_rate, got.availability_degraded_generation_rate, got.availability_documents_delivered) == (4, 0.75, 0.5, 3)
    assert (got.latency_ms_max, got.latency_ms_p50, got.latency_ms_p99) == (300.0, 200.0, 300.0) and got.latency_ms_avg_render == got.document_yield_avg_topics == 2.0
    assert got.content_integrity_total_leaks_detected == 10 and got.content_integrity_clean_document_rate == 0.75 and len(got) == 38


def test_percentiles_over_bins_are_exact(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), rng.lognormvariate(0, 3)) for _ in range(500)] + [("c", 1.5)] * 7
    got = {r.k: (r.p50, r.p95, r.p99) for r in kpi.nearest_rank(spark.createDataFrame(rows, "k string, v double"), "v", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["k"]).collect()}
    for k in ("a", "b", "c", None):
        v = sorted(x for j, x in rows if j == k)
        assert got[k] == tuple(v[round(f * (len(v) - 1))] for f in (0.5, 0.95, 0.99))


def test_spread_ranks_are_row_numbers(spark):
    rng = random.Random(4)
    rows = [(c, d, rng.choice([0.1, 0.5, 0.5, rng.random()])) for c in range(3) for d in range(80)] + [(9, 1, 2.0)]
    got = {(r.channel, r.doc_id): r["rank"] for r in rank.spread_rank(spark.createDataFrame(rows, "channel int, doc_id long, score double"), ["channel"], ["doc_id"]).collect()}
    for c in (0, 1, 2, 9):
        order = sorted(((-round(s, 9), d) for k, d, s in rows if k == c))
        assert [got[(c, d)] for _, d in order] == list(range(1, len(order) + 1))


def test_limiter_denials_leave_no_trace(spark):
    w = Window(2, 60.0)
    assert [w.decide(t)[0] for t in (0, 1, 30, 62)] == [True, True, False, True]
    rng = random.Random(5)
    hits = [(rng.choice("ab"), i, float(t)) for i, t in enumerate(sorted(rng.randint(0, 300) for _ in range(80)))]
    got = {r.event_id: r.allowed for r in decide_batch(spark.createDataFrame(hits, "key string, event_id long, ts double"), Limits(3, 1, 60.0)).collect()}
    state = {"a": Window(4, 60.0), "b": Window(4, 60.0)}
    assert got == {i: state[k].decide(t)[0] for k, i, t in hits}
    assert all(r.allowed for r in decide_batch(spark.createDataFrame(hits, "key string, event_id long, ts double"), Limits(0)).collect())


def test_client_key_and_size(spark):
    assert one(spark, rules.client_key(lit("  "), lit("h"))) == "ip:h" and one(spark, rules.client_key(lit(None).cast("string"), lit(None).cast("string"))) == "ip:unknown"
    assert one(spark, rules.oversize_bytes(lit("100"), 50)) == 100 and one(spark, rules.oversize_bytes(lit("x"), 50)) is None and one(spark, rules.oversize_bytes(lit("100"), 0)) is None


def test_hinted_files_alone(spark):
    df = spark.createDataFrame([("a/plan.md",), ("b/cost.txt",), ("c/deck.pptx",)], "path string")
    assert [r.path for r in files.select_files(df, "cost", ["plan.md"]).collect()] == ["a/plan.md"]
    assert [r.path for r in files.select_files(df, "nothing", [], 2).collect()] == ["c/deck.pptx", "a/plan.md"]


def test_defaults():
    assert DEFAULT.ranking.chunk_chars == 900 and DEFAULT.limits.requests_per_minute == 60


def test_mmr_sees_past_a_group_of_copies(spark):
    copies = [(1, d, 0, 1.0, "same words here") for d in range(60)]
    rows = spark.createDataFrame([*copies, (1, 99, 0, 0.95, "other things there"), (1, 100, 0, 0.5, "far off")], "qid long, doc_id long, chunk_no int, score double, text string")
    got = {r.doc_id for r in rank.mmr(rows.withColumn("tokens", rank.token_hashes(F.col("text")))).collect()}
    assert 99 in got and 100 not in got and len(got) == 8


def test_reciprocal_rank_has_no_cutoff(spark):
    words = ["aaa", "bbb", "ccc", "ddd"]
    # the same four terms in fifteen chunks: ties go to the smaller id, so chunk k has rank k + 1
    parts = spark.createDataFrame([(i, 0, " ".join(words)) for i in range(15)] + [(100 + i, 0, f"x{i}xx y{i}yy") for i in range(60)], "doc_id long, chunk_no int, text string")
    m = queries._ranker_metrics(spark, parts, index.bm25).first()
    assert m.n_queries == 15 and math.isclose(m.mrr, sum(1 / k for k in range(1, 16)) / 15, abs_tol=1e-6) and math.isclose(m.recall_at_10, 10 / 15, abs_tol=1e-6)


def test_dense_scores_of_every_query(spark):
    rng = random.Random(5)
    vectors = {i: [rng.uniform(-1, 1) for _ in range(4)] for i in range(30)}
    e = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<double>")
    got = {(r.q_id, r.vec_id): r.score for r in rank.dense_scores(e, e.filter("vec_id % 10 = 0")).collect()}
    assert set(got) == {(q, v) for q in (0, 10, 20) for v in vectors if v != q}
    assert all(math.isclose(x, sum(a * b for a, b in zip(vectors[q], vectors[v], strict=True)), abs_tol=1e-9) for (q, v), x in got.items())


def test_every_benchmark_item_has_a_query_vector(spark):
    sf = "/root/testdata/sf0.001"
    items = [r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert sorted(r.qid for r in queries._query_vectors(spark, sf).collect()) == sorted(items)
    ids = [r.vec_id for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert {r.q_id for r in queries.dense_topk(spark, sf).collect()} == {i for i in ids if i % 100 == 0}


def test_whole_turns_enter_the_document(spark, tmp_path):
    late = "word " * 20 + "the last words"
    rows = [(1, 0, "system", late), (1, 1, "user", late), (1, 2, "assistant", "answer")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    text = queries._markdown(spark, str(tmp_path)).first().text
    assert text.count(late) == 2 and "\n### word" in text and "\n## Part 1: word" in text
    assert queries.doc_structure(spark, str(tmp_path)).first().output_chars == len(text)


# assembled documents


def test_first_of_each_key_in_order(spark):
    rng = random.Random(6)
    for _ in range(5):
        x = [rng.choice(["a", "A", "b", "", "c c"]) for _ in range(rng.randint(0, 12))]
        array = F.array(*[lit(v) for v in x]) if x else F.expr("cast(array() AS array<string>)")
        seen = {}
        for v in x:
            seen.setdefault(v.lower(), v)
        assert one(spark, T.kept_first(array, F.lower)) == list(seen.values())


def test_fragments_state_something(spark):
    long = "The cooling plant runs in two zones of the site"
    text = f"{long}. Is the cooling plant running in two zones now?\n {long}; Anna Berg discussed the plan with all of the teams\n[Slide 3] score=0.5 Title: {long.lower()}!\nshort"
    found = one(spark, T.fragments(lit(text)))
    assert found == [f"{long}.", long, f"{long.lower()}!"]
    assert one(spark, T.distinct_fragments(F.array(*[lit(x) for x in found]))) == [f"{long}."]
    assert one(spark, T.prose(F.array(*[lit(x) for x in "abcde"]), 4)) == ["a b", "c d"] and one(spark, T.prose(F.expr("cast(array() AS array<string>)"), 4)) == []


@pytest.mark.parametrize(
    ("candidates", "title"),
    [(["Please generate a report", "deck_cooling plant.pptx"], "Deck cooling plant — Technical Documentation"), (["slides 3 - 9 ppt", "x"], "Technical Reference Documentation"), (["operator handbook"], "Operator handbook")],
)
def test_document_titles(spark, candidates, title):
    assert one(spark, T.document_title(F.array(*[lit(c) for c in candidates]))) == title


def test_tables_of_markdown(spark):
    cells = [["", "Owner", "Cost|EUR"], ["pump **a**", "x", "10"], ["", "y", " "], ["b", "z", "Anna discussed it"]]
    table = F.array(*[F.array(*[lit(c) for c in r]) for r in cells])
    assert one(spark, compose.table_lines(table)) == ["| # | Cost/EUR |", "| --- | --- |", "| pump a | 10 |"]
    assert one(spark, compose.table_lines(F.array(F.array(lit("Owner"), lit("Notes")), F.array(lit("x"), lit("w" * 50 + " " + "v" * 50))))) == ["| Owner | Notes |", "| --- | --- |", f"| x | {'w' * 50}… |"]
    assert one(spark, compose.table_lines(F.array(F.array(lit("a"), lit("b"))))) == []


def test_assembled_document(spark):
    slides = [
        (1, 0, "2) Run tests", ["check the result of each run here"], [], ["p1"]), (1, 1, None, ["more about the result"], [[["Item", "Owner", "Cost"], ["a", "x", "1"]]], []),
        (1, 2, "1. Install", ["setup of the environment takes a day"], [], []), (1, 3, "Empty", [], [], []), (2, 0, "Other", ["nothing of note"], [], []),
    ]
    df = spark.createDataFrame(slides, "deck long, slide_no long, title string, lines array<string>, tables array<array<array<string>>>, images array<string>")
    topics = structure.merge_topics(df)
    assert {(r.deck, r.title) for r in topics.collect()} == {(1, "2) Run tests"), (1, "1. Install"), (2, "Other")}
    asked = []

    def generate(payloads):
        asked.append(sorted((r.deck, r.topic_no) for r in payloads.collect()))
        return payloads.filter("deck = 1 AND topic_no = 1").select("deck", "topic_no", F.lit("Told by a model.").alias("body"))

    titles = spark.createDataFrame([(1, "Plant"), (2, "Rest")], "deck long, title string")
    text = {r.deck: r.text for r in compose.assemble(topics, titles, generate).collect()}
    assert asked[0] == [(1, 1), (1, 2), (2, 1)] and asked[1] == [(1, 2), (2, 1)]
    one_, lines = text[1], text[1].split("\n")
    assert lines[0] == "# Plant" and "Told by a model." in one_ and "This topic documents Other" not in one_
    assert [x for x in lines if x.startswith("### Step")] == ["### Step 1: Install", "### Step 2: Run tests"]
    assert [x for x in lines if x.startswith("## Part")] == ["## Part 1: Installation", "## Part 2: Evaluation"]
    assert lines.count("[[IMAGE:p1]]") == 2 and "| Item | Cost |" in lines and one_.index("## Part 1") < one_.index("## Part 2") < one_.index("## Publication Readiness")
    assert "## Steps to Follow" not in text[2] and not one(spark, rules.violates_contract(lit(one_), lit("comprehensive"), lit(True)))


def test_narratives_by_the_titles_length(spark):
    lines = [f"a fact of at least twenty-five characters, number {k}" for k in range(16)] + ["short"]
    text = one(spark, compose.narrative(lit("abc"), F.array(*[lit(x) for x in lines]), lit(1), lit(0)))
    paragraphs = text.split("\n\n")
    assert len(paragraphs) == 4 and paragraphs[0].startswith("This section sets out abc. a fact") and paragraphs[0].count("number") == 3 and paragraphs[1].count("number") == 5 and paragraphs[2].count("number") == 6
    bare = one(spark, compose.narrative(lit("abcd"), F.expr("cast(array() AS array<string>)"), lit(0), lit(2)))
    assert bare == f"The following material covers abcd. {C.TEMPLATES['visual_only'][1]}\n\nThe figure depicts abcd."


def test_fallback_document_and_augmentation(spark):
    rows = [(1, k, f"The risk of delay number {k} is known to the whole project group. The mitigation {k} is planned for the autumn of the year.", 1.0 / k, k) for k in range(1, 12)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_no int, text string, score double, rank int")
    text = compose.fallback_document(chunks.withColumn("qid", lit(1)), "Plan").first().text
    assert text.startswith("# Plan\n\n## Objective\nPlan\n\n## Executive Overview") and text.count("\n## ") == 11 and text.endswith(C.TEMPLATES["closing"][-1])
    assert one(spark, compose.augmented(lit("# T\nshort "), lit("# A\nbody"))) == "# T\nshort\n\n## Expanded Supporting Detail\n\nbody" and one(spark, compose.augmented(lit("x" * 20), lit("y"), 10)) == "x" * 20


def test_images_at_tokens_and_in_the_appendix(spark):
    docs = spark.createDataFrame([(1, "a [[IMAGE: p1 ]] b [[IMAGE:gone]]"), (2, "no image")], "doc_id long, text string")
    images = spark.createDataFrame([(1, 0, "p1", "YWI="), (1, 1, "p2", "data:image/png;base64,Y2Q="), (1, 2, "p3", "**"), *[(2, k, f"q{k:02}", "YWI=") for k in range(30)]], "doc_id long, pos int, name string, content string")
    got = [(r.doc_id, r.place, r.name, bytes(r.content)) for r in compose.placed_images(docs, images).collect()]
    assert (1, "inline", "p1", b"ab") in got and (1, "appendix", "p2", b"cd") in got and sum(d == 2 for d, *_ in got) == 24 and len(got) == 26


def test_routes_and_retrieval_text(spark):
    df = spark.createDataFrame([(1, "summary", 9), (2, "full_deck", 1), (3, "other", 2)], "request_id int, detail string, max_docs int")
    assert {r.request_id: (r.route, r.max_docs, r.top_k) for r in compose.routed(df).collect()} == {1: ("fast_summary", 5, 8), 2: ("full_deck", 4, 8), 3: ("dossier", 16, 48)}
    made = compose.retrieval_query(lit(" a "), lit(""), lit("c"), F.array(lit("d "), lit(" ")), lit(None).cast("array<string>"), lit("x" * 900))
    assert one(spark, made) == "a\nc\nd\n" + "x" * 800
    assert one(spark, compose.ordered_distinct(F.array(lit("b"), lit("a"), lit("b")))) == ["b", "a"] and one(spark, T.setting_list(lit(" a, ,b "))) == ["a", "b"]


def test_vocabularies_beyond_the_limit_are_joined(spark, monkeypatch):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "epsi"]
    parts = spark.createDataFrame([(i, 0, " ".join(rng.choice(words) for _ in range(rng.randint(1, 9)))) for i in range(30)], "doc_id long, chunk_no int, text string")
    q = spark.createDataFrame([(1, "alpha beta"), (2, "epsi gamma unknown")], "qid long, query string")
    scores = lambda f: {(r.qid, r.doc_id): round(r.score, 9) for r in f(parts, q).collect()}
    direct = [scores(f) for f in (index.bm25, index.legacy_rank)]
    monkeypatch.setattr(index, "VOCABULARY", 2)
    assert [scores(f) for f in (index.bm25, index.legacy_rank)] == direct and len(direct[0]) > 20
