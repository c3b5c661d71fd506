"""The engine's own queries by name, over the standard tables. Inputs that no table holds (run records, cases, images,
files) are derived from their rows by arithmetic."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions import rules, text as T
from sparkloom.operators import compose, dense_fusion, files, gates, index, ireval, known_items, kpi, rank, structure
from sparkloom.operators.selection import nearest_rank, positions
from sparkloom.sources.lexicon import Lexicon
from sparkloom.sources.store import scratch
from sparkloom.sources.workspace import cached_results, html_text
from sparkloom.streaming import jobs, limiter, records, rollups

HINTS = ["the", "thand", "ing"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(s, d):
    return table(s, d, "documents")


def _chunks(s, d):
    return index.chunks(_docs(s, d).select("doc_id", "text"))


def _lexicon(s, d):
    """The persisted index of the documents; only files that it does not know are read."""
    return Lexicon.of(s, f"{d}/documents.parquet")


def _queries(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


# text ---------------------------------------------------------------------------------------------------------------


def tokenize_stats(s, d):
    return _docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).alias("n_tokens"), F.size(T.token_set(F.col("text"))).alias("n_distinct"))


def chunk_windows(s, d):
    return _chunks(s, d).select("doc_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def chunk_paragraphs(s, d):
    whole = table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
    packed = whole.select("conv_id", F.posexplode(T.pack_paragraphs(F.col("text"), C.DEFAULT.ranking.chunk_chars, C.DEFAULT.ranking.overlap_chars)).alias("chunk_no", "text"))
    return packed.select("conv_id", "chunk_no", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def line_dedup(s, d):
    return structure.distinct_lines(_docs(s, d)).select("doc_id", "n_lines", "kept_lines", F.md5("text").alias("digest"))


def noise_filter(s, d):
    found = structure.lines(_docs(s, d))
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_lines"), F.count_if(rules.is_noise(F.col("line"))).alias("n_noise"))


def postprocess_lines(s, d):
    return structure.postprocess(_docs(s, d)).select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


def title_normalise(s, d):
    named = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Deck: Topic: "), "text", F.lit(" -"))).when(F.col("turn") % 3 == 1, F.concat(F.lit("The 2 nd "), "text", F.lit(":"))).otherwise(F.concat(F.lit("Topic: ab"), F.lit("")))
    return table(s, d, "conversations").select("conv_id", "turn", T.slide_title(named).alias("title"), T.heading_key(named).alias("heading"), T.caption_subject(named).alias("subject"))


def clean_lines(s, d):
    return _docs(s, d).filter("text IS NOT NULL").select("doc_id", structure.clean_text(F.col("text")).alias("c")).select("doc_id", F.length("c").alias("n_chars"), F.md5("c").alias("digest"))


def heading_lines(s, d):
    labelled = structure.lines(_docs(s, d)).withColumn("line", F.when(F.col("pos") % 5 == 0, F.concat(F.regexp_extract("line", r"^\S+(\s+\S+){0,3}", 0), F.lit(":"))).otherwise(F.col("line")))
    return labelled.groupBy("doc_id").agg(F.count_if(T.looks_like_heading(F.col("line"))).alias("n_headings"))


def fragment_blocks(s, d):
    """Fragments of each document, distinct ones, and the paragraphs that the first eighteen make."""
    found = _docs(s, d).filter("text IS NOT NULL").select("doc_id", T.fragments(F.col("text")).alias("f"))
    own = found.select("doc_id", "f", T.distinct_fragments(F.col("f")).alias("g")).select("doc_id", "f", "g", T.prose(F.col("g"), 18).alias("p"))
    return own.select("doc_id", F.size("f").alias("n_fragments"), F.size("g").alias("n_distinct"), F.size("p").alias("n_paragraphs"), F.md5(F.array_join("p", "\n")).alias("digest"))


def markup(s, d):
    marked = F.concat(F.lit("**"), F.element_at(F.split("text", " "), 1), F.lit("** & *x* "), F.col("text"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("png", ".JPG", "gif", "tiff", "bin")]), (F.pmod("turn", F.lit(5)) + 1).cast("int"))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(T.emphasis_tags(marked)).alias("digest"), T.mime_type(suffix).alias("mime"))


def prompt_checks(s, d):
    """Which prompts are generic and which titles are instructions."""
    prompt = F.when(F.col("turn") % 4 == 0, F.lit("Generate document report")).otherwise(F.col("text"))
    title = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Please summarise "), "text")).when(F.col("turn") % 3 == 1, F.lit("2024 - 7")).otherwise(F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", rules.is_generic_prompt(prompt).alias("generic"), T.is_instruction(title).alias("instruction"))


def document_titles(s, d):
    """Each conversation's title, of all lines of its turns."""
    named = lambda x: F.when(F.col("turn") % 4 == 0, F.concat(F.lit("Please generate slides 3 - 9 of "), x)).when(F.col("turn") % 4 == 1, F.concat(F.lit("deck_file "), x, F.lit(" guide."))).otherwise(x)
    listed = table(s, d, "conversations").groupBy("conv_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("turn", F.transform(F.split("text", "\n"), named).alias("t")))), lambda x: x["t"])).alias("c"))
    return listed.select("conv_id", T.document_title(F.col("c")).alias("title"))


def html_extract(s, d):
    text = table(s, d, "pages").select("page_id", html_text(F.col("html")).alias("t"))
    return text.select("page_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def cache_keys(s, d):
    return _docs(s, d).select("doc_id", T.cache_key(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))).alias("key"))


# ranking ------------------------------------------------------------------------------------------------------------


def bm25_idf(s, d):
    lexicon = _lexicon(s, d)
    return index.idf_of(lexicon.terms, lexicon.n_chunks).select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_topk(s, d):
    top = index.bm25_top(_lexicon(s, d), _queries(s, d), 10)
    return top.select("qid", "rank", "doc_id", "chunk_no", F.round("score", 6).alias("score"))


def legacy_ranker_topk(s, d):
    lexicon, asked = _lexicon(s, d), _queries(s, d)
    top = index.with_unmatched(index.legacy_top(lexicon, asked, 10), lexicon.chunks, asked, 10)
    return top.select("qid", "rank", "doc_id", "chunk_no", F.round("score", 6).alias("score"))


def _every_hundredth(s, d):
    e = table(s, d, "embeddings")
    return e, e.filter("vec_id % 100 = 0").select("vec_id", "embedding")


def dense_topk(s, d):
    return rank.dense_top(*_every_hundredth(s, d), 10).select("q_id", "rank", "vec_id", F.round("score", 6).alias("score"))


def _fused(s, d):
    """Every vector whose id is divisible by 100 is a channel over all vectors."""
    return dense_fusion.dense_rrf(*_every_hundredth(s, d))


def rrf_fusion(s, d):
    return _fused(s, d).select("doc_id", F.round("score", 9).alias("score"))


def hint_boost(s, d):
    hits = _docs(s, d).select("doc_id", rank.hint_hits(F.col("text"), HINTS).alias("hits"))
    return rank.boosted(scratch(_fused(s, d)).join(hits, "doc_id"), "hits").select("doc_id", "score")


def _top_texts(s, d, queries, k):
    lexicon = _lexicon(s, d)
    return index.with_texts(lexicon, index.bm25_top(lexicon, queries, k))


def context_budget(s, d):
    return rank.budget(_top_texts(s, d, _queries(s, d), 10), 4000).select("qid", "rank", "doc_id", "chunk_no", F.length("text").alias("n_chars"))


def source_order(s, d):
    """The sources of each query's ten best chunks, in the order of their best ranks."""
    top = index.held(index.bm25_top(_lexicon(s, d), _queries(s, d), 10)).join(_docs(s, d).select("doc_id", "source"), "doc_id")
    return compose.distinct_sources(top).select("qid", F.array_join("sources", ",").alias("sources"))


def mmr_select(s, d):
    """MMR over BM25 scores as shares of the best of their query, to nine places. Only what its bound leaves gets its terms."""
    cfg, lexicon = C.DEFAULT.ranking, _lexicon(s, d)
    near = index.bm25_near(lexicon, _queries(s, d), cfg.top_k, (1 - cfg.mmr_lambda) / cfg.mmr_lambda + 1e-6)
    able = scratch(near.select("qid", "doc_id", "chunk_no", F.round(F.col("score") / F.col("best"), 9).alias("score")))
    sets = lexicon.postings.join(index.held(able.select("doc_id", "chunk_no").distinct()), ["doc_id", "chunk_no"], "left_semi").groupBy("doc_id", "chunk_no").agg(F.collect_list(F.xxhash64("term")).alias("tokens"))
    return rank.mmr(able.join(sets, ["doc_id", "chunk_no"])).select("qid", "rank", "doc_id", "chunk_no", F.round("score", 6).alias("score"))


def _query_vectors(s, d):
    """qid, vec_id: the query vector of a benchmark item, by its place among the items; vectors are taken in turn."""
    e, q = table(s, d, "embeddings").select("vec_id"), _queries(s, d).select("qid")
    n = e.count()
    place = positions(q, [], [F.col("qid")]).select("qid", F.pmod(F.col("rank") - 1, F.lit(max(n, 1))).alias("place"))
    return place.join(positions(e, [], [F.col("vec_id")]).select("vec_id", (F.col("rank") - 1).alias("place")), "place").select("qid", "vec_id")


def hybrid_context(s, d):
    found = rank.hybrid(_lexicon(s, d), _queries(s, d), table(s, d, "embeddings"), scratch(_query_vectors(s, d)), hints=HINTS)
    return found.select("qid", "rank", "doc_id", "chunk_no", F.round("score", 6).alias("score"), F.length("text").alias("n_chars"))


# evaluation ---------------------------------------------------------------------------------------------------------


def known_item_queries(s, d):
    lexicon = _lexicon(s, d)
    return ireval.known_item_queries(lexicon.postings, s.range(1).select(F.lit(lexicon.n_chunks).alias("n_chunks")))


def _benchmark_chunks(s, d):
    return table(s, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(0).alias("chunk_no"), "text")


def _ranker_metrics(s, parts, ranker):
    """Metrics of the whole rankings of known-item queries, one a chunk: its own rank counts wherever it is."""
    named = parts.select((F.col("doc_id") * F.lit(1 << 20) + F.col("chunk_no")).alias("doc_id"), F.lit(0).alias("chunk_no"), "text")
    known = ireval.known_item_queries(index.postings(named), named.agg(F.count(F.lit(1)).alias("n_chunks"))).select(F.col("doc_id").alias("qid"), "query", F.col("doc_id").alias("relevant_id"))
    m = ireval.metrics(ireval.relevant_ranks(index.ranked(ranker(named, known.select("qid", "query"))), known.select("qid", "relevant_id")))
    return m.select("n_queries", *(F.round(c, 6).alias(c) for c in m.columns if c != "n_queries"))


def _compared(s, parts):
    new, old = _ranker_metrics(s, parts, index.bm25), _ranker_metrics(s, parts, index.legacy_rank)
    return new.select(F.lit("bm25").alias("ranker"), "*").unionByName(old.select(F.lit("legacy").alias("ranker"), "*"))


def ir_metrics(s, d):
    return _ranker_metrics(s, _benchmark_chunks(s, d), index.bm25)


def ranker_comparison(s, d):
    return _compared(s, _benchmark_chunks(s, d))


def chunk_ranker_comparison(s, d):
    """The same over the documents' chunks, by counts over the index."""
    ranks = known_items.known_item_ranks(_lexicon(s, d))
    found = [ireval.metrics(ranks.select("qid", F.col(r).alias("rank"))).select(F.lit(r).alias("ranker"), "*") for r in ("bm25", "legacy")]
    both = found[0].unionByName(found[1])
    return both.select("ranker", "n_queries", *(F.round(c, 6).alias(c) for c in both.columns if c not in ("ranker", "n_queries")))


#: The cases of the golden set: a conversation each, with all words of its user to be included.
CASE_FIELDS = """concat('c', conv_id) AS case_id, CAST(NULL AS INT) AS none, conv_id % 10 = 0 AS requires_ordered_steps, conv_id % 12 = 0 AS requires_table, conv_id % 11 = 0 AS expects_refusal,
    conv_id % 3 <> 0 AS gated, conv_id % 13 <> 0 AS ok, CAST(conv_id * 37 % 1000 AS INT) AS latency_ms, CASE WHEN conv_id % 2 = 0 THEN 5 END AS min_words, CASE WHEN conv_id % 3 = 0 THEN 400 END AS max_words,
    concat(CASE WHEN conv_id % 5 = 0 THEN '1. ' ELSE '' END, said, CASE WHEN conv_id % 6 = 0 THEN concat(chr(10), '| a | b |') ELSE '' END, CASE WHEN conv_id % 22 = 0 THEN ' This is not stated in the source.' ELSE '' END) AS output"""


def _scored_cases(s, d):
    texts = lambda role, sep: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda x: x["text"]), sep)
    conv = table(s, d, "conversations").groupBy("conv_id").agg(texts("assistant", "\n").alias("said"), texts("user", " ").alias("asked"))
    words = F.split("asked", " ")
    none = F.expr("cast(array() AS array<string>)")
    return gates.score_cases(
        conv.selectExpr("conv_id", "asked", *_fields(CASE_FIELDS)).withColumns({
            "must_include": words, "must_not_include": F.array(F.lit("Slide"), F.lit("ing")), "required_sections": F.when(F.col("conv_id") % 4 == 0, F.array(F.lit("the"))).otherwise(none),
        })
    )


def _fields(listed: str) -> list[str]:
    """The expressions of a select list."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(listed):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(listed[start:i].strip())
            start = i + 1
    return [*out, listed[start:].strip()]


def golden_score(s, d):
    return _scored_cases(s, d).select("case_id", F.round("must_include_coverage", 6).alias("must_include_coverage"), "forbidden_term_clean", "structure_compliant", "length_compliant", "refusal_correct", "word_count")


def eval_summary(s, d):
    return gates.summarise(_scored_cases(s, d))


def gate_checks(s, d):
    return gates.check_gates(eval_summary(s, d)).select("metric", "bound", "limit", "actual", "status")


def baseline_diff(s, d):
    now = eval_summary(s, d)
    was = now.withColumns({"avg_must_include_coverage": F.lit(1.0), "structure_compliance_rate": F.lit(0.7), "p95_latency_ms": F.lit(150.0)})
    found = gates.compare_baseline(now, was)
    return found.select("metric", "baseline", "current", F.round("movement", 6).alias("movement"), "status")


def metric_pairs(s, d):
    """Which evaluated cases are gated and which advisory: semi and anti joins on the case list."""
    ids = _scored_cases(s, d).filter("gated").select("case_id")
    every = _scored_cases(s, d).select("case_id", "latency_ms")
    semi = every.join(ids, "case_id", "left_semi").select(F.lit("gated").alias("kind"), "case_id", "latency_ms")
    return semi.unionByName(every.join(ids, "case_id", "left_anti").select(F.lit("advisory").alias("kind"), "case_id", "latency_ms"))


def mock_drafts(s, d):
    """What the evaluation's mock mode answers: drafts that restate their source."""
    instructions = F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("Keep it short"), F.lit("Name the owner")))
    rows = table(s, d, "conversations").select("conv_id", "turn", gates.deterministic_draft(F.lit("Summarise the notes."), F.coalesce("text", F.lit("")), instructions).alias("t"))
    return rows.select("conv_id", "turn", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


# rules --------------------------------------------------------------------------------------------------------------


def policy_flags(s, d):
    return _docs(s, d).select("doc_id", F.array_join(rules.policy_flags(F.col("text")), ",").alias("flags"))


def leak_probes(s, d):
    return _docs(s, d).select("doc_id", *(c.alias(k) for k, c in rules.leak_counts(F.col("text")).items()))


def _markdown(s, d):
    """One Markdown document per conversation: a title, a part per system turn, a topic per user turn, tables and figures.

    The first words of a system or user turn are its heading, its whole text stands below."""
    heading, rest = T.squeeze(F.substring("text", 1, 60)), F.concat(F.lit("\n"), F.col("text"))
    line = (
        F.when(F.col("role") == "system", F.concat(F.lit("## Part 1: "), heading, rest))
        .when(F.col("role") == "user", F.concat(F.when(F.col("turn") % 3 == 0, F.lit("### Step 1: ")).otherwise("### "), heading, rest, F.lit("\n| a | b |\n| --- | --- |\n| 1 | 2 |\n[[IMAGE: slide 4]]")))
        .otherwise(F.col("text"))
    )
    rows = table(s, d, "conversations").select("conv_id", "turn", line.alias("line"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("conv_id").agg(joined.alias("text")).select("conv_id", F.concat(F.lit("# Notes\n"), "text").alias("text"))


def doc_structure(s, d):
    return _markdown(s, d).select("conv_id", *(c.alias(k) for k, c in rules.structure(F.col("text")).items()))


def contract_check(s, d):
    levels = F.element_at(F.array(F.lit("summary"), F.lit("comprehensive"), F.lit("dossier")), (F.pmod("conv_id", F.lit(3)) + 1).cast("int"))
    return _markdown(s, d).select("conv_id", levels.alias("detail"), rules.violates_contract(F.col("text"), levels, F.pmod("conv_id", F.lit(2)) == 0).alias("violates"))


def llm_authorship(s, d):
    opened = F.when(F.pmod("conv_id", F.lit(4)) == 0, F.concat("text", F.lit("\n"), F.lit(C.OPENERS[0]))).otherwise(F.col("text"))
    topics = F.greatest(F.regexp_count(opened, F.lit(r"(?m)^###\s+")), F.lit(0))
    n, rate = rules.llm_authorship(opened, topics)
    return _markdown(s, d).select("conv_id", topics.alias("topics"), n.alias("llm_topics"), F.round(rate, 6).alias("coverage"))


def accepted_documents(s, d):
    """Documents without a disallowed term; every thirteenth is given one."""
    marked = _docs(s, d).select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit(f" {C.DISALLOWED_TERMS[1].upper()}"))).otherwise(F.col("text")).alias("text"))
    return rules.accepted(marked).select("doc_id", F.length(rules.limited(F.col("text"), 500)).alias("n_chars"))


def workflow_topics(s, d):
    title = F.when(F.col("conv_id") % 3 == 0, F.lit("Portal setup request")).when(F.col("conv_id") % 3 == 1, F.lit("Ticket"))
    return table(s, d, "conversations").select("conv_id", "turn", rules.is_workflow_topic(title, F.split("text", "\n")).alias("workflow"))


def ingress_checks(s, d):
    e = table(s, d, "events")
    declared = F.when(F.col("event_id") % 7 == 0, F.lit("many")).otherwise(F.col("event_id").cast("string"))
    user = F.when(F.col("user_id") % 5 == 0, F.lit("  ")).otherwise(F.col("user_id").cast("string"))
    return e.select("event_id", rules.client_key(user, F.lit("10.0.0.1")).alias("key"), rules.oversize_bytes(declared, 500).alias("oversize"))


def _artifacts(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("artifact_id"), F.concat(F.lit("u"), F.pmod("user_id", F.lit(40))).alias("owner"), F.pmod(F.col("event_id") * 31, F.lit(997)).alias("size"))


def artifact_authz(s, d):
    """What an editor and an administrator may read: a filter by one principal at a time."""
    see = lambda user, role: _artifacts(s, d).filter(rules.may_read(F.col("owner"), F.lit(user), F.lit(role))).select(F.lit(user).alias("user"), "artifact_id", "size")
    return see("u3", "editor").unionByName(see("root", "admin"))


def artifact_view(s, d):
    """The same through a view over the session's reader."""
    rules.readable_view(_artifacts(s, d), "readable_artifacts")
    see = lambda user, role: scratch(rules.readable_by(s, "readable_artifacts", user, role).select(F.lit(user).alias("user"), "artifact_id", "size"))
    return see("u3", "editor").unionByName(see("root", "admin"))


def label_quality_vs_flags(s, d):
    flagged = _docs(s, d).select("doc_id", (F.size(rules.policy_flags(F.col("text"))) > 0).alias("flagged"))
    return table(s, d, "labels").join(flagged, "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.count_if("flagged").alias("n_flagged"))


# run records --------------------------------------------------------------------------------------------------------


def _run_fields() -> str:
    """Fields of run records from events, in SQL that Spark and DuckDB share."""
    own = [f for fields in C.KPI_MEANS.values() for f in fields.values() if f != "topics"]
    return ", ".join(f"(event_id * {2 * i + 3} % {89 + i}) / CAST({i + 7} AS DOUBLE) AS {f}" for i, f in enumerate(own))


def _runs(s, d):
    return table(s, d, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("recorded_at"), (F.col("event_type") != "error").alias("succeeded"), (F.col("event_type") == "click").alias("used_fallback"),
        F.pmod("user_id", F.lit(5)).cast("int").alias("topics"), F.pmod("user_id", F.lit(2)).cast("int").alias("llm_topics"), F.col("value").alias("total_latency_ms"), F.from_json("props", "map<string, int>").alias("leaks"),
        (F.pmod("event_id", F.lit(9)) != 0).alias("content_integrity_pass"), F.pmod("event_id", F.lit(13)).alias("slides_ingested"), F.col("event_type").alias("route"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(3))).alias("mode"),
        *(F.expr(x) for x in _fields(_run_fields())),
    )


def kpi_snapshot(s, d):
    return kpi.snapshot(_runs(s, d))


def latency_percentiles(s, d):
    return nearest_rank(_runs(s, d), "total_latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, ["route"])


def cost_rollup(s, d):
    priced = _runs(s, d).select("route", "mode", F.col("slides_ingested").alias("tokens"), kpi.cost(F.col("slides_ingested"), F.col("topics"), 0.5, 1.5).alias("cost_usd"))
    return kpi.cost_rollup(priced).select("route", "mode", "runs", "tokens", F.round("total_cost", 9).alias("total_cost"), F.round("avg_cost", 9).alias("avg_cost"))


def exposition(s, d):
    return kpi.exposition(kpi_snapshot(s, d)).select("name", "line")


def last_n_runs(s, d):
    return kpi.last_runs(_runs(s, d)).select("seq", "recorded_at", "succeeded")


def latest_job_status(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_type").alias("status"), F.col("ts").alias("updated_at"), F.col("event_id").alias("seq"))
    return kpi.latest_status(e)


def job_outcomes(s, d):
    """Users' events as updates of jobs: how each job stands after the rules of its states."""
    status = F.element_at(F.create_map(*[F.lit(x) for p in zip(("signup", "click", "view", "purchase", "error"), ("queued", "running", "running", "completed", "failed"), strict=True) for x in p]), F.col("event_type"))
    e = table(s, d, "events").select(F.col("user_id").alias("job_id"), status.alias("status"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("e"), F.col("event_id")).alias("error"))
    return jobs.outcomes(e, 24 * 3600.0)


def run_windows(s, d):
    """Run records rolled up by day and route."""
    found = records.rollup(_runs(s, d), "1 day", "0 seconds")
    return found.select("window_start", "route", "runs", "succeeded", "success_rate", F.round("total_latency_ms", 4).alias("total_latency_ms"), "max_latency_ms")


def quality_proxies(s, d):
    r = _runs(s, d).withColumn("n_leaks", F.aggregate(F.map_values("leaks"), F.lit(0), lambda t, x: t + x))
    top, cover = F.pmod("seq", F.lit(11)) / F.lit(10.0), F.pmod("seq", F.lit(7)) / F.lit(5.0)
    p = kpi.quality_proxies(top, cover, F.col("n_leaks"), F.col("content_integrity_pass"), F.col("slides_ingested") * 100, F.col("topics"), F.col("llm_topics"), F.lit(40.0))
    return r.select("seq", *(c.alias(k) for k, c in p.items()))


def public_jobs(s, d):
    e = table(s, d, "events").select(F.col("event_id").alias("job_id"), F.col("user_id").alias("owner"), F.col("event_type").alias("status"), F.col("ts").alias("created_at"), F.col("ts").alias("updated_at"), F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"))
    return kpi.public_jobs(e)


def request_routes(s, d):
    levels = F.element_at(F.array(*[F.lit(p[0]) for p in C.PROFILES], F.lit("other")), (F.pmod("event_id", F.lit(6)) + 1).cast("int"))
    return compose.routed(table(s, d, "events").select(F.col("event_id").alias("request_id"), levels.alias("detail"), F.pmod("user_id", F.lit(20)).cast("int").alias("max_docs")))


def result_cache(s, d):
    """Requests with what a cache holds for them; blank results are none."""
    docs = _docs(s, d)
    cache = docs.filter("doc_id % 3 = 0").select(F.md5("text").alias("key"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("r"), F.length("text"))).otherwise(F.lit("  ")).alias("result")).distinct()
    return cached_results(docs.select("doc_id", F.md5("text").alias("key")), cache).select("doc_id", "result")


def triage_delta(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("category"), (F.col("value") > 50).alias("include"), "event_id")
    half = e.agg((F.lit(0.5) * F.max("event_id")).alias("half"))
    return kpi.triage_delta(kpi.triage_tally(e.join(F.broadcast(half), F.col("event_id") <= F.col("half"))), kpi.triage_tally(e))


def rate_limit_decisions(s, d):
    hits = table(s, d, "events").select(F.concat(F.lit("user:"), F.col("user_id")).alias("key"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("ts"))
    return limiter.decide_batch(hits, C.Limits(requests_per_minute=1, burst=1, window_s=40_000.0)).select("key", "event_id", "allowed", "retry_after")


def event_windows(s, d):
    return rollups.tumbling(table(s, d, "events"), "1 day").select("window_start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(s, d):
    return rollups.sessions(table(s, d, "events"), "12 hours")


# structure ----------------------------------------------------------------------------------------------------------


def _slides(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("deck"), F.col("turn").alias("slide_no"), F.when(F.col("role") == "user", F.substring(F.element_at(F.split("text", " "), 1), 1, 4)).alias("title"), F.split("text", "\n").alias("lines"))


def topic_merge(s, d):
    return structure.merge_topics(_slides(s, d)).select("deck", "topic_no", "title", F.size("lines").alias("n_lines"), F.md5(F.array_join("lines", "\n")).alias("digest"))


#: Sections and parts in words that the synthetic texts have, as a deployment would give its own.
LOCAL_SECTIONS = {f"Section {k}": words for k, words in enumerate((("thand", "erst"), ("inth", "ouat"), ("hent", "anea"), ("ción", "dos"), ("ment", "aux"), ("ungs", "heit"), ("tion", "ered")))}
LOCAL_PARTS = {f"Part {k}": words for k, words in enumerate((("hea", "ered"), ("ouat", "inth"), ("arar", "ciones"), ("ment", "eux"), ("lich", "schu")))}


def part_classify(s, d):
    lines = F.split("text", "\n")
    title = F.substring(F.get(lines, F.lit(0)), 1, 40)
    return _docs(s, d).select("doc_id", structure.classify_part(title, lines).alias("part"), structure.classify_part(title, lines, LOCAL_PARTS).alias("local_part"))


def section_chunks(s, d):
    scored = _lexicon(s, d).chunks.withColumn("score", F.lit(1.0) / (1 + F.col("chunk_no")))
    return structure.section_chunks(scored, C.SECTIONS | LOCAL_SECTIONS).select("section", "rank", "doc_id", "chunk_no", "hits")


def procedure_steps(s, d):
    topics = _slides(s, d).select("deck", F.col("slide_no").alias("topic_no"), F.concat(F.col("slide_no") % 4, F.when(F.col("slide_no") % 2 == 0, ". ").otherwise(") "), F.coalesce("title", F.lit("-"))).alias("title"))
    return structure.procedure_steps(topics)


def _units(s, d):
    docs = _docs(s, d)
    sentences = docs.select(F.lit("sentence").alias("kind"), F.explode(F.split("text", r"[.!?]\s")).alias("unit"))
    return structure.lines(docs).select(F.lit("line").alias("kind"), F.col("line").alias("unit")).unionByName(sentences)


def repetition_report(s, d):
    return structure.repetition(_units(s, d))


def document_repetition(s, d):
    """Repeated paragraphs, headings, figures and sentences of each conversation's document."""
    return structure.document_repetition(_markdown(s, d).select(F.col("conv_id").alias("doc_id"), "text"))


def table_shapes(s, d):
    """Sizes of the tables of the conversations' decks."""
    return structure.table_shapes(_decks(s, d).select(F.explode("tables").alias("cells")))


def template_shapes(s, d):
    return structure.template_shapes(structure.lines(_docs(s, d)).select(F.col("line").alias("unit")))


def caption_alignment(s, d):
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "figure").otherwise("heading").alias("kind"), F.md5("text").alias("text"))
    return structure.heading_before(rows)


def misplaced_figures(s, d):
    """Assistant turns as figures under user turns as headings, with their texts as subjects."""
    rows = table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), F.when(F.col("role") == "assistant", "figure").otherwise("heading").alias("kind"), "text")
    return structure.misplaced_figures(rows).select("doc_id", "pos", F.md5(F.concat("heading", F.lit("\n"), "text")).alias("digest"))


def adjacent_status(s, d):
    line = F.when(F.col("event_id") % 4 < 3, F.concat(F.lit("Status as of the "), F.pmod("event_id", F.lit(3)) % 2 + 2, F.lit(" nd"))).otherwise(F.col("event_type"))
    return structure.adjacent_repeats(table(s, d, "events").select(F.lit(0).alias("none"), F.pmod("user_id", F.lit(500)).alias("doc_id"), F.col("event_id").alias("pos"), line.alias("line")))


def title_mode(s, d):
    return structure.title_mode(_slides(s, d))


def repeated_long_lines(s, d):
    return structure.repeated_lines(_docs(s, d)).select(F.md5("line").alias("digest"), "n")


def evidence_topn(s, d):
    scored = _docs(s, d).select("source", F.col("n_chars").alias("len"), "doc_id", "text").withColumn("score", F.col("len").cast("double")).withColumn("rank", F.col("doc_id"))
    found = files.evidence(scored.select("source", "score", "rank", "text"))
    return found.select("source_rank", "source", "nth", F.md5("preview").alias("digest"))


# files and images -----------------------------------------------------------------------------------------------------


def file_select(s, d):
    """Files named after the documents' source, language and id, for a prompt, with and without hints."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("md", "pptx", "pdf", "txt")]), (F.pmod("doc_id", F.lit(4)) + 1).cast("int"))
    rows = _docs(s, d).select(F.concat(F.lit("Docs/"), "source", F.lit("/"), "lang", F.lit("_note-"), F.col("doc_id").cast("string"), F.lit("."), suffix).alias("path"))
    prompt = "review the fr_note and 120 as pdf"
    free = files.select_files(rows, prompt, [], 6).select(F.lit("none").alias("hints"), "path", "score")
    return free.unionByName(files.select_files(rows, prompt, ["src1/en", "DE_note-33.PPTX "], 6).select(F.lit("two").alias("hints"), "path", "score"))


#: Features of images from events, in SQL that Spark and DuckDB share.
IMAGE_FIELDS = """event_id AS image_id, CAST(event_id * 7 % 1500 AS INT) AS width, CAST(event_id * 13 % 900 AS INT) AS height, CAST(event_id * 3 % 60 AS INT) AS colors, (event_id * 11 % 100) / CAST(1000 AS DOUBLE) AS detail,
    (event_id * 17 % 100) / CAST(100 AS DOUBLE) AS transparency, (event_id * 19 % 100) / CAST(250 AS DOUBLE) AS skin, CAST(event_id % 17 AS INT) AS variety"""


def _images(s, d):
    return table(s, d, "events").selectExpr(*_fields(IMAGE_FIELDS))


def image_triage(s, d):
    rows = _images(s, d)
    size = files.display_size(F.nullif(F.col("width"), F.lit(0)), F.nullif(F.col("height"), F.lit(0)))
    return rows.select("image_id", *(c.alias(k) for k, c in files.triage().items()), *(F.round(size[k], 4).alias(k) for k in ("width_pt", "height_pt")))


def image_relevance(s, d):
    judged = _images(s, d).select("image_id", "width", "height", "skin", *(c.alias(k) for k, c in files.triage().items()))
    return judged.select("image_id", rules.is_relevant_image(F.col("category"), F.col("include"), F.col("image_id") % 2 == 0, F.col("width") / F.greatest("height", F.lit(1)), F.col("skin")).alias("relevant"))


def triage_precision(s, d):
    return files.triage_precision(_images(s, d).select(files.triage()["include"].alias("include")))


def image_merge(s, d):
    """Pictures of two kinds of events: every name three times, some with a data URI's head."""
    e = table(s, d, "events")
    name, body = F.concat(F.lit("Img"), F.pmod("event_id", F.lit(7)), F.lit(".png")), F.base64(F.concat(F.lit("picture "), F.pmod("event_id", F.lit(14)).cast("string")).cast("binary"))
    a = e.filter("event_type = 'click'").select(F.col("event_id").alias("pos"), name.alias("name"), body.alias("content"))
    b = e.filter("event_type = 'view'").select(F.col("event_id").alias("pos"), F.lower(name).alias("name"), F.concat(F.lit("data:image/png;base64,"), body).alias("content"))
    return files.merge_images(a, b, 12)


def image_placement(s, d):
    """Images of the conversations' documents at their tokens, and the others in an appendix."""
    docs = _markdown(s, d).select(F.col("conv_id").alias("doc_id"), "text")
    picture = lambda k: F.base64(F.concat(F.lit(f"{k} "), F.col("doc_id").cast("string")).cast("binary"))
    listed = F.array(*[F.struct(F.lit(p).alias("pos"), F.lit(n).alias("name"), (picture(n) if ok else F.lit("not base64!")).alias("content")) for p, n, ok in ((0, "slide 4", True), (1, "plan", True), (2, "bad", False))])
    images = docs.select("doc_id", F.explode(listed).alias("i")).select("doc_id", "i.*")
    return compose.placed_images(docs, images).select("doc_id", "place", "pos", "name", F.md5("content").alias("digest"))


def table_rows(s, d):
    """Cells of Markdown tables made of the benchmark's words: dividers and empty rows out, one width, empty columns out."""
    w = F.split("text", " ")
    cell = lambda k: F.coalesce(F.get(w, F.lit(k)), F.lit(""))
    odd = F.when(F.col("item_id") % 2 == 1, cell(1)).otherwise("")
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    text = F.array(line(cell(0), odd, cell(2)), F.lit("| --- | :--: | --- |"), line(cell(3), F.lit("")), line(F.lit(""), F.lit(" "), F.lit("")), line(cell(4), F.lit(""), cell(5)))
    made = table(s, d, "benchmark").select(F.col("item_id").alias("table_id"), structure.compact_matrix(structure.rectangular(text)).alias("cells"))
    return made.select("table_id", F.posexplode("cells").alias("pos", "row")).select("table_id", "pos", F.array_join("row", "|").alias("cells"))


# assembled documents --------------------------------------------------------------------------------------------------


def topic_narratives(s, d):
    """What each document's lines say as one topic, stated without a model."""
    lines, title = F.filter(F.transform(F.split("text", "\n"), T.squeeze), lambda x: x != ""), F.element_at(F.split("text", " "), 1)
    made = _docs(s, d).filter("text IS NOT NULL").select("doc_id", compose.narrative(title, lines, F.pmod("doc_id", F.lit(2)), F.pmod("doc_id", F.lit(3))).alias("t"))
    return made.select("doc_id", F.length("t").alias("n_chars"), F.md5("t").alias("digest"))


def _decks(s, d):
    """Conversations as decks: a slide a turn, with a table in every third and a picture in every fourth."""
    first = F.array_join(F.slice(F.split("text", " "), 1, 4), " ")
    title = F.when(F.col("turn") % 5 == 1, F.concat(F.col("turn") + 1, F.lit(". "), first)).when(F.col("turn") % 5 < 4, first)
    cells = F.array(F.array(F.lit("Item"), F.lit("Owner"), F.lit("")), F.array(F.lit("a|b"), F.lit("x"), F.col("role")), F.array(F.lit(""), F.lit("y"), F.lit("")))
    return table(s, d, "conversations").select(
        F.col("conv_id").alias("deck"), F.col("turn").alias("slide_no"), title.alias("title"), F.split("text", "\n").alias("lines"),
        F.when(F.col("turn") % 3 == 0, F.array(cells)).otherwise(F.expr("cast(array() AS array<array<array<string>>>)")).alias("tables"),
        F.when(F.col("turn") % 4 == 0, F.array(F.concat(F.lit("slide"), F.col("turn")))).otherwise(F.expr("cast(array() AS array<string>)")).alias("images"),
    )


def deck_documents(s, d):
    """Whole documents, one a deck: merged topics in parts with narratives, steps, tables and figures."""
    topics = structure.merge_topics(_decks(s, d))
    titles = topics.groupBy("deck").agg(F.transform(F.sort_array(F.collect_list(F.struct("topic_no", "title"))), lambda x: x["title"]).alias("c")).select("deck", T.document_title(F.col("c")).alias("title"))
    made = compose.assemble(topics, titles, parts=LOCAL_PARTS)
    return made.select("deck", F.length("text").alias("n_chars"), F.regexp_count("text", F.lit(r"(?m)^### ")).alias("n_topics"), F.md5("text").alias("digest"))


def fallback_documents(s, d):
    """The documents that the ten best chunks of each benchmark item give without a model."""
    made = compose.fallback_document(_top_texts(s, d, _queries(s, d), 10), "Notes", sections=LOCAL_SECTIONS)
    return made.select("qid", F.length("text").alias("n_chars"), F.regexp_count("text", F.lit(r"(?m)^## ")).alias("n_sections"), F.md5("text").alias("digest"))


def retrieval_queries(s, d):
    made = compose.retrieval_query(F.lit(" plan "), F.col("role"), F.lit(""), F.array(F.lit("a "), F.lit(" ")), F.when(F.col("turn") % 2 == 0, F.array(F.lit("hint.md"))), F.col("text"))
    return table(s, d, "conversations").select("conv_id", "turn", F.md5(made).alias("digest"))


QUERIES = (
    hybrid_context, tokenize_stats, chunk_windows, chunk_paragraphs, line_dedup, noise_filter, clean_lines, heading_lines, fragment_blocks, markup, prompt_checks, document_titles, postprocess_lines, title_normalise,
    html_extract, cache_keys, bm25_idf, bm25_topk, legacy_ranker_topk, dense_topk, rrf_fusion, hint_boost, context_budget, source_order, mmr_select, known_item_queries, ir_metrics, ranker_comparison,
    chunk_ranker_comparison, golden_score, eval_summary, gate_checks, baseline_diff, metric_pairs, mock_drafts, policy_flags, leak_probes, doc_structure, contract_check, llm_authorship, accepted_documents, workflow_topics,
    ingress_checks, artifact_authz, artifact_view, label_quality_vs_flags, kpi_snapshot, latency_percentiles, cost_rollup, exposition, last_n_runs, latest_job_status, quality_proxies, job_outcomes, run_windows, public_jobs, request_routes, result_cache, triage_delta,
    rate_limit_decisions, event_windows, event_sessions, topic_merge, part_classify, section_chunks, procedure_steps, repetition_report, document_repetition, table_shapes, template_shapes, caption_alignment, misplaced_figures, adjacent_status, title_mode,
    repeated_long_lines, evidence_topn, file_select, image_triage, image_relevance, triage_precision, image_merge, image_placement, table_rows, topic_narratives, deck_documents, fallback_documents, retrieval_queries,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    from sparkloom.oracle import SQL

    return dict(SQL)
