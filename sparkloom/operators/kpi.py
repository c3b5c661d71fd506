"""Run records: rollups, percentiles, cost, proxies and exposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.config import DEFAULT, KPI_MEANS, PROXY
from sparkloom.operators.selection import nearest_rank


def ratio(n: Column, d: Column) -> Column:
    """To four places; 0 without a positive divisor."""
    return F.coalesce(F.bround(F.when(d > 0, n / d), 4), F.lit(0.0))


def last_runs(runs: DataFrame, n: int = DEFAULT.limits.retained_runs) -> DataFrame:
    """The latest runs of (recorded_at, seq): a top-n, not a sort of everything."""
    return runs.orderBy(F.desc("recorded_at"), F.desc("seq")).limit(n)


def snapshot(runs: DataFrame) -> DataFrame:
    """One row of all figures of the run records, named group_figure; zeros without runs. Means and latencies are those of
    successful runs, to four and two places; ``KPI_MEANS`` names the fields of the records."""
    n, good = F.count(F.lit(1)), F.col("succeeded")
    leaks = F.aggregate(F.map_values("leaks"), F.lit(0).cast("long"), lambda t, x: t + x)
    share = lambda c: ratio(F.count_if(c), n)
    mean = lambda c: F.coalesce(F.bround(F.avg(F.when(good, F.col(c).cast("double"))), 4), F.lit(0.0))
    totals = runs.agg(
        n.alias("runs_observed"),
        share(good).alias("availability_success_rate"),
        share(F.col("used_fallback")).alias("availability_fallback_rate"),
        share((F.col("topics") > 0) & (F.col("llm_topics") == 0)).alias("availability_degraded_generation_rate"),
        F.count_if(good).alias("availability_documents_delivered"),
        F.coalesce(F.bround(F.max(F.when(good, F.col("total_latency_ms"))), 2), F.lit(0.0)).alias("latency_ms_max"),
        F.coalesce(F.sum("slides_ingested"), F.lit(0)).alias("throughput_total_slides_ingested"),
        *(mean(field).alias(f"{group}_{name}") for group, fields in KPI_MEANS.items() for name, field in fields.items()),
        F.coalesce(F.sum(leaks), F.lit(0)).alias("content_integrity_total_leaks_detected"),
        share(F.col("content_integrity_pass")).alias("content_integrity_clean_document_rate"),
    )
    ranks = nearest_rank(runs.filter("succeeded"), "total_latency_ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    both = totals.join(F.broadcast(ranks), F.lit(True), "left")
    return both.select(*totals.columns, *(F.coalesce(F.bround(c, 2), F.lit(0.0)).alias(f"latency_ms_{c}") for c in ("p50", "p95", "p99")))


def cost(tokens_in: Column, tokens_out: Column, in_per_1k: float, out_per_1k: float) -> Column:
    return F.round(tokens_in / F.lit(1000.0) * F.lit(in_per_1k) + tokens_out / F.lit(1000.0) * F.lit(out_per_1k), 6)


def cost_rollup(runs: DataFrame) -> DataFrame:
    """route, mode, runs, tokens, total_cost, avg_cost of (route, mode, tokens, cost_usd) with subtotals."""
    return runs.rollup("route", "mode").agg(F.count(F.lit(1)).alias("runs"), F.sum("tokens").alias("tokens"), F.sum("cost_usd").alias("total_cost"), F.avg("cost_usd").alias("avg_cost"))


def clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def quality_proxies(top_score: Column, coverage: Column, leaks: Column, integrity: Column, chars: Column, topics: Column, llm_topics: Column, retrieval_ms: Column) -> dict[str, Column]:
    """Linear stand-ins for quality that a run's own record allows, under the names of the record's fields. They are not
    measurements; see ``ireval`` for those."""
    s, c, p = clamp(top_score), clamp(coverage), PROXY
    line = lambda name, x: clamp(p[name][0] + p[name][1] * x)
    base, by_score, by_coverage, by_integrity = p["grounded"]
    grounded = clamp(base + by_score * s + by_coverage * c + F.lit(by_integrity) * F.when(integrity, 1.0).otherwise(p["unclean"]))
    most, (least, per_char, per_topic, per_ms) = F.greatest(topics, llm_topics), p["tokens"]
    tokens = F.greatest(F.lit(least), (per_char * chars + per_topic * most + F.lit(per_ms) * F.greatest(retrieval_ms, F.lit(0.0))).cast("int"))
    found = {
        "groundedness_score": grounded,
        "hallucination_rate": clamp(1 - grounded + F.when(leaks > 0, p["leak_penalty"]).otherwise(0.0)),
        "retrieval_recall_at_5": line("recall_at_5", s),
        "retrieval_recall_at_10": line("recall_at_10", s),
        "mrr": line("mrr", s),
        "ndcg_at_10": line("ndcg_at_10", s),
        "coverage_score": line("coverage", c),
        "leakage_rate": clamp(leaks / F.greatest(F.lit(1), topics, llm_topics, F.floor(chars / p["chars_per_leak"]))),
        "schema_compliance_rate": F.when(integrity, 1.0).otherwise(p["broken_schema"]),
    }
    return {k: F.bround(x, 4) for k, x in found.items()} | {"tokens_used": tokens, "cost_usd": F.bround(tokens / F.lit(1000.0) * F.lit(p["usd_per_1k"]), 6)}


def exposition(summary: DataFrame, prefix: str = "docs") -> DataFrame:
    """name, line of the text exposition format: HELP, TYPE and value of every number; other types are left out."""
    numbers = [f.name for f in summary.schema.fields if f.dataType.typeName() in ("long", "integer", "double", "float")]
    listed = F.array(*[F.struct(F.lit(f"{prefix}_{c}").alias("name"), F.col(c).cast("double").alias("value")) for c in numbers])
    line = F.concat_ws("\n", F.concat(F.lit("# HELP "), F.col("name"), F.lit(" "), F.replace("name", F.lit("_"), F.lit(" "))), F.concat(F.lit("# TYPE "), F.col("name"), F.lit(" gauge")), F.concat_ws(" ", "name", F.format_string("%.6f", "value")))
    return summary.select(F.explode(listed).alias("x")).select("x.*").filter("value IS NOT NULL").select("name", line.alias("line"))


def triage_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """key, delta of counts (key, n) that have grown."""
    grown = after.alias("a").join(before.alias("b"), "key", "left").select("key", (F.col("a.n") - F.coalesce("b.n", F.lit(0))).alias("delta"))
    return grown.filter("delta > 0")


def triage_tally(verdicts: DataFrame) -> DataFrame:
    """key (kept:category or dropped:category), n."""
    key = F.concat_ws(":", F.when(F.col("include"), "kept").otherwise("dropped"), "category")
    return verdicts.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def latest_status(updates: DataFrame) -> DataFrame:
    """job_id, status, updated_at, n_updates: the last status of each job."""
    order = F.struct("updated_at", "seq")
    return updates.groupBy("job_id").agg(F.max_by("status", order).alias("status"), F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("n_updates"))


def public_jobs(jobs: DataFrame) -> DataFrame:
    """What a client may see of (job_id, owner, status, created_at, updated_at, error), with the paths to ask again."""
    path = F.concat(F.lit("/compose/jobs/"), F.col("job_id").cast("string"))
    return jobs.select("job_id", "status", "created_at", "updated_at", "error", F.concat(path, F.lit("/result")).alias("result_path"), path.alias("status_path"))
