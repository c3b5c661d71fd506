"""Golden cases: scores, summary, gates and baseline."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions.text import strip
from sparkloom.operators.selection import nearest_rank

CASE = """case_id string, must_include array<string>, must_not_include array<string>, required_sections array<string>, min_words int, max_words int,
requires_ordered_steps boolean, requires_table boolean, expects_refusal boolean, gated boolean, output string, ok boolean, latency_ms int"""


def score_cases(cases: DataFrame) -> DataFrame:
    """The cases with coverage, clean, structure, length and refusal results of their ``output``."""
    low = F.lower("output")
    words = F.size(F.filter(F.split(strip(F.col("output")), r"\s+"), lambda w: w != ""))
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    hits = F.size(F.filter("must_include", lambda t: low.contains(F.lower(t))))
    quoted = lambda t: F.regexp_replace(t, r"([^A-Za-z0-9 ])", r"\\$1")
    leaked = F.filter("must_not_include", lambda t: F.regexp_like(F.col("output"), F.concat(F.lit(r"(?i)(^|[^\w-])"), quoted(t), F.lit(r"($|[^\w-])"))))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    structure = (~flag("requires_ordered_steps") | F.col("output").rlike(C.ORDERED_STEP)) & (~flag("requires_table") | F.col("output").rlike(C.TABLE_ROW)) & F.forall(F.coalesce("required_sections", F.expr("cast(array() AS array<string>)")), lambda s: low.contains(F.lower(s)))
    refused = F.exists(F.array(*[F.lit(m) for m in C.REFUSALS]), lambda m: low.contains(m))
    return cases.withColumns({
        "must_include_coverage": F.when(some("must_include"), hits / F.size("must_include")).otherwise(1.0),
        "forbidden_term_clean": ~some(leaked),
        "structure_compliant": structure,
        "length_compliant": (F.col("max_words").isNull() | (words <= F.col("max_words"))) & (F.col("min_words").isNull() | (words >= F.col("min_words"))),
        "refusal_correct": F.when(flag("expects_refusal"), refused),
        "word_count": words,
    })


def summarise(scored: DataFrame) -> DataFrame:
    """One row, means to three places; quality rates over gated cases that ran, 0 or 1 where there are none. The latency at
    place max(int(0.95 n) - 1, 0) of the sorted ones is exact."""
    ok, gated = F.col("ok"), F.col("ok") & F.col("gated")
    rate = lambda c, none: F.coalesce(F.avg(F.when(gated, F.col(c).cast("double"))), F.lit(none))
    place = lambda p, n: F.floor(n * p) - 1
    p95 = nearest_rank(scored.filter("ok"), "latency_ms", {"p95_latency_ms": 0.95}, index=place)
    means = scored.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(ok).alias("passed_cases"),
        F.count_if(gated).alias("gated_cases"),
        F.count_if(ok & ~F.col("gated")).alias("advisory_cases"),
        F.coalesce(F.count_if(ok) / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("pass_rate"),
        F.avg(F.when(gated, F.col("must_include_coverage"))).alias("avg_must_include_coverage"),
        F.min(F.when(gated, F.col("must_include_coverage"))).alias("min_case_must_include_coverage"),
        F.coalesce(F.avg(F.when(gated, (~F.col("forbidden_term_clean")).cast("double"))), F.lit(0.0)).alias("forbidden_term_rate"),
        rate("structure_compliant", 1.0).alias("structure_compliance_rate"),
        rate("length_compliant", 1.0).alias("length_compliance_rate"),
        rate("refusal_correct", 1.0).alias("refusal_accuracy"),
        F.avg(F.when(ok, F.col("latency_ms"))).alias("avg_latency_ms"),
        F.avg(F.when(ok, F.col("word_count"))).alias("avg_word_count"),
    )
    rounded = [F.bround(c, 3).alias(c) if t == "double" else F.col(c) for c, t in means.dtypes]
    return means.select(*rounded).join(F.broadcast(p95), F.lit(True), "left")


def long_form(summary: DataFrame) -> DataFrame:
    """metric, value rows of a one-row summary."""
    names = summary.columns
    return summary.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in names])).alias("x")).select("x.*")


def check_gates(summary: DataFrame, gates: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """metric, bound, limit, actual, status for every gate: pass, fail or skipped."""
    gates = C.GATES if gates is None else gates
    listed = summary.sparkSession.sql("SELECT * FROM VALUES " + ", ".join(f"('{m}', '{b}', {v!r}D)" for m, (b, v) in gates.items()) + " AS g(metric, bound, limit)")
    actual = F.col("value")
    fails = ((F.col("bound") == "min") & (actual < F.col("limit"))) | ((F.col("bound") == "max") & (actual > F.col("limit")))
    status = F.when(actual.isNull(), "skipped").when(fails, "fail").otherwise("pass")
    return listed.join(long_form(summary), "metric", "left").select("metric", "bound", "limit", actual.alias("actual"), status.alias("status"))


def compare_baseline(summary: DataFrame, baseline: DataFrame, tolerance: dict[str, float] | None = None) -> DataFrame:
    """metric, baseline, current, movement, status: absolute drops, or relative growth for names ending in _pct."""
    tolerance = C.TOLERANCE if tolerance is None else tolerance
    rows = ", ".join(f"('{m.removesuffix('_pct')}', {m.endswith('_pct')}, {v!r}D)" for m, v in tolerance.items())
    allowed = summary.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(metric, relative, allowed)")
    both = allowed.join(long_form(summary).withColumnRenamed("value", "current"), "metric").join(long_form(baseline).withColumnRenamed("value", "baseline"), "metric")
    both = both.filter("current IS NOT NULL AND baseline IS NOT NULL AND NOT (relative AND baseline = 0)")
    movement = F.when(F.col("relative"), (F.col("current") - F.col("baseline")) / F.nullif(F.col("baseline"), F.lit(0.0))).otherwise(F.col("current") - F.col("baseline"))
    worse = F.when(F.col("relative"), movement > F.col("allowed")).otherwise(-movement > F.col("allowed"))
    return both.select("metric", "baseline", "current", movement.alias("movement"), F.when(worse, "regression").otherwise("ok").alias("status"))


def deterministic_draft(prompt: Column, source: Column, instructions: Column) -> Column:
    """The document that restates a case's source: title, summary, key points and applied instructions."""
    points = F.array_join(F.transform(F.filter(F.split(source, r"\. "), lambda x: strip(x) != ""), lambda x: F.concat(F.lit("- "), strip(x))), "\n")
    applied = F.when(F.coalesce(F.size(instructions), F.lit(0)) > 0, F.concat(F.lit("\n\n## Applied Instructions\n"), F.array_join(F.transform(instructions, lambda x: F.concat(F.lit("- "), x)), "\n"))).otherwise("")
    return F.concat(F.lit("# "), F.regexp_replace(prompt, r"\.+$", ""), F.lit("\n\n## Summary\n"), source, F.lit("\n\n## Key Points\n"), points, applied)
