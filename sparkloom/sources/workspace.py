"""Workspace files: scan, text, JSON and CSV. Binary formats are read on the executors, one file at a time."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.sources.decks import deck_text
from sparkloom.streaming.jobs import OPEN, SILENT

SUFFIXES = ("md", "txt", "docx", "pdf", "pptx")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """path, suffix, modificationTime, length, content of supported files below ``root``, none with a hidden part."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    inside = F.regexp_replace("path", r"^[a-z]+:/+", "/")
    return files.withColumn("suffix", suffix).filter(F.col("suffix").isin(*SUFFIXES) & ~inside.rlike(r"/\."))


def docx_text(blob: bytes) -> str:
    tree = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(blob)).read("word/document.xml"))
    paras = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in tree.iter(f"{_W}p"))
    return "\n".join(f"[Paragraph {i}] {x}" for i, x in enumerate(paras, 1) if x)


def read_text(suffix: str, blob: bytes, parse_pdf=None) -> str:
    """The text of a file; unreadable and unknown ones are empty. ``parse_pdf``: bytes to text, as no parser is built in."""
    try:
        if suffix in ("md", "txt"):
            return blob.decode("utf-8", errors="ignore")
        if suffix == "docx":
            return docx_text(blob)
        if suffix == "pptx":
            return deck_text(blob)
        return parse_pdf(blob) if suffix == "pdf" and parse_pdf else ""
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""


def texts(files: DataFrame, max_chars: int | None = None, parse_pdf=None) -> DataFrame:
    """path, text of scanned files, up to ``max_chars`` where given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [read_text(s, c, parse_pdf)[:max_chars] for s, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], names=["path", "text"])

    return files.select("path", "suffix", "content").mapInArrow(run, "path string, text string")


def html_text(html):
    """Text of a web page: scripts, styles and tags out, common entities decoded, white space squeezed (an extension)."""
    c = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->", " ")
    c = F.regexp_replace(c, r"(?s)<[^>]*>", " ")
    for raw, safe in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def training_pairs(spark: SparkSession, path: str) -> DataFrame:
    """source_text, optimized_text, score from CSV; absent fields are empty or 0."""
    raw = spark.read.csv(path, header=True, schema="source_text string, optimized_text string, score double", multiLine=True, escape='"')
    return raw.fillna({"source_text": "", "optimized_text": "", "score": 0.0})


def golden_cases(spark: SparkSession, path: str) -> DataFrame:
    schema = """case_id string, category string, difficulty string, prompt string, source_text string, instructions array<string>, must_include array<string>, must_not_include array<string>,
    required_sections array<string>, min_words int, max_words int, requires_ordered_steps boolean, requires_table boolean, expects_refusal boolean, expects_policy_flags array<string>, requires_generation boolean"""
    return spark.read.schema(schema).json(path, multiLine=True)


def thresholds(spark: SparkSession, path: str) -> DataFrame:
    """metric, bound, limit of a file of gates: {"version": ..., "gates": {metric: {"min" or "max": limit}}}."""
    raw = spark.read.schema("version string, gates map<string, struct<min: double, max: double, rationale: string>>").json(path, multiLine=True)
    each = raw.select("version", F.explode("gates").alias("metric", "g"))
    return each.select("version", "metric", F.when(F.col("g.min").isNotNull(), "min").otherwise("max").alias("bound"), F.coalesce("g.min", "g.max").alias("limit"))


def benchmark_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """One row of an evaluation report: status (available or missing), mode, gate_status, threshold_version, case_count,
    generated_at, summary, advisory_case_ids and updated_at. A report that does not exist is missing."""
    schema = "mode string, gate_status string, threshold_version string, case_count int, generated_at string, summary map<string, double>, advisory_case_ids array<string>"
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath):
        return spark.sql("SELECT 'missing' AS status").select("status", *(F.lit(None).cast(t).alias(n) for n, t in (x.strip().split(" ", 1) for x in re.split(r",\s*(?=[a-z_]+ )", schema))), F.lit(None).cast("timestamp").alias("updated_at"))
    found = spark.read.schema(schema).json(path, multiLine=True)
    return found.select(F.lit("available").alias("status"), "*", F.col("_metadata.file_modification_time").alias("updated_at"))


def job_snapshots(spark: SparkSession, path: str, restarted_at: float) -> DataFrame:
    """job_id, owner_user_id, owner_user_role, status, created_at, updated_at (seconds), request, result (JSON), error of a
    folder of jobs' snapshots, the last of each job.

    A job that was open when the server restarted is interrupted: nobody works on it any more."""
    schema = "job_id string, owner_user_id string, owner_user_role string, status string, created_at double, updated_at double, request string, result string, error string"
    found = spark.read.schema(schema).json(path, multiLine=True).filter("job_id IS NOT NULL")
    columns = [c for c in found.columns if c != "job_id"]
    last = found.groupBy("job_id").agg(F.max_by(F.struct(*columns), F.coalesce("updated_at", F.lit(0.0))).alias("x")).select("job_id", "x.*")
    gone = F.col("status").isin(*OPEN) & (F.coalesce("updated_at", F.lit(0.0)) < restarted_at)
    return last.withColumns({
        "error": F.when(gone, F.lit(SILENT)).otherwise(F.col("error")), "updated_at": F.when(gone, F.lit(float(restarted_at))).otherwise(F.col("updated_at")), "status": F.when(gone, "interrupted").otherwise(F.col("status")),
    })


def artifact_records(spark: SparkSession, path: str) -> DataFrame:
    """artifact_id, owner, format, mime_type, filename, path, size_bytes, download_path of a folder of artifacts' metadata."""
    schema = "artifact_id string, owner_user_id string, format string, mime_type string, filename string, path string, size_bytes long"
    found = spark.read.schema(schema).json(path, multiLine=True).filter("artifact_id IS NOT NULL")
    return found.withColumnRenamed("owner_user_id", "owner").withColumn("download_path", F.concat(F.lit("/artifacts/"), "artifact_id"))


def changed_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """The scanned files that are new or whose time or length differs from ``known`` (path, modificationTime, length): the
    others' texts need not be read again."""
    return files.join(known.select("path", "modificationTime", "length"), ["path", "modificationTime", "length"], "left_anti")


def cached_results(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests (key) with ``result`` from a cache (key, result); a blank result counts as none."""
    return requests.join(cache.filter(F.trim("result") != "").select("key", "result"), "key", "left")
