"""Line clean-up, topics, parts, steps, tables and repetition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions.rules import is_noise
from sparkloom.functions.text import count_of, heading_key, is_table_divider, kept_first, let, slide_title, squeeze, strip, table_cells


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line of every line of every text."""
    return docs.filter("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))


def clean_text(text: Column) -> Column:
    """Squeezed lines without noise, first occurrence of each, joined again."""
    found = F.filter(F.transform(F.split(text, "\n"), squeeze), lambda x: ~is_noise(x))
    return F.array_join(kept_first(found, F.lower), "\n")


def distinct_lines(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, kept_lines, text: squeezed lines, empty ones and later repeats left out. Lines stay in their row."""
    listed = docs.filter("text IS NOT NULL").select("doc_id", F.filter(F.transform(F.split("text", "\n"), squeeze), lambda x: x != "").alias("found")).filter(F.size("found") > 0)
    kept = listed.select("doc_id", F.size("found").cast("long").alias("n_lines"), kept_first(F.col("found"), F.lower).alias("kept"))
    return kept.select("doc_id", "n_lines", F.size("kept").cast("long").alias("kept_lines"), F.array_join("kept", "\n").alias("text"))


def postprocessed(text: Column) -> Column:
    """Blank runs become one blank line; repeats under 140 characters outside structured lines, and leftovers, go."""

    def kind(x: Column) -> Column:
        dropped = x.rlike(C.LEFTOVER_LINES) | x.rlike(C.CHATTER) | x.rlike(C.SPELLED_DAYS) | (F.regexp_count(x, F.lit(r"\?")) >= 2) | x.rlike(C.NAME_LIST)
        structured = x.startswith("|") | x.startswith("[[IMAGE:") | x.startswith("#")
        return F.when(x == "", "blank").when(structured, "structured").when(dropped, "dropped").otherwise("plain")

    lines = F.transform(F.split(text, "\n"), squeeze)
    kinds = F.filter(F.transform(lines, lambda x, i: F.struct(kind(x).alias("kind"), F.lower(x).alias("key"), i.alias("i"), x.alias("line"))), lambda x: x["kind"] != "dropped")
    # sorted by kind, text and place, the first of equal plain lines follows another one
    first = lambda s: F.filter(s, lambda x, i: (x["kind"] != "plain") | (F.length(x["line"]) >= 140) | (i == 0) | (F.get(s, i - 1)["key"] != x["key"]) | (F.get(s, i - 1)["kind"] != "plain"))
    placed = let(F.array_sort(kinds), lambda s: F.array_sort(F.transform(first(s), lambda x: F.struct(x["i"].alias("i"), x["kind"].alias("kind"), x["line"].alias("line")))))
    single = let(placed, lambda s: F.filter(s, lambda x, i: (x["kind"] != "blank") | ((i > 0) & (F.get(s, i - 1)["kind"] != "blank"))))
    return F.regexp_replace(F.array_join(F.transform(single, lambda x: x["line"]), "\n"), r"\n+$", "")


def postprocess(docs: DataFrame) -> DataFrame:
    """doc_id, text of the documents of which something is left."""
    return docs.filter("text IS NOT NULL").select("doc_id", postprocessed(F.col("text")).alias("text"))


def merge_topics(slides: DataFrame) -> DataFrame:
    """deck, topic_no, title, lines, tables, images of (deck, slide_no, title, lines and, if they are there, tables and
    images): untitled slides carry the last title on, equal titles fold into their first slide, repeated lines go.
    Topics without any content are left out."""
    empty = {"tables": "cast(array() AS array<array<array<string>>>)", "images": "cast(array() AS array<string>)"}
    whole = slides.withColumns({c: F.expr(e) for c, e in empty.items() if c not in slides.columns})
    named = whole.withColumn("own", F.nullif(slide_title(F.col("title")), F.lit("")))
    carried = named.withColumn("title", F.coalesce(F.last("own", ignorenulls=True).over(W.partitionBy("deck").orderBy("slide_no").rowsBetween(W.unboundedPreceding, 0)), F.lit("Overview")))
    ordered = lambda c: F.flatten(F.transform("all", lambda x: F.coalesce(x[c], F.array())))
    topics = carried.groupBy("deck", F.lower("title").alias("key")).agg(F.min(F.struct("slide_no", "title")).alias("first"), F.sort_array(F.collect_list(F.struct("slide_no", "lines", "tables", "images"))).alias("all"))
    joined = topics.select("deck", "first.slide_no", F.col("first.title").alias("title"), kept_first(F.filter(ordered("lines"), lambda x: strip(x) != ""), F.lower).alias("lines"), ordered("tables").alias("tables"), ordered("images").alias("images"))
    filled = joined.filter((F.size("lines") > 0) | (F.size("tables") > 0) | (F.size("images") > 0))
    return filled.withColumn("topic_no", F.row_number().over(W.partitionBy("deck").orderBy("slide_no"))).select("deck", "topic_no", "title", "lines", "tables", "images")


def keyword_score(text: Column, words: tuple[str, ...], weigh=count_of) -> Column:
    return sum((weigh(text, F.lit(w)) for w in words[1:]), weigh(text, F.lit(words[0])))


def classify_part(title: Column, lines: Column, parts: dict[str, tuple[str, ...]] | None = None, default: str = C.DEFAULT_PART) -> Column:
    """The part whose keywords occur most in the title (three times) and the first eight lines; the first of equals; a
    default for none."""
    parts = C.PARTS if parts is None else parts
    text = F.lower(F.concat_ws(" ", title, title, title, F.slice(lines, 1, 8)))
    scored = lambda t: F.array(*[F.struct(keyword_score(t, w).alias("s"), F.lit(-i).alias("i"), F.lit(p).alias("part")) for i, (p, w) in enumerate(parts.items())])
    return let(let(text, lambda t: F.array_max(scored(t))), lambda best: F.when(best["s"] > 0, best["part"]).otherwise(default))


def _few_per_section(n: int, limit: int):
    """Of (doc_id, chunk_no, score, hits: a count for each section) the first ``limit`` rows of a task for each section, by hits,
    score, doc_id and chunk_no: section's number and the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[list[np.ndarray]] = [[] for _ in range(n)]
        for b in batches:
            doc, chunk, score = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            hits = b.column(3).flatten().to_numpy().reshape(-1, n)
            for i in range(n):
                able = np.arange(len(doc)) if len(doc) <= limit else np.flatnonzero(hits[:, i] >= np.partition(hits[:, i], -limit)[-limit])
                rows = [x[able] for x in (hits[:, i], score, doc, chunk)]
                rows = [np.concatenate(x) for x in zip(kept[i], rows, strict=True)] if kept[i] else rows
                first = np.lexsort((rows[3], rows[2], -rows[1], -rows[0]))[:limit]
                kept[i] = [x[first] for x in rows]
        for i, rows in enumerate(kept):
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows[0]), i, np.int32)), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int32()), pa.array(rows[0], pa.int32()), pa.array(rows[1], pa.float64())], names=["n", "doc_id", "chunk_no", "hits", "score"])

    return run


def section_chunks(parts: DataFrame, sections: dict[str, tuple[str, ...]] | None = None, limit: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """section, doc_id, chunk_no, hits, rank of (doc_id, chunk_no, text, score): most keywords first, then score; within ``by``
    if it is given.

    Sections are columns of one pass, not a join: each chunk is read and lower-cased once whatever their number. Without
    ``by`` tasks keep ``limit`` chunks a section, so that is all that is sorted."""
    sections = C.SECTIONS if sections is None else sections
    low = parts.select(*by, "doc_id", "chunk_no", F.round("score", 9).alias("score"), F.lower("text").alias("low"))
    hits = F.array(*[F.coalesce(keyword_score(F.col("low"), w, lambda t, k: t.contains(k).cast("int")), F.lit(-1)) for w in sections.values()])
    names = F.array(*[F.lit(s) for s in sections])
    if by:
        scored = low.select(*by, "doc_id", "chunk_no", "score", F.posexplode(hits).alias("n", "hits"))
    else:
        rows = low.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("chunk_no").cast("int").alias("chunk_no"), F.col("score").cast("double").alias("score"), hits.alias("hits"))
        scored = rows.mapInArrow(_few_per_section(len(sections), limit), "n int, doc_id long, chunk_no int, hits int, score double")
    scored = scored.select(*by, F.get(names, F.col("n")).alias("section"), "doc_id", "chunk_no", F.nullif(F.col("hits"), F.lit(-1)).alias("hits"), "score")
    order = W.partitionBy(*by, "section").orderBy(F.desc("hits"), F.desc("score"), "doc_id", "chunk_no")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)


def procedure_steps(topics: DataFrame, pattern: str = C.STEP_TITLE, most: int = 30) -> DataFrame:
    """deck, step, topic_no, title: the first topic of each step number up to ``most``."""
    numbered = topics.withColumn("step", F.regexp_extract("title", pattern, 1).try_cast("int")).filter(F.col("step").between(1, most))
    return numbered.withColumn("nth", F.row_number().over(W.partitionBy("deck", "step").orderBy("topic_no"))).filter("nth = 1").select("deck", "step", "topic_no", "title")


def repetition(units: DataFrame) -> DataFrame:
    """kind, total, unique_units, extra of (kind, unit): extra counts all but the first of equal units."""
    per = units.withColumn("unit", F.lower(squeeze(F.col("unit")))).filter("unit <> ''").groupBy("kind", "unit").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("kind").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_units"), F.sum(F.col("n") - 1).alias("extra"))


def document_units(docs: DataFrame, least: int = 40) -> DataFrame:
    """doc_id, kind, unit of Markdown documents: paragraphs, headings, figures, and sentences of at least ``least`` characters
    of the paragraphs that are prose."""
    plain = lambda x: F.lower(squeeze(x))
    blocks = F.filter(F.split("text", "\n\n"), lambda b: strip(b) != "")
    prose = F.filter(blocks, lambda b: ~strip(b).rlike(r"^(#|\||\[\[IMAGE:)"))
    parts = F.flatten(F.transform(prose, lambda b: F.split(F.regexp_replace(b, C.IMAGE_TOKEN, " "), r"(?<=[.!?])\s+")))
    kinds = {
        "paragraph": F.transform(blocks, plain),
        "heading": F.transform(F.filter(F.split("text", "\n"), lambda x: x.startswith("#")), plain),
        "figure": F.regexp_extract_all("text", F.lit(C.IMAGE_TOKEN), F.lit(1)),
        "sentence": F.transform(F.filter(parts, lambda x: F.length(strip(x)) >= least), plain),
    }
    listed = F.flatten(F.array(*[F.transform(units, lambda u: F.struct(F.lit(kind).alias("kind"), u.alias("unit"))) for kind, units in kinds.items()]))  # noqa: B023
    return docs.filter("text IS NOT NULL").select("doc_id", F.explode(listed).alias("u")).select("doc_id", "u.kind", "u.unit")


def document_repetition(docs: DataFrame) -> DataFrame:
    """doc_id, kind, total, unique_units, extra of each document: extra counts all but the first of equal units."""
    per = document_units(docs).groupBy("doc_id", "kind", "unit").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("doc_id", "kind").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("unique_units"), F.sum(F.col("n") - 1).alias("extra"))


def template_shapes(units: DataFrame, words: int = 5, more_than: int = 2) -> DataFrame:
    """shape, n: first words of units that more than ``more_than`` units share."""
    shape = F.array_join(F.slice(F.split(F.lower(squeeze(F.col("unit"))), " "), 1, words), " ")
    return units.select(shape.alias("shape")).filter("shape <> ''").groupBy("shape").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > more_than)


def repeated_lines(docs: DataFrame, least: int = 80, most: int = 5) -> DataFrame:
    """line, n of the squeezed lines of at least ``least`` characters that occur more than once, the most common first."""
    found = lines(docs).select(F.lower(squeeze(F.col("line"))).alias("line")).filter(F.length("line") >= least)
    return found.groupBy("line").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").orderBy(F.desc("n"), "line").limit(most)


def title_mode(slides: DataFrame, most: int = 8) -> DataFrame:
    """title, n of the most common titles of (title)."""
    return slides.filter("title IS NOT NULL AND title <> ''").groupBy("title").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "title").limit(most)


def table_shapes(tables: DataFrame) -> DataFrame:
    """rows, columns, n of (cells)."""
    return tables.groupBy(F.size("cells").alias("rows"), F.size(F.get("cells", F.lit(0))).alias("columns")).agg(F.count(F.lit(1)).alias("n"))


def adjacent_repeats(rows: DataFrame, prefix: str = "status as of") -> DataFrame:
    """doc_id, pos, line of the status headings that equal the next line of (doc_id, pos, line)."""
    keyed = rows.withColumn("key", heading_key(F.col("line")))
    following = F.lead("key").over(W.partitionBy("doc_id").orderBy("pos"))
    return keyed.withColumn("following", following).filter(F.col("key").startswith(prefix) & (F.col("key") == F.col("following"))).select("doc_id", "pos", "line")


def heading_before(rows: DataFrame) -> DataFrame:
    """Each figure row of (doc_id, pos, kind, text) with the last heading before it: an as-of join by a window."""
    heading = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(W.partitionBy("doc_id").orderBy("pos"))
    return rows.withColumn("heading", heading).filter("kind = 'figure'").select("doc_id", "pos", "text", "heading")


def misplaced_figures(rows: DataFrame, least: float = 0.35) -> DataFrame:
    """The figures of ``heading_before`` whose subject shares too few words with the heading above."""
    found = heading_before(rows).withColumns({"h": heading_key(F.col("heading")), "f": heading_key(F.col("text"))}).filter("h <> '' AND f <> ''")
    a, b = F.array_distinct(F.split("h", " ")), F.array_distinct(F.split("f", " "))
    share = F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))
    return found.filter(~(F.contains("f", "h") | F.contains("h", "f") | (share >= least)) & ~F.startswith("f", F.lit("continuation view"))).select("doc_id", "pos", "heading", "text")


def rectangular(rows: Column) -> Column:
    """Table rows as cell arrays of one width, dividers and empty rows left out."""
    cells = F.filter(F.transform(F.filter(rows, lambda r: ~is_table_divider(r)), table_cells), lambda r: F.exists(r, lambda c: c != ""))
    return let(cells, lambda m: let(F.array_max(F.transform(m, F.size)), lambda width: F.transform(m, lambda r: F.concat(r, F.array_repeat(F.lit(""), width - F.size(r))))))


def compact_matrix(cells: Column, max_rows: int = 18, max_cols: int = 6) -> Column:
    """At most 18 x 6 cells without empty rows and columns; null unless 2 x 2 remain."""
    cut = F.transform(F.slice(cells, 1, max_rows), lambda r: F.slice(F.transform(r, squeeze), 1, max_cols))
    full = F.filter(cut, lambda r: F.exists(r, lambda c: c != ""))
    columns = lambda m: F.sequence(F.lit(0), F.greatest(F.coalesce(F.array_max(F.transform(m, F.size)), F.lit(1)), F.lit(1)) - 1)
    used = lambda m: F.filter(columns(m), lambda k: F.exists(m, lambda r: F.coalesce(F.get(r, k), F.lit("")) != ""))
    kept = lambda m, u: F.when((F.size(m) >= 2) & (F.size(u) >= 2), F.transform(m, lambda r: F.transform(u, lambda k: F.coalesce(F.get(r, k), F.lit("")))))
    return let(full, lambda m: let(used(m), lambda u: kept(m, u)))


def narratives(raw: Column, least: int = 80) -> Column:
    """Map of topic number to body from ``[TOPIC n]`` lines; bodies under ``least`` characters go, later ones win."""
    marked = F.regexp_replace(raw, C.TOPIC_MARKER, "\u0001$1\u0002")
    blocks = F.slice(F.split(marked, "\u0001"), F.lit(2), F.greatest(F.size(F.split(marked, "\u0001")) - 1, F.lit(0)))
    body = lambda b: F.regexp_replace(strip(F.regexp_replace(strip(F.substring_index(b, "\u0002", -1)), r"(?m)^#{1,6}\s.*$", "")), r"\n{3,}", "\n\n")
    pairs = F.transform(blocks, lambda b: F.struct(F.substring_index(b, "\u0002", 1).cast("int").alias("key"), body(b).alias("value")))
    good = F.filter(pairs, lambda p: (F.length(p["value"]) >= least) & p["key"].isNotNull())
    last = lambda g: F.filter(g, lambda p, i: ~F.exists(F.slice(g, i + 2, F.size(g)), lambda q: q["key"] == p["key"]))
    return let(good, lambda g: F.map_from_entries(last(g)))
