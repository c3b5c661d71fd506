"""Documents assembled from topics and retrieved chunks: narratives, tables, figures, parts and sections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions import text as T
from sparkloom.operators.structure import classify_part, procedure_steps, section_chunks

T_ = C.TEMPLATES


def _pick(n: Column, choices: tuple[str, ...]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in choices]), n)


def _filled(template: str, **values: Column) -> Column:
    """A template with its ``{names}`` replaced."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name]]
    return F.concat(*parts, F.lit(rest))


def table_lines(cells: Column, most: int = 90) -> Column:
    """A slide's table as lines of Markdown: columns about persons and remarks go if two others remain, long cells are
    clipped, blank heads named, rows of reported speech and empty ones left out; no lines without a row."""
    clean = lambda c: T.clip_on_word(T.squeeze(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("/")), r"\*{2,}", " ")), most, " ", "…")
    row = lambda cells_: F.concat(F.lit("| "), F.array_join(cells_, " | "), F.lit(" |"))
    place = lambda m: F.sequence(F.lit(0), F.size(F.get(m, F.lit(0))) - 1)
    able = lambda m: F.filter(place(m), lambda i: ~T.strip(F.get(F.get(m, F.lit(0)), i)).rlike(C.OMITTED_COLUMN))
    keep = lambda m: T.let(able(m), lambda k: F.when(F.size(k) < 2, place(m)).otherwise(k))

    def rendered(m: Column, k: Column) -> Column:
        head = F.transform(k, lambda i, at: T.let(clean(F.get(F.get(m, F.lit(0)), i)), lambda c: F.when(c != "", c).when(at == 0, F.lit("#")).otherwise(F.concat(F.lit("Detail "), at.cast("string")))))
        rows = F.transform(F.slice(m, F.lit(2), F.size(m)), lambda r: F.transform(k, lambda i: clean(F.get(r, i))))
        kept = F.filter(rows, lambda r: F.exists(r, lambda c: c != "") & ~F.array_join(r, " ").rlike(C.TABLE_CHATTER))
        divider = row(F.transform(k, lambda _: F.lit("---")))
        return F.when(F.size(kept) > 0, F.concat(F.array(row(head), divider), F.transform(kept, row)))

    none = F.expr("cast(array() AS array<string>)")
    return F.when((F.size(cells) >= 2) & (F.size(F.get(cells, F.lit(0))) > 0), F.coalesce(T.let(cells, lambda m: T.let(keep(m), lambda k: rendered(m, k))), none)).otherwise(none)


def figure_sentence(title: Column, lines: Column, most: int = 220) -> Column:
    subject = F.lower(T.strip(F.coalesce(F.nullif(title, F.lit("")), F.lit("this topic"))))
    evidence = T.clip_on_word(F.array_join(F.filter(F.transform(F.slice(lines, 1, 3), T.strip), lambda x: x != ""), " "), most, " ", "...")
    return T.let(evidence, lambda e: F.when(e != "", _filled(T_["figure"], subject=subject, evidence=e)).otherwise(_filled(T_["bare_figure"], subject=subject)))


def narrative(title: Column, lines: Column, n_tables: Column, n_images: Column) -> Column:
    """What a topic's own lines say, in up to three paragraphs: facts are lines of 25 characters or more, fourteen at most.
    The title's length chooses among phrasings, so documents do not read like one template."""
    variant = F.pmod(F.length(title), F.lit(3))
    subject = F.coalesce(F.nullif(title, F.lit("")), F.lit("this area of the programme"))
    opener = F.concat(_pick(variant, C.OPENERS[:3]), F.lit(" "), subject, F.lit(". "))
    said = lambda f, a, n: F.array_join(F.slice(f, a, n), " ")

    def paragraphs(f: Column) -> Column:
        listed = F.array(
            F.concat(opener, F.when(F.size(f) > 0, said(f, 1, 3)).otherwise(_pick(variant, T_["visual_only"]))),
            F.when(F.size(f) > 3, F.concat(_pick(variant, T_["follow_ups"]), F.lit(" "), said(f, 4, 5))),
            F.when(F.size(f) > 8, F.concat(F.lit(T_["more"] + " "), said(f, 9, 6))),
            F.when(n_tables > 0, F.lit(T_["table"])),
            F.when(n_images > 0, figure_sentence(title, lines)),
        )
        return F.array_join(F.array_compact(listed), "\n\n")

    return T.let(F.slice(F.filter(lines, lambda x: F.length(x) >= 25), 1, 14), paragraphs)


def topic_payload(number: Column, title: Column, lines: Column, n_tables: Column, n_images: Column) -> Column:
    """What a model is told about a topic: its subject, exhibits and first 22 lines."""
    body = F.array_join(F.transform(F.slice(lines, 1, 22), lambda x: F.concat(F.lit("- "), x)), "\n")
    exhibits = F.concat_ws("; ", F.when(n_tables > 0, F.concat(n_tables.cast("string"), F.lit(" table(s)"))), F.when(n_images > 0, F.concat(n_images.cast("string"), F.lit(" figure(s)"))))
    shown = F.when(exhibits != "", F.concat(exhibits, F.lit(" are shown with the text."))).otherwise(F.lit("No exhibits."))
    return F.concat(F.lit("[TOPIC "), number.cast("string"), F.lit("] "), title, F.lit("\n"), shown, F.lit("\n"), F.when(body != "", body).otherwise(F.lit("- (no text)")))


def without_narrative(topics: DataFrame, narratives: DataFrame) -> DataFrame:
    """The topics (deck, topic_no) that no narrative (deck, topic_no, body) covers."""
    return topics.join(narratives.select("deck", "topic_no"), ["deck", "topic_no"], "left_anti")


def narrated(topics: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``topics`` with ``body``. ``generate`` maps deck, topic_no, payload to narratives (deck, topic_no, body); it is asked
    a second time for topics that it left out, and what is still missing is stated from the topic's own lines."""
    counted = topics.withColumns({"n_tables": F.size("tables"), "n_images": F.size("images")})
    own = narrative(F.col("title"), F.col("lines"), F.col("n_tables"), F.col("n_images"))
    if generate is None:
        return counted.withColumn("body", own)
    asked = counted.select("deck", "topic_no", topic_payload(F.col("topic_no"), F.col("title"), F.col("lines"), F.col("n_tables"), F.col("n_images")).alias("payload"))
    first = generate(asked).select("deck", "topic_no", "body")
    found = first.unionByName(generate(without_narrative(asked, first)).select("deck", "topic_no", "body")).dropDuplicates(["deck", "topic_no"])
    return counted.join(found, ["deck", "topic_no"], "left").withColumn("body", F.coalesce("body", own))


def _block(rows: DataFrame, order: list, lines: Column) -> DataFrame:
    """deck, ord (an array of ten numbers at most), lines."""
    return rows.select("deck", F.array(*[F.col(o).cast("long") if isinstance(o, str) else F.lit(o).cast("long") for o in order]).alias("ord"), lines.alias("lines"))


def assemble(topics: DataFrame, titles: DataFrame, generate: Callable[[DataFrame], DataFrame] | None = None, parts: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """deck, text: one document per deck of ``topics`` (from ``merge_topics``) in thematic parts, with ``titles`` (deck, title).

    A purpose, a table of parts, the numbered steps, the parts with their topics, tables and figures, and a closing list.
    """
    taxonomy = C.PARTS if parts is None else parts
    told = narrated(topics, generate).withColumn("part", classify_part(F.col("title"), F.col("lines"), taxonomy))
    rank_ = F.array_position(F.array(*[F.lit(p) for p in (*taxonomy, C.DEFAULT_PART)]), F.col("part"))
    told = told.withColumn("part_rank", rank_)
    per_part = told.groupBy("deck", "part", "part_rank").agg(F.count(F.lit(1)).alias("n_topics")).withColumn("part_no", F.row_number().over(W.partitionBy("deck").orderBy("part_rank")))
    told = told.join(per_part.select("deck", "part", "part_no"), ["deck", "part"])
    whole = told.groupBy("deck").agg(F.count(F.lit(1)).alias("n_topics"), F.count_distinct("part").alias("n_parts"), F.sum("n_images").alias("n_images"), F.sum("n_tables").alias("n_tables"))

    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    lines = lambda *x: F.array(*[F.lit(y) if isinstance(y, str) else y for y in x])
    scope = text("This reference covers ", F.col("n_topics"), " topics in ", F.col("n_parts"), " parts, with ", F.col("n_images"), " figures and ", F.col("n_tables"), " tables where they are referred to.")
    figures = lambda most: F.flatten(F.transform(F.slice("images", F.lit(1), F.lit(most)), lambda i: F.array(figure_sentence(F.col("title"), F.col("lines")), F.concat(F.lit("[[IMAGE:"), i, F.lit("]]")), F.lit(""))))
    tables = F.flatten(F.transform(F.filter(F.transform("tables", lambda t: table_lines(t)), lambda t: F.size(t) > 0), lambda t: F.concat(t, F.array(F.lit("")))))

    numbered = procedure_steps(told)
    step_no = F.row_number().over(W.partitionBy("deck").orderBy("step"))
    steps = numbered.withColumn("step_no", step_no).join(told.select("deck", "topic_no", "lines", "images"), ["deck", "topic_no"])
    actions = F.transform(F.slice("lines", 1, 8), lambda x: F.concat(F.lit("- "), x))
    step_title = T.strip(F.regexp_extract("title", C.STEP_TITLE, 2))
    blocks = [
        _block(titles.join(whole, "deck"), [0], lines(text("# ", F.col("title")), "", "## Document Purpose and Scope", "", scope, "", "## How This Document Is Organised", "", "| Part | Theme | Topics covered |", "| --- | --- | --- |")),
        _block(per_part, [1, "part_no"], lines(text("| Part ", F.col("part_no"), " | ", F.col("part"), " | ", F.col("n_topics"), " |"))),
        _block(whole, [2], lines("")),
        _block(numbered.select("deck").distinct(), [3], lines("## Steps to Follow", "")),
        _block(steps, [4, "step_no"], F.concat(lines(text("### Step ", F.col("step_no"), ": ", step_title), ""), actions, F.when(F.size(actions) > 0, lines("")).otherwise(F.expr("cast(array() AS array<string>)")), figures(2))),
        _block(per_part, [5, "part_no", 0], lines(text("## Part ", F.col("part_no"), ": ", F.col("part")), "")),
        _block(told, [5, "part_no", 1, "topic_no"], F.concat(lines(text("### ", F.col("title")), "", F.col("body"), ""), figures(1 << 20), tables)),
        _block(whole, [6], lines("## Publication Readiness Considerations", "", *(f"- {x}" for x in T_["closing"]))),
    ]
    every = blocks[0]
    for b in blocks[1:]:
        every = every.unionByName(b)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "lines"))), lambda x: x["lines"])
    return every.groupBy("deck").agg(F.array_join(F.flatten(ordered), "\n").alias("text"))


def fallback_document(chunks: DataFrame, title: str, objective: str = "", sections: dict[str, tuple[str, ...]] | None = None, dossier: bool = False) -> DataFrame:
    """qid, text of each query: a document from its retrieved chunks (qid, doc_id, chunk_no, text, score, rank) alone, with an
    overview and a section for each subject that has fragments. Only a bounded number of top chunks takes part."""
    sections = C.SECTIONS if sections is None else sections
    few, cap, most = (10, 18, 10) if dossier else (6, 8, 6)
    frag = chunks.select("qid", "doc_id", "chunk_no", "rank", T.fragments(F.col("text")).alias("f"))
    gathered = lambda: T.distinct_fragments(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "f"))), lambda x: x["f"])))
    block = lambda f, n: F.array_join(T.prose(f, n), "\n")
    overview = frag.filter(F.col("rank") <= few).groupBy("qid").agg(gathered().alias("f")).select("qid", F.lit(0).alias("pos"), F.lit("Executive Overview").alias("title"), block(F.col("f"), most).alias("body"))
    near = section_chunks(chunks, sections, 8 if dossier else 5, by=("qid",)).join(frag.select("qid", "doc_id", "chunk_no", "f"), ["qid", "doc_id", "chunk_no"])
    place = F.array_position(F.array(*[F.lit(s) for s in sections]), F.col("section"))
    per = near.groupBy("qid", "section").agg(gathered().alias("f")).filter(F.size("f") > 0).select("qid", place.cast("int").alias("pos"), F.col("section").alias("title"), block(F.col("f"), cap).alias("body"))
    listed = overview.unionByName(per.filter(F.col("pos") <= (12 if dossier else 8)))
    head = F.lit(f"# {title}\n\n## Objective\n{objective or title}\n\n")
    tail = F.lit("\n\n## Publication Readiness Considerations\n\n" + "\n".join(f"- {x}" for x in T_["closing"]))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "title", "body"))), lambda x: F.concat(F.lit("## "), x["title"], F.lit("\n\n"), x["body"])), "\n\n")
    return listed.groupBy("qid").agg(body.alias("body")).select("qid", F.concat(head, F.col("body"), tail).alias("text"))


def augmented(text: Column, appendix: Column, least: int = 9_000) -> Column:
    """A text shorter than ``least`` with the appendix below, the latter without its title line."""
    more = T.strip(F.array_join(F.filter(F.split(appendix, "\n"), lambda x: ~x.startswith("# ")), "\n"))
    return F.when(F.length(T.strip(text)) >= least, text).otherwise(F.concat(T.strip(text), F.lit("\n\n## Expanded Supporting Detail\n\n"), more))


def image_tokens(docs: DataFrame) -> DataFrame:
    """doc_id, pos, name of the image tokens of (doc_id, text), in order."""
    found = F.transform(F.regexp_extract_all("text", F.lit(C.IMAGE_TOKEN), F.lit(1)), T.strip)
    return docs.select("doc_id", F.posexplode(found).alias("pos", "name"))


def placed_images(docs: DataFrame, images: DataFrame, most: int = 24) -> DataFrame:
    """doc_id, place (inline or appendix), pos, name, content: images (doc_id, pos, name, content) at their tokens, and
    the first ``most`` of those that no token of their document names. Unreadable contents are left out."""
    able = images.withColumn("content", T.base64_bytes(F.col("content"))).filter("content IS NOT NULL")
    tokens = image_tokens(docs)
    inline = tokens.join(able.select("doc_id", "name", "content"), ["doc_id", "name"]).select("doc_id", F.lit("inline").alias("place"), "pos", "name", "content")
    left = able.join(tokens.select("doc_id", "name").distinct(), ["doc_id", "name"], "left_anti")
    nth = F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "name"))
    appendix = left.withColumn("nth", nth).filter(F.col("nth") <= most).select("doc_id", F.lit("appendix").alias("place"), (F.col("nth") - 1).alias("pos"), "name", "content")
    return inline.unionByName(appendix)


def profiles(spark: SparkSession) -> DataFrame:
    """The levels of detail as a dimension table."""
    return spark.createDataFrame(list(C.PROFILES), "detail string, route string, mode string, least_docs int, most_docs int, max_chars int, max_chars_per_doc int, least_chunks int, most_chunks int")


def routed(requests: DataFrame, top_k: int = C.DEFAULT.ranking.top_k) -> DataFrame:
    """Requests (request_id, detail, max_docs) with their route, mode and limits; an unknown level counts as a dossier."""
    table = F.broadcast(profiles(requests.sparkSession))
    known = F.when(F.col("detail").isin(*[p[0] for p in C.PROFILES]), F.col("detail")).otherwise(F.lit("dossier"))
    clamp = lambda x, least, most: F.greatest(F.col(least), F.least(x, F.coalesce(most, x)))
    joined = requests.withColumn("detail", known).join(table, "detail")
    return joined.select("request_id", "route", "mode", clamp(F.col("max_docs"), "least_docs", F.col("most_docs")).alias("max_docs"), "max_chars", "max_chars_per_doc", clamp(F.lit(top_k), "least_chunks", F.col("most_chunks")).alias("top_k"))


def retrieval_query(prompt: Column, objective: Column, domain: Column, instructions: Column, hints: Column, source_text: Column) -> Column:
    """The text that retrieval searches for: all that a request says, a line each, and the first 800 characters of its text."""
    given = F.concat(F.array(prompt, objective, domain), F.coalesce(instructions, F.array()), F.coalesce(hints, F.array()), F.array(F.substring(T.strip(source_text), 1, 800)))
    return F.array_join(F.filter(F.transform(given, lambda x: T.strip(F.coalesce(x, F.lit("")))), lambda x: x != ""), "\n")


def ordered_distinct(c: Column) -> Column:
    """Candidates without later repeats, in order."""
    return F.array_distinct(c)


def distinct_sources(ranked: DataFrame) -> DataFrame:
    """qid, sources of (qid, rank, source): each once, in the order of its best rank."""
    first = ranked.groupBy("qid", "source").agg(F.min("rank").alias("rank"))
    return first.groupBy("qid").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "source"))), lambda x: x["source"]).alias("sources"))
