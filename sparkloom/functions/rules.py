"""Predicates and probes over lines and documents, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.functions.text import let, strip, tokens


def any_of(found: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, found)


def person_names(line: Column, other_words: tuple[str, ...] = C.NON_NAME_WORDS) -> Column:
    """Name-like pairs of words, without those that hold a word of the trade."""
    words = F.array(*[F.lit(w) for w in other_words])
    return F.filter(F.regexp_extract_all(line, F.lit(C.PERSON), F.lit(0)), lambda n: ~F.arrays_overlap(F.split(F.lower(n), r"\s+"), words))


def is_roster(line: Column) -> Column:
    roles = F.regexp_count(line, F.lit(C.ROLE_TAG_ANY_CASE))

    def listed(names: Column) -> Column:
        covered = F.aggregate(names, F.lit(0), lambda t, n: t + F.length(n))
        return (roles >= 2) | ((roles >= 1) & (F.size(names) >= 2)) | ((F.size(names) >= 3) & (F.regexp_count(line, F.lit(",")) >= 2) & (covered >= F.length(line) * F.lit(0.5)))

    return let(person_names(line), listed)


def is_noise(line: Column, patterns: tuple[str, ...] = C.NOISE_LINES, chatter_chars: int = 240) -> Column:
    """Lines that carry no content: template leftovers, rosters, chatter, punctuation."""
    s = strip(line)
    return any_of([
        s == "",
        s.rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)),
        is_roster(s),
        (F.length(s) <= chatter_chars) & s.rlike(C.CHATTER),
        F.length(s) <= 2,
        F.regexp_count(s, F.lit(r"\?")) >= 2,
        (F.size(tokens(s)) == 0) & ~s.rlike(r"\d"),
    ])


def policy_flags(text: Column) -> Column:
    found = [F.when(text.rlike(p), F.lit(f"pii_detected:{k}")) for k, p in (("email", C.EMAIL), ("phone", C.PHONE))]
    found += [F.when(F.lower(text).contains(t), F.lit(f"disallowed_term:{t}")) for t in C.DISALLOWED_TERMS]
    return F.array_compact(F.array(*found))


def leak_counts(text: Column) -> dict[str, Column]:
    """Occurrences of each probe; slide numbers inside image tokens don't count."""
    prose = F.regexp_replace(text, r"\[\[IMAGE:[^\]]*\]\]", "")
    return {k: F.regexp_count(prose if k == "slide_reference" else text, F.lit(p)) for k, p in C.LEAK_PROBES.items()}


def structure(text: Column) -> dict[str, Column]:
    n = {k: F.regexp_count(text, F.lit(p)) for k, p in C.STRUCTURE.items()}
    leaks = leak_counts(text)
    return {
        "parts": n["parts"],
        "procedure_steps": n["steps"],
        "topics": F.greatest(n["topics"] - n["steps"], F.lit(0)),
        "tables_rendered": n["dividers"],
        "table_rows": F.greatest(n["rows"] - 2 * n["dividers"], F.lit(0)),
        "figures_embedded": n["images"],
        "output_chars": F.length(text),
        **{f"leak_{k}": v for k, v in leaks.items()},
        "content_integrity_pass": reduce(lambda a, b: a & b, [v == 0 for v in leaks.values()]),
    }


def has_banned_markers(text: Column) -> Column:
    return any_of([text.rlike(p) for p in C.BANNED_MARKERS]) | text.rlike(C.CHATTER)


def violates_contract(text: Column, detail: Column, has_chunks: Column) -> Column:
    """Empty, without a title line, with banned markers, or with too few sections for its level of detail."""
    s = strip(text)
    first = strip(F.element_at(F.split(s, "\n"), 1))
    sections = F.regexp_count(s, F.lit(r"(?m)^[ \t]*## "))
    least = F.when(detail == "dossier", F.when(has_chunks, 6).otherwise(3)).when(detail == "comprehensive", F.when(has_chunks, 4).otherwise(3)).otherwise(0)
    return (s == "") | ~first.startswith("# ") | has_banned_markers(s) | (sections < least)


def llm_authorship(text: Column, topics: Column) -> tuple[Column, Column]:
    from sparkloom.functions.text import count_of

    own = reduce(lambda a, b: a + b, [count_of(text, F.lit(o)) for o in C.OPENERS])
    left = F.when(topics <= 0, F.lit(0)).otherwise(F.greatest(topics - own, F.lit(0)))
    return left, F.when(topics <= 0, F.lit(0.0)).otherwise(left / topics)


def is_generic_prompt(text: Column, words: tuple[str, ...] = C.GENERIC_PROMPT) -> Column:
    t = tokens(text, 1)
    known = F.array(*[F.lit(w) for w in words])
    return (F.size(t) <= 5) & F.forall(t, lambda x: F.array_contains(known, x))


def is_workflow_topic(title: Column, lines: Column) -> Column:
    """Two or more words of software work in the title and the first six lines."""
    return F.regexp_count(F.concat_ws(" ", F.nullif(title, F.lit("")), F.slice(lines, 1, 6)), F.lit(C.WORKFLOW_HINT)) >= 2


def is_relevant_image(category: Column, include: Column, workflow: Column, aspect: Column, skin: Column) -> Column:
    """Included images but for portrait-like photos in workflow topics."""
    return include & ~((category == "photo") & workflow & aspect.between(0.75, 1.4) & (skin >= 0.08))


def accepted(docs: DataFrame, text: str = "text") -> DataFrame:
    """Without the rows whose text holds a disallowed term."""
    return docs.filter(~any_of([F.lower(F.coalesce(text, F.lit(""))).contains(t) for t in C.DISALLOWED_TERMS]))


def limited(text: Column, most: int) -> Column:
    """The first ``most`` characters."""
    return F.substring(text, 1, most)


def oversize_bytes(declared: Column, most: int) -> Column:
    """The declared length where it exceeds the limit, else null; 0 turns the check off."""
    n = declared.try_cast("long")
    return F.when((F.lit(most) > 0) & (n > most), n)


def client_key(user: Column, host: Column) -> Column:
    known = lambda c: F.nullif(strip(c), F.lit(""))
    return F.coalesce(F.concat(F.lit("user:"), known(user)), F.concat(F.lit("ip:"), known(host)), F.lit("ip:unknown"))


def may_read(owner: Column, user: Column, role: Column) -> Column:
    return (owner == user) | (role == "admin")


#: Session variables that name who reads.
READER = {"reader_id": "", "reader_role": ""}


def readable_view(artifacts: DataFrame, name: str) -> None:
    """A temporary view of the rows of ``artifacts`` (owner, ...) that the session's reader may read, as ``may_read``.

    The reader is whom ``SET VARIABLE reader_id`` and ``reader_role`` name; nobody at first. The filter is part of the
    view's plan, so it is pushed down like any other, and SQL alone decides for whom a query runs."""
    spark = artifacts.sparkSession
    for variable, default in READER.items():
        spark.sql(f"DECLARE OR REPLACE VARIABLE {variable} STRING DEFAULT '{default}'")
    artifacts.createOrReplaceTempView(f"{name}_all")
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name} AS SELECT * FROM {name}_all WHERE owner = session.reader_id OR session.reader_role = 'admin'")


def readable_by(spark: SparkSession, view: str, user: str, role: str) -> DataFrame:
    """What one reader sees of a view of ``readable_view``. Variables are read when a query is analysed."""
    spark.sql("SET VARIABLE (reader_id, reader_role) = (SELECT :u, :r)", args={"u": user, "r": role})
    return spark.table(view)
