"""Text functions as column expressions; everything stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom import config as C
from sparkloom.config import DEFAULT


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def kept_first(found: Column, key: Callable[[Column], Column]) -> Column:
    """The first element of each key, in order: a sort by key and place, no shuffle and no search per element."""
    keyed = lambda f: F.array_sort(F.transform(f, lambda x, i: F.struct(F.coalesce(key(x), F.lit("")).alias("k"), i.alias("i"))))
    firsts = lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)["k"] != x["k"]))
    return let(found, lambda f: let(keyed(f), lambda s: F.transform(F.array_sort(F.transform(firsts(s), lambda x: x["i"])), lambda i: F.get(f, i))))


def strip(c: Column) -> Column:
    """Without white space at either end (trim only knows spaces)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"\s+", " "))


def tokens(c: Column, least: int = DEFAULT.ranking.min_token) -> Column:
    """Lower-case ASCII word tokens of at least ``least`` characters, with repetitions."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"[a-z0-9_]{{{least},}}"), F.lit(0))


def token_set(c: Column) -> Column:
    return F.array_distinct(tokens(c))


def windows(c: Column, size: int, overlap: int) -> Column:
    """Array of overlapping character windows; a text up to ``size`` is one window."""
    step = size - overlap
    n = F.when(F.length(c) <= size, F.lit(1)).otherwise(1 + F.ceil((F.length(c) - size) / F.lit(step)).cast("int"))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substr(c, i * step + 1, F.lit(size)))


def pack_paragraphs(c: Column, size: int, overlap: int) -> Column:
    """Packs paragraphs into chunks of up to ``size`` joined by a blank line; an oversize paragraph is cut into windows.

    Where chunks begin is found first, from lengths alone; then each chunk's paragraphs are sliced and joined once."""
    lines = F.array_join(F.transform(F.split(c, "\n"), strip), "\n")
    paras = F.filter(F.transform(F.split(strip(lines), "\n{2,}"), strip), lambda p: p != "")
    empty = F.struct(F.expr("cast(array() AS array<int>)").alias("starts"), F.lit(size).alias("open"), F.lit(0).alias("i"))

    def step(s: Column, n: Column) -> Column:  # ``open``: characters of the open chunk; ``size`` where nothing fits
        joined = s["open"] + 2 + n
        fits = joined <= size
        return F.struct(F.when(fits, s["starts"]).otherwise(F.concat(s["starts"], F.array(s["i"]))).alias("starts"), F.when(fits, joined).otherwise(F.least(n, F.lit(size))).alias("open"), (s["i"] + 1).alias("i"))

    def chunk(p: Column, starts: Column, at: Column, k: Column) -> Column:
        upto = F.coalesce(F.get(starts, k + 1), F.size(p))
        return let(F.array_join(F.slice(p, at + 1, upto - at), "\n\n"), lambda t: F.when(F.length(t) > size, windows(t, size, overlap)).otherwise(F.array(t)))

    starts = lambda p: F.aggregate(F.transform(p, F.length), empty, step, lambda s: s["starts"])
    return let(paras, lambda p: let(starts(p), lambda s: F.flatten(F.transform(s, lambda at, k: chunk(p, s, at, k)))))


def clip_on_word(c: Column, most: int, trailing: str = r" ,;:\-–—", mark: str = "…") -> Column:
    """At most ``most`` characters, cut before the last space among them, with a mark where something went."""
    cut = F.regexp_replace(F.regexp_replace(F.substr(c, F.lit(1), F.lit(most)), r" [^ ]*$", ""), f"[{trailing}]+$", "")
    return F.when(F.length(c) <= most, c).otherwise(F.concat(cut, F.lit(mark)))


def slide_title(c: Column, most: int = 100) -> Column:
    """What follows the last ``topic:`` if that is four characters or more, without dashes and bars around it, clipped."""
    whole = squeeze(F.coalesce(c, F.lit("")))
    last = strip(F.regexp_replace(whole, r"(?i)^.*\btopic\s*:", ""))
    named = F.when(F.length(last) >= 4, last).otherwise(whole)
    return clip_on_word(F.regexp_replace(named, r"^[ \-–—:|]+|[ \-–—:|]+$", ""), most)


def heading_key(c: Column) -> Column:
    """Comparable form of a heading: ordinals joined, everything but letters and digits a single space."""
    joined = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\b(\d{1,3})\s+(st|nd|rd|th)\b", "$1$2")
    return F.trim(F.regexp_replace(joined, r"[^a-z0-9]+", " "))


def count_of(text: Column, word: Column) -> Column:
    """How often a literal occurs, without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def occurs_alone(text: Column, term: str) -> Column:
    """Whether ``term`` occurs between characters that are neither word characters nor hyphens, in either case."""
    import re

    return text.rlike(rf"(?i)(^|[^\w-]){re.escape(term)}($|[^\w-])")


def xml_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def emphasis_tags(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(xml_escape(c), r"\*\*(.+?)\*\*", "<b>$1</b>"), r"\*(.+?)\*", "<i>$1</i>")


def caption_subject(c: Column, most: int = 72) -> Column:
    """First sentence of a section title without its end mark, clipped on a word."""
    plain = strip(F.regexp_replace(squeeze(c), r":+$", ""))
    first = strip(F.regexp_replace(strip(F.element_at(F.split(plain, r"(?<=[.!?])\s"), 1)), r"\.+$", ""))
    return clip_on_word(first, most, r",;:\-", "...")


def mime_type(ext: Column) -> Column:
    known = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "bmp": "image/bmp", "webp": "image/webp", "tif": "image/tiff", "tiff": "image/tiff"}
    table = F.create_map(*[F.lit(x) for p in known.items() for x in p])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_replace(ext, r"^\.", ""))), F.lit("application/octet-stream"))


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def base64_bytes(c: Column) -> Column:
    """The bytes of Base64 text, with or without a data URI's head; null where it is not valid."""
    return F.try_to_binary(strip(F.regexp_replace(c, r"(?s)^.*?base64,", "")), F.lit("base64"))


def setting_list(c: Column) -> Column:
    """The parts of a comma-separated setting: stripped, empty ones out."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), strip), lambda x: x != "")


def is_conversational(c: Column) -> Column:
    """Reported speech, unknown numbers of days or a list of names."""
    low = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    spoken = F.exists(F.array(*[F.lit(m) for m in C.CONVERSATIONAL]), low.contains)
    return spoken | low.rlike(C.LETTER_DAYS) | c.rlike(C.NAME_LIST)


def clean_sentence(c: Column) -> Column:
    """Without bracketed tags, scores and slide references."""
    for tag in C.SENTENCE_TAGS:
        c = F.regexp_replace(c, tag, "")
    return F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ \-:]+|[ \-:]+$", "")


def fragments(c: Column, least: int = 35, most: int = 280) -> Column:
    """Sentences and list parts of a fitting length that state something: no questions, leftovers or reported speech."""
    parts = F.transform(F.split(c, r"\n+|(?<=[.!?])\s+|\s+[|]\s+|;\s+"), clean_sentence)

    def states(x: Column) -> Column:
        low = F.lower(x)
        leftover = low.startswith("author | department") | low.contains(" x days") | low.contains("lead time: x")
        return F.length(x).between(least, most) & ~x.endswith("?") & ~leftover & ~is_conversational(x)

    return F.filter(parts, states)


def fragment_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_]+", " "))


def distinct_fragments(found: Column) -> Column:
    return kept_first(found, fragment_key)


def prose(found: Column, most: int, group: int = 2) -> Column:
    """Paragraphs of ``group`` fragments each, from the first ``most``."""
    return let(F.slice(found, 1, most), lambda f: F.when(F.size(f) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(f) - 1) / group).cast("int")), lambda k: F.array_join(F.slice(f, k * group + 1, F.lit(group)), " "))).otherwise(F.expr("cast(array() AS array<string>)")))


def is_instruction(c: Column) -> Column:
    """Whether a title reads like a request to the tool; so does one without words."""
    words, hits = F.regexp_count(c, F.lit("[A-Za-z]+")), F.regexp_count(c, F.lit(C.INSTRUCTION))
    return (words == 0) | (hits >= 2) | ((hits >= 1) & (words <= 4))


def title_fragment(c: Column) -> Column:
    """A candidate title without slide ranges, names of formats and filler punctuation."""
    plain = F.regexp_replace(F.regexp_replace(c, C.SLIDE_RANGE, " "), C.SOURCE_WORD, " ")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(plain, r"[_\-]+", " "), r"\s{2,}", " "), r"^[ \-–—,:;.\t]+|[ \-–—,:;.\t]+$", "")


def document_title(candidates: Column, suffix: str = " — Technical Documentation", default: str = "Technical Reference Documentation") -> Column:
    """The first candidate that names a subject, capitalised; a default for none."""
    able = F.filter(F.transform(candidates, title_fragment), lambda x: F.length(x).between(3, 90) & ~is_instruction(x))
    named = let(F.get(able, F.lit(0)), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substr(x, F.lit(2)), F.when(x.rlike(r"(?i)\b(documentation|manual|handbook|guide|reference)\b"), F.lit("")).otherwise(F.lit(suffix))))
    return F.coalesce(named, F.lit(default))


def table_cells(line: Column) -> Column:
    """Cells of a Markdown table row."""
    return F.transform(F.split(F.regexp_replace(strip(line), r"^\|+|\|+$", ""), r"\|"), strip)


def is_table_row(line: Column) -> Column:
    return line.startswith("|") & line.endswith("|") & (F.regexp_count(line, F.lit(r"\|")) >= 3)


def is_table_divider(line: Column) -> Column:
    return F.forall(table_cells(line), lambda c: c.rlike(r"^:?-{2,}:?$"))


def looks_like_heading(line: Column) -> Column:
    """A label that ends with a colon: short, few words, no sentence inside."""
    s = strip(F.regexp_replace(line, ":+$", ""))
    return line.endswith(":") & F.length(s).between(1, 80) & (F.size(F.split(s, r"\s+")) <= 12) & ~s.rlike(r"[.!?](\s|$)")
