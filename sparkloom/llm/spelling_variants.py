"""Spelling variants by an even-partition pigeonhole join.

Words are counted over all texts; two words are near when one code point inserted, deleted or replaced turns one into
the other. A word is cut into two segments of even length, which depends on its length alone. One edit lies in one of
them, so the other one is whole in both words: in place for a word of equal length, moved by one where it stands after
the letter that the longer word has more. The segment that holds the edit is cut in two by the same rule, and one of
its halves is whole too. A key is what is whole, the segment and the half: every word is indexed under its own four
keys and probes with eight, four for words of its length and four for words one shorter. Words that merely share a
frequent segment do not meet, so a bucket holds words that agree in all but a quarter of their letters.

Candidates are verified (distance 1), then each pair is kept once. The form of a word is its near word of largest
count (ties: the smallest in code-point order) if that is ``factor`` times its own at least. Counts grow along forms,
so there is no cycle, and a chain has at most log(N) / log(factor) words; its end is found by doubling steps, each a
join of written tables.

Everything is DataFrame functions; counts are summed in the tasks before words are shuffled, so a word that holds a
third of all rows is a row per task. Keys are hashes, which only add candidates. All joins are sort-merge joins by
hint: Spark sizes a table by its compressed files, and what is exploded from it no larger, so it would broadcast
millions of keys from a table of a few MB.

Defined results: null and empty texts have no words; a null doc_id reads as the empty text in the noise rule; repeated
rows count again; an empty table gives no rows; further columns are ignored. Ties are stated above.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import drop_written, written

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(docs: DataFrame, *, noise: int | None = 97, least_chars: int = 5, least_n: int = 3) -> DataFrame:
    """word, n of the runs of letters. Where ``noise`` divides h, the crc32 of ``doc_id:run``, the letter h % length goes."""
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), F.lit(0))).alias("run"))
    low = found.select("id", F.when(F.col("run").rlike("[A-Z]"), F.translate("run", UPPER, LOWER)).otherwise(F.col("run")).alias("run"))
    if noise is None:
        named = low.select(F.col("run").alias("word"))
    else:
        h = F.crc32(F.concat_ws(":", "id", "run"))
        at = (F.col("h") % F.length("run")).cast("int")
        cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
        named = low.select("run", h.alias("h")).select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word"))
    return named.filter(F.length("word") >= least_chars).groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_n)


def _keys(length: Column, longer: int) -> Column:
    """Hashes of (length, quarter, what stands before it, what stands after it), for each quarter that may hold the edit.

    The cuts are those of a word of ``length``; the word itself has ``longer`` letters more, in the open quarter."""
    middle = F.floor(length / 2).cast("int")
    cuts = [F.lit(0), F.floor(middle / 2).cast("int"), middle, middle + F.floor((length - middle) / 2).cast("int"), length]
    word = F.col("word")
    return F.array(*[F.xxhash64(length, F.lit(e), F.substr(word, F.lit(1), cuts[e]), F.substr(word, cuts[e + 1] + (1 + longer))) for e in range(4)])


def near_pairs(counted: DataFrame) -> DataFrame:
    """a, a_n, b, b_n: each pair of near words of (word, n) once; b is longer, or of equal length and greater."""
    sized = counted.select("word", "n", F.length("word").alias("len"))
    index = sized.select(F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("len").alias("a_len"), F.explode(_keys(F.col("len"), 0)).alias("key"))
    asked = F.concat(_keys(F.col("len"), 0), _keys(F.col("len") - 1, 1))
    probe = sized.select(F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("len").alias("b_len"), F.explode(asked).alias("key"))
    apart = (F.col("a_len") < F.col("b_len")) | ((F.col("a_len") == F.col("b_len")) & (F.col("a") < F.col("b")))
    met = index.hint("merge").join(probe, (index["key"] == probe["key"]) & apart & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "a_n", "b", "b_n").distinct()


def forms(counted: DataFrame, *, factor: int = 2) -> DataFrame:
    """word, n, n_near, form, form_n of every word of (word, n)."""
    pairs = near_pairs(counted)
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("minus"), F.col("b").alias("near")).alias("other")), F.struct(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("minus"), F.col("a").alias("near")).alias("other"))))
    best = pairs.select(both.alias("x")).select("x.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("other").alias("best"))
    able = -F.col("best.minus") >= factor * F.col("n")
    return counted.join(best.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(able, F.col("best.near")).alias("form"), F.when(able, -F.col("best.minus")).alias("form_n"))


def _roots(linked: DataFrame) -> DataFrame:
    """word, root of words that have a form: every step doubles how far each word has come, until none moves."""
    at = written(linked.select("word", F.col("form").alias("root")))
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        drop_written(at)
        at = moved
        if not at.filter("moved").limit(1).count():
            return at.select("word", "root")


def spelling_variants(docs: DataFrame, *, noise: int | None = 97, least_chars: int = 5, least_n: int = 3, factor: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word with ``least_n`` occurrences."""
    counted = written(words(docs, noise=noise, least_chars=least_chars, least_n=least_n))
    formed = written(forms(counted, factor=factor))
    drop_written(counted)
    roots = _roots(formed.filter("form IS NOT NULL"))
    return formed.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
