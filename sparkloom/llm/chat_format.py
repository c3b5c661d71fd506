"""Chat formatting by prefix-target expansion, with DataFrame functions only.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that reply is
trainable. A turn is written ``<|role|>``, a line break, the text, ``<|end|>`` and a line break. In texts ``&`` becomes
``&amp;`` and ``<`` becomes ``&lt;`` (in roles also ``>`` and ``|``), so no text can hold a mark of the template, and
what stands between the marks is read back exactly. The loss mask is a span of code points over the target's text.
Turns after the last assistant turn, or all of a conversation without one, end up in a last example without a target.

An example is one string, and all of its turns meet in one row; the size of an expanded conversation grows with the
square of its turns, as the method asks for.

Defined results: turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own; a
null text or role is empty; a null conv_id is a conversation of its own; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, CLOSE, END, TARGET = "<|", "|>\n", "<|end|>\n", "assistant"
TEXT_ESCAPES = [("&", "&amp;"), ("<", "&lt;")]
ROLE_ESCAPES = [*TEXT_ESCAPES, (">", "&gt;"), ("|", "&#124;")]


def escape(c: Column, pairs: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for raw, safe in pairs:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column, pairs: list[tuple[str, str]] = TEXT_ESCAPES) -> Column:
    for raw, safe in reversed(pairs):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def expand(conversations: DataFrame) -> DataFrame:
    """conv_id, example (from 0), text, loss_start, loss_end (code points, end exclusive; equal without a target)."""
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    whole = conversations.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    written = whole.select(
        "conv_id",
        F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"], ROLE_ESCAPES), F.lit(CLOSE), escape(t["text"]), F.lit(END))).alias("parts"),
        F.transform("turns", lambda t: F.when(t["role"] == TARGET, F.length(escape(t["text"])))).alias("target_chars"),
    )
    # 1-based ends of the examples: each target, and the last turn
    ends = F.expr("filter(sequence(1, size(parts)), i -> target_chars[i - 1] IS NOT NULL OR i = size(parts))")
    exploded = written.select("conv_id", "parts", "target_chars", F.posexplode(ends).alias("example", "upto"))
    text = F.array_join(F.slice("parts", F.lit(1), F.col("upto")), "")
    stop = F.length("text") - F.when(F.col("target").isNull(), 0).otherwise(len(END))
    return exploded.select("conv_id", "example", text.alias("text"), F.expr("target_chars[upto - 1]").alias("target")).select(
        "conv_id", "example", "text", (stop - F.coalesce("target", F.lit(0))).cast("long").alias("loss_start"), stop.cast("long").alias("loss_end")
    )


def read_back(examples: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss (texts under the mask, in order), formatted_chars, from the examples alone."""
    loss = F.when(F.col("loss_end") > F.col("loss_start"), unescape(F.expr("substring(text, cast(loss_start + 1 AS int), cast(loss_end - loss_start AS int))"))).otherwise("")
    by = examples.groupBy("conv_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("example", loss.alias("loss")))), lambda x: x["loss"]).alias("loss"),
        F.max(F.struct("example", "text"))["text"].alias("last"),
        F.sum(F.length("text")).cast("long").alias("formatted_chars"),
    )
    parts = F.filter(F.split("last", r"<\|end\|>\n"), lambda p: p != "")

    def parsed(p: Column) -> Column:
        role = F.substring_index(F.substr(p, F.lit(len(OPEN) + 1)), CLOSE, 1)
        text = F.substr(p, F.length(role) + len(OPEN) + len(CLOSE) + 1)
        return F.struct(unescape(role, ROLE_ESCAPES).alias("role"), unescape(text).alias("text"))

    return by.select("conv_id", F.transform(parts, parsed).alias("turns"), "loss", "formatted_chars")
