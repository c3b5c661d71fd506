"""Choice of files, image triage and evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.config import DEFAULT, Images
from sparkloom.functions.text import strip, token_set


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matches_hint(path: Column, hints: Column) -> Column:
    """A hint is the file's name, or part of its path once separators are unified; case does not count."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    return F.exists(hints, lambda h: (base_name(low) == F.lower(h)) | low.contains(F.lower(F.replace(h, F.lit("\\"), F.lit("/")))))


def trim_base64(c: Column) -> Column:
    return strip(F.regexp_replace(c, r"(?s)^.*?base64,", ""))


def select_files(files: DataFrame, prompt: str, hints: list[str], k: int = DEFAULT.ranking.max_docs) -> DataFrame:
    """path, score of the best ``k``: words shared with the prompt, 5 per matched hint, 1 for decks and PDFs. Hinted files
    alone when there are any; without a positive score the first ones."""
    given = F.array(*[F.lit(h) for h in hints]) if hints else F.expr("cast(array() AS array<string>)")
    shared = F.size(F.array_intersect(token_set(base_name(F.col("path"))), token_set(F.lit(prompt))))
    part = F.size(F.filter(given, lambda h: (h != "") & F.lower("path").contains(F.lower(h))))
    named = F.exists(given, lambda h: (F.trim(h) != "") & matches_hint(F.col("path"), F.array(F.trim(h))))
    score = shared + 5 * part + F.when(F.lower("path").rlike(r"\.(pptx|pdf)$"), 1).otherwise(0)
    scored = files.select("path", score.alias("score"), named.alias("hinted"))
    flagged = scored.join(F.broadcast(scored.agg(F.bool_or("hinted").alias("some_hinted"))), how="cross").filter(~F.col("some_hinted") | F.col("hinted"))
    return flagged.orderBy(F.desc("score"), "path").limit(k).select("path", "score")


def triage(i: Images = DEFAULT.images) -> dict[str, Column]:
    """category and include of image features (width, height, colors, detail, transparency, skin, variety), in order."""
    w, h = F.col("width"), F.col("height")
    aspect = F.greatest(w, h) / F.greatest(F.least(w, h), F.lit(1))
    portrait = (F.col("skin") >= i.skin_ratio) & (F.col("variety") >= i.skin_variety) & (w / F.greatest(h, F.lit(1))).between(*i.portrait_aspect) & (F.col("detail") < i.diagram_detail)
    category = (
        F.when((w <= 0) | (h <= 0), "undecodable")
        .when((F.least(w, h) < i.min_side) | (w * h < i.min_area), "icon")
        .when(aspect > i.max_aspect, "banner")
        .when(portrait, "portrait")
        .when(((F.col("colors") <= i.flat_colors) | (F.col("transparency") >= i.flat_transparency)) & (F.col("detail") < i.min_detail), "decorative")
        .when(F.col("detail") >= i.diagram_detail, "diagram")
        .otherwise("photo")
    )
    return {"category": category, "include": category.isin("diagram", "photo")}


def triage_precision(verdicts: DataFrame) -> DataFrame:
    """kept, total, precision of (include): the share of images that the cascade keeps, to four places."""
    return verdicts.agg(F.count_if("include").alias("kept"), F.count(F.lit(1)).alias("total")).withColumn("precision", F.coalesce(F.bround(F.try_divide("kept", "total"), 4), F.lit(0.0)))


def display_size(width: Column, height: Column, most_w: float = 400.0, most_h: float = 220.0, dpi: float = 96.0) -> Column:
    """Width and height in points: the native size, shrunk to the box, never enlarged."""
    w, h = width * F.lit(72.0 / dpi), height * F.lit(72.0 / dpi)
    scale = F.least(F.lit(1.0), F.lit(most_w) / w, F.lit(most_h) / h)
    return F.struct((w * scale).alias("width_pt"), (h * scale).alias("height_pt"))


def merge_images(primary: DataFrame, secondary: DataFrame, most: int = 12) -> DataFrame:
    """Images (pos, name, content) of both lists, primary first, one of each name, head and length; contents are Base64
    with or without a data URI's head."""
    both = primary.withColumn("list", F.lit(0)).unionByName(secondary.withColumn("list", F.lit(1)))
    body = trim_base64(F.col("content"))
    same = W.partitionBy(F.lower("name"), F.substring(body, 1, 64), F.length(body)).orderBy("list", "pos")
    return both.withColumn("nth", F.row_number().over(same)).filter("nth = 1").orderBy("list", "pos").limit(most).select("list", "pos", "name", "content")


def evidence(ranked: DataFrame, sources: int = 6, per_source: int = 5, preview: int = 420) -> DataFrame:
    """source_rank, source, nth, preview of the best sources by their best score and their first chunks (source, rank,
    score, text)."""
    best = ranked.groupBy("source").agg(F.max("score").alias("best")).orderBy(F.desc(F.round("best", 9)), "source").limit(sources)
    top = best.withColumn("source_rank", F.row_number().over(W.orderBy(F.desc(F.round("best", 9)), "source"))).drop("best")
    nth = F.row_number().over(W.partitionBy("source").orderBy("rank"))
    return ranked.join(F.broadcast(top), "source").withColumn("nth", nth).filter(F.col("nth") <= per_source).select("source_rank", "source", "nth", F.substring("text", 1, preview).alias("preview"))
