"""Slide decks: a file becomes long rows of its parts, which Spark cleans, ranks, caps and gathers into slide records.

Slides come in the order of the presentation, not of their files' names. Shapes inside groups count like others. A task
holds one file, and of its pictures those of one slide.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkloom.functions.rules import is_noise
from sparkloom.functions.text import kept_first, mime_type, slide_title, squeeze
from sparkloom.operators.structure import compact_matrix

_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}Relationship"
RASTER = ("png", "jpg", "jpeg", "webp")
#: Bytes of a picture below which it is left out: on slides, on pages.
SLIDE_BYTES, PAGE_BYTES = 12_000, 8_000
_PARTS = "path string, slide_no int, kind string, pos int, value string, cells array<array<string>>, content binary"


def _targets(z: zipfile.ZipFile, part: str) -> list[tuple[str, str, str]]:
    """id, kind and name of what a part of the package refers to, in order."""
    at = posixpath.join(posixpath.dirname(part), "_rels", f"{posixpath.basename(part)}.rels")
    if at not in z.namelist():
        return []
    found = (x for x in ElementTree.fromstring(z.read(at)).iter(_RELS) if x.get("TargetMode") != "External")
    named = lambda target: posixpath.normpath(posixpath.join("/", posixpath.dirname(part), target))[1:]
    return [(x.get("Id"), x.get("Type", "").rsplit("/", 1)[-1], named(x.get("Target", ""))) for x in found]


def slide_names(z: zipfile.ZipFile) -> list[str]:
    """The slides' parts in presentation order; by number where the presentation does not list them."""
    main = "ppt/presentation.xml"
    if main in z.namelist():
        by_id = {i: name for i, kind, name in _targets(z, main) if kind == "slide"}
        listed = [by_id.get(x.get(f"{_R}id")) for x in ElementTree.fromstring(z.read(main)).iter(f"{_P}sldId")]
        if listed:
            return [n for n in listed if n in z.namelist()]
    numbered = ((re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n), n) for n in z.namelist())
    return [n for _, n in sorted((int(m[1]), n) for m, n in numbered if m)]


def _text(node: ElementTree.Element) -> str:
    return "".join(t.text or "" for t in node.iter(f"{_A}t"))


def slide_parts(z: zipfile.ZipFile, name: str) -> Iterator[tuple[str, str | None, list | None]]:
    """kind, value, cells of a slide: its title, lines, tables and the number of its pictures."""
    tree = ElementTree.fromstring(z.read(name))
    in_tables, titled = {id(p) for t in tree.iter(f"{_A}tbl") for p in t.iter(f"{_A}p")}, False
    for shape in tree.iter(f"{_P}sp"):
        holder = shape.find(f".//{_P}ph")
        lines = [x for p in shape.iter(f"{_A}p") if id(p) not in in_tables and (x := _text(p).strip())]
        if holder is not None and holder.get("type") in ("title", "ctrTitle") and not titled and lines:
            titled = True
            yield "title", " ".join(lines), None
        else:
            yield from (("line", x, None) for x in lines)
    for table in tree.iter(f"{_A}tbl"):
        yield "table", None, [[" ".join(_text(c).split()) for c in row.iter(f"{_A}tc")] for row in table.iter(f"{_A}tr")]
    pictures = sum(1 for _ in tree.iter(f"{_P}pic"))
    if pictures:
        yield "pictures", str(pictures), None


def deck_text(blob: bytes) -> str:
    out, z = [], zipfile.ZipFile(io.BytesIO(blob))
    for no, name in enumerate(slide_names(z), 1):
        out.append(f"[Slide {no}]")
        heads = {"title": "Title: ", "line": "", "pictures": "Visual elements present: "}
        for kind, value, cells in slide_parts(z, name):
            out += [" | ".join(r) for r in cells] if kind == "table" else [heads[kind] + value]
    return "\n".join(out)


def deck_parts(files: DataFrame, max_slides: int = 400) -> DataFrame:
    """path, slide_no, kind, pos, value, cells, content of decks among scanned files: title, line, table, pictures (how many)
    and picture (value: its file name). Files that cannot be read have no rows."""
    kinds = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.string(), pa.list_(pa.list_(pa.string())), pa.binary()]
    names = ["path", "slide_no", "kind", "pos", "value", "cells", "content"]

    def slide(z: zipfile.ZipFile, path: str, no: int, name: str) -> pa.RecordBatch:
        rows = [(path, no, kind, i, value, cells, None) for i, (kind, value, cells) in enumerate(slide_parts(z, name))]
        rows += [(path, no, "picture", i, posixpath.basename(n), None, z.read(n)) for i, (_, kind, n) in enumerate(_targets(z, name)) if kind == "image" and n in z.namelist()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, blob in zip(b.column(0), b.column(1), strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(blob.as_py()))
                    for no, name in enumerate(slide_names(z)[:max_slides], 1):
                        yield slide(z, path.as_py(), no, name)
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue

    return files.filter("suffix = 'pptx'").select("path", "content").mapInArrow(run, _PARTS)


def _stem(path: str = "path"):
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def pictures(parts: DataFrame, *, min_bytes: int = SLIDE_BYTES, per_slide: int = 3, total: int = 240, assess: Callable[[bytes], bool] | None = None) -> DataFrame:
    """path, slide_no, nth, name, mime, sha1, content of the pictures of decks that count: of a raster format, large enough,
    each once on its slide, up to ``per_slide``; slides of a deck give pictures until ``total`` have been given.

    ``assess`` tells from the bytes whether a picture is kept; what it drops leaves its place to the next one."""
    ext = F.lower(F.regexp_extract("value", r"\.([^.]*)$", 1))
    found = parts.filter((F.col("kind") == "picture") & ext.isin(*RASTER) & (F.octet_length("content") >= min_bytes)).select("path", "slide_no", "pos", ext.alias("ext"), F.sha1("content").alias("sha1"), "content")
    if assess is not None:
        found = found.filter(F.udf(lambda c: bool(assess(bytes(c))), "boolean")("content"))
    first = found.withColumn("copy", F.row_number().over(W.partitionBy("path", "slide_no", "sha1").orderBy("pos"))).filter("copy = 1").drop("copy")
    few = first.withColumn("nth", F.row_number().over(W.partitionBy("path", "slide_no").orderBy("pos"))).filter(F.col("nth") <= per_slide)
    counts = few.groupBy("path", "slide_no").agg(F.count(F.lit(1)).alias("here"))
    before = counts.withColumn("before", F.sum("here").over(W.partitionBy("path").orderBy("slide_no")) - F.col("here")).filter(F.col("before") < total).select("path", "slide_no")
    name = F.concat(_stem(), F.lit(" - Slide "), "slide_no", F.lit(" - Figure "), "nth", F.lit("."), "ext")
    return few.join(before, ["path", "slide_no"]).select("path", "slide_no", "nth", name.alias("name"), mime_type(F.col("ext")).alias("mime"), "sha1", "content")


def slide_records(parts: DataFrame, **caps) -> DataFrame:
    """path, slide_no, title, lines, tables, images of (``deck_parts``); slides without any of them are left out.

    Lines are squeezed, without markers of bold type, noise, repeats and the title itself; tables are rectangular, without
    empty rows and columns, and have two rows and two columns at least. ``caps`` are those of ``pictures``."""
    plain = squeeze(F.regexp_replace(squeeze(F.col("value")), r"\*{2,}", " "))
    rows = parts.filter("kind <> 'picture'").groupBy("path", "slide_no").agg(
        F.coalesce(slide_title(F.first(F.when(F.col("kind") == "title", F.col("value")), ignorenulls=True)), F.lit("")).alias("title"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "line", F.struct("pos", plain.alias("x"))))).alias("lines"),
        F.sort_array(F.collect_list(F.when(F.col("kind") == "table", F.struct("pos", compact_matrix(F.col("cells")).alias("x"))))).alias("tables"),
    )
    shown = F.filter(F.transform("lines", lambda x: x["x"]), lambda x: (x != "") & ~is_noise(x) & (F.lower(x) != F.lower("title")))
    wide = F.filter(F.transform("tables", lambda x: x["x"]), lambda t: t.isNotNull())
    texts = rows.select("path", "slide_no", "title", kept_first(shown, F.lower).alias("lines"), wide.alias("tables"))
    images = pictures(parts, **caps).groupBy("path", "slide_no").agg(F.sort_array(F.collect_list(F.struct("nth", "name", "mime", "content"))).alias("i"))
    images = images.select("path", "slide_no", F.transform("i", lambda x: F.struct(x["name"].alias("name"), x["mime"].alias("mime"), x["content"].alias("content"))).alias("images"))
    none = F.expr("cast(array() AS array<struct<name: string, mime: string, content: binary>>)")
    empty = {"title": F.lit(""), "lines": F.expr("cast(array() AS array<string>)"), "tables": F.expr("cast(array() AS array<array<array<string>>>)"), "images": none}
    both = texts.join(images, ["path", "slide_no"], "full").select("path", "slide_no", *(F.coalesce(c, e).alias(c) for c, e in empty.items()))
    return both.filter("title <> '' OR size(lines) > 0 OR size(tables) > 0 OR size(images) > 0")


def workspace_images(files: DataFrame, *, most: int = 12, page_images: Callable[[bytes], list[tuple[str, bytes]]] | None = None, **caps) -> DataFrame:
    """path, name, mime, sha1, content of up to ``most`` pictures of scanned decks and, by ``page_images`` (bytes of a PDF to
    names and contents of its pictures in order), of pages; in the order of paths. Pictures of pages come once in all."""
    slides = pictures(deck_parts(files), **({"total": most} | caps)).select("path", F.col("slide_no").alias("a"), F.col("nth").alias("b"), "name", "mime", "sha1", "content")
    found = slides
    if page_images is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for path, blob in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    own = [(path, i, n, c) for i, (n, c) in enumerate(page_images(blob.as_py()), 1) if len(c) >= PAGE_BYTES]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*own, strict=True) if own else [[]] * 4, (pa.string(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["path", "nth", "name", "content"])

        pages = files.filter("suffix = 'pdf'").select("path", "content").mapInArrow(run, "path string, nth int, name string, content binary")
        given = F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1))
        ext = F.when(given.isin(*RASTER), given).otherwise("png")
        pages = pages.select("path", F.lit(0).alias("a"), F.col("nth").alias("b"), F.concat(_stem(), F.lit(" - Visual "), "nth", F.lit("."), ext).alias("name"), mime_type(ext).alias("mime"), F.sha1("content").alias("sha1"), "content")
        first = pages.withColumn("copy", F.row_number().over(W.partitionBy("sha1").orderBy("path", "b"))).filter("copy = 1").drop("copy")
        found = slides.unionByName(first.join(slides.select("sha1").distinct(), "sha1", "left_anti"))
    return found.orderBy("path", "a", "b").limit(most).select("path", "name", "mime", "sha1", "content")
