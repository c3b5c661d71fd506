"""Features of images from their pixels, in Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.config import DEFAULT, Images

FEATURES = T.StructType([T.StructField(n, T.DoubleType() if n in ("detail", "transparency", "skin") else T.IntegerType()) for n in ("width", "height", "colors", "detail", "transparency", "skin", "variety")])
#: Luma weights of red, green and blue in 1 / 65,536.
GREY = np.array([19595, 38470, 7471], np.int64)


def reduced(pixels: np.ndarray, edge: int) -> np.ndarray:
    """The image (height, width, channels) scaled down to fit ``edge`` by averages over areas; never scaled up.

    Sums along each axis are read off running sums, at places between pixels where an area's edge lies inside one."""
    height, width = pixels.shape[:2]
    scale = edge / max(height, width)
    if scale >= 1:
        return pixels
    out = pixels.astype(np.float64)
    for axis, size in ((0, height), (1, width)):
        n = max(1, round(size * scale))
        sums = np.concatenate((np.zeros_like(out.take([0], axis)), np.cumsum(out, axis)), axis)
        edges = np.arange(n + 1) * (size / n)
        low = np.minimum(edges.astype(int), size - 1)
        share = (edges - low).reshape([-1 if k == axis else 1 for k in range(out.ndim)])
        at = sums.take(low, axis) * (1 - share) + sums.take(low + 1, axis) * share
        out = np.diff(at, axis=axis) / (size / n)
    return np.floor(out + 0.5).clip(0, 255).astype(np.uint8)


def features(pixels: np.ndarray, i: Images = DEFAULT.images) -> dict[str, float]:
    """Of an array (height, width, 3 or 4; red, green, blue, alpha). Colours, skin and transparency are measured on a
    thumbnail, detail on the central crop at native size, where edges are as sharp as they were made."""
    height, width = pixels.shape[:2]
    none = {"width": width, "height": height, "colors": 0, "detail": 0.0, "transparency": 0.0, "skin": 0.0, "variety": 0}
    if not pixels.size:
        return none
    rgb, clear = pixels[..., :3], 0.0
    if pixels.shape[-1] == 4:
        clear = float((reduced(pixels[..., 3:], i.thumbnail_edge) < i.clear_alpha).mean())
        share = pixels[..., 3:].astype(np.float64) / 255
        rgb = np.floor(rgb * share + 255 * (1 - share) + 0.5).astype(np.uint8)  # on white, so clear pixels are not dark ones
    top, left = max(0, (height - i.detail_crop) // 2), max(0, (width - i.detail_crop) // 2)
    grey = ((rgb[top : top + i.detail_crop, left : left + i.detail_crop].astype(np.int64) @ GREY + 32768) >> 16).astype(np.float32)
    detail = float(np.clip(np.hypot(*np.gradient(grey)).mean() / 255, 0, 1)) if min(grey.shape) > 1 else 0.0
    some = reduced(rgb, i.thumbnail_edge).astype(np.int16).reshape(-1, 3)
    r, g, b = some.T
    # bounds of skin tones in red, green and blue
    skin = (r > 95) & (g > 40) & (b > 20) & (some.max(axis=1) - some.min(axis=1) > 15) & (np.abs(r - g) > 15) & (r > g) & (r > b)
    return none | {
        "colors": len(np.unique(some // i.color_step, axis=0)),
        "detail": round(detail, 4),
        "transparency": round(clear, 4),
        "skin": round(float(skin.mean()), 4),
        "variety": len(np.unique(some[skin] // i.skin_step, axis=0)),
    }


def orientation(head: bytes) -> int:
    """The orientation that a JPEG file's header names, 1 to 8; 1 where it names none."""
    at = 2
    if head[:2] != b"\xff\xd8":
        return 1
    while at + 4 <= len(head) and head[at] == 0xFF and head[at + 1] not in (0xDA, 0xD9):
        size = int.from_bytes(head[at + 2 : at + 4], "big")
        body = head[at + 4 : at + 2 + size]
        if head[at + 1] == 0xE1 and body[:6] == b"Exif\0\0":
            tiff = body[6:]
            order = {b"II": "little", b"MM": "big"}.get(tiff[:2])
            if order is None:
                return 1
            number = lambda p, n: int.from_bytes(tiff[p : p + n], order)
            first = number(4, 4)
            for k in range(number(first, 2)):
                entry = first + 2 + 12 * k
                if number(entry, 2) == 0x0112:
                    value = number(entry + 8, 2)
                    return value if 1 <= value <= 8 else 1
            return 1
        at += 2 + size
    return 1


def turned(pixels: np.ndarray, how: int) -> np.ndarray:
    """Pixels as they are to be seen, by the header's orientation."""
    if how in (2, 3):
        pixels = pixels[:, ::-1]
    if how in (3, 4):
        pixels = pixels[::-1]
    if how >= 5:
        pixels = pixels.swapaxes(0, 1)
        if how in (6, 7):
            pixels = pixels[:, ::-1]
        if how in (7, 8):
            pixels = pixels[::-1]
    return pixels


def _decoded(height: int, width: int, channels: int, data: bytes) -> np.ndarray:
    """Pixels as Spark's image source holds them: blue, green, red and, with four channels, alpha."""
    if height <= 0 or width <= 0 or channels not in (1, 3, 4):
        return np.zeros((max(0, height), max(0, width), 3), np.uint8)[:0, :0]
    raw = np.frombuffer(data, np.uint8).reshape(height, width, channels)
    return np.repeat(raw, 3, axis=2) if channels == 1 else raw[..., [2, 1, 0, *range(3, channels)]]


@F.pandas_udf(FEATURES)
def image_features(images: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of structs of height, width, nChannels and data, as ``spark.read.format("image")`` has them, and perhaps
    ``turn``, the header's orientation; a file that is no image has no size."""
    for batch in images:
        turns = batch["turn"].fillna(1) if "turn" in batch else [1] * len(batch)
        rows = zip(batch["height"], batch["width"], batch["nChannels"], batch["data"], turns, strict=True)
        yield pd.DataFrame([features(turned(_decoded(*row[:4]), int(row[4]))) for row in rows], columns=FEATURES.names)


@F.pandas_udf(T.IntegerType())
def _turns(heads: pd.Series) -> pd.Series:
    return heads.map(orientation)


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, colors, detail, transparency, skin, variety of the images below ``path``, as they are to be seen.

    Spark's image source decodes pixels but not headers; the files' first 64 KB tell the orientation."""
    found = spark.read.format("image").option("recursiveFileLookup", True).load(path)
    found = found.select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), "image.height", "image.width", "image.nChannels", "image.data")
    heads = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_replace("path", "^file:/+", "file:/").alias("path"), F.substring("content", 1, 65_536).alias("head"))
    turns = heads.filter(F.substring("head", 1, 2) == F.lit(b"\xff\xd8")).select("path", _turns("head").alias("turn")).filter("turn > 1")
    both = found.join(turns, "path", "left")
    return both.select("path", image_features(F.struct("height", "width", "nChannels", "data", F.coalesce("turn", F.lit(1)).alias("turn"))).alias("f")).select("path", "f.*")
