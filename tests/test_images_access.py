import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import rules
from sparkloom.operators import files, index, structure
from sparkloom.operators.images import FEATURES, features, orientation, reduced, turned


def test_reduction_averages_areas_and_never_scales_up():
    rng = np.random.default_rng(0)
    small = rng.integers(0, 256, (30, 50, 3)).astype(np.uint8)
    assert reduced(small, 192) is small
    big = rng.integers(0, 256, (400, 300, 3)).astype(np.uint8)
    got = reduced(big, 100)
    assert got.shape == (100, 75, 3)
    want = big.reshape(100, 4, 75, 4, 3).mean(axis=(1, 3))
    assert np.abs(got - want).max() <= 0.5 + 1e-9
    odd = reduced(np.arange(1000, dtype=np.uint8).reshape(10, 100, 1) % 7, 33)  # areas that begin and end inside pixels
    assert odd.shape == (3, 33, 1) and odd.max() <= 6
    assert reduced(np.full((1000, 1, 3), 9, np.uint8), 192).shape == (192, 1, 3)


def jpeg_head(value, order="<"):
    tiff = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8) + struct.pack(order + "H", 2)
    tiff += struct.pack(order + "HHIHH", 0x010F, 3, 1, 7, 0) + struct.pack(order + "HHIHH", 0x0112, 3, 1, value, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF" + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda"


def test_orientation_of_headers():
    assert [orientation(jpeg_head(k, o)) for k in (1, 3, 6, 8) for o in "<>"] == [1, 1, 3, 3, 6, 6, 8, 8]
    assert [orientation(x) for x in (b"", b"\x89PNG", b"\xff\xd8", b"\xff\xd8\xff\xe1\0", jpeg_head(9), jpeg_head(6)[:20])] == [1] * 6


def test_turns_are_those_of_the_standard():
    p = np.arange(6).reshape(2, 3, 1)
    flat = lambda k: turned(p, k)[..., 0].tolist()
    assert flat(1) == [[0, 1, 2], [3, 4, 5]] and flat(2) == [[2, 1, 0], [5, 4, 3]] and flat(3) == [[5, 4, 3], [2, 1, 0]] and flat(4) == [[3, 4, 5], [0, 1, 2]]
    assert flat(5) == [[0, 3], [1, 4], [2, 5]] and flat(6) == [[3, 0], [4, 1], [5, 2]] and flat(7) == [[5, 2], [4, 1], [3, 0]] and flat(8) == [[2, 5], [1, 4], [0, 3]]


def shaded(height, width):
    """A smooth area of skin tones with many shades."""
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([170 + 60 * y / height, 90 + 50 * x / width, 60 + 30 * y / height], axis=2).astype(np.uint8)


@pytest.mark.parametrize(
    ("pixels", "category"),
    [
        (np.full((60, 300, 3), 9), "icon"),
        (np.full((101, 900, 3), 9), "banner"),
        (shaded(300, 260), "portrait"),
        (np.full((300, 400, 3), (230, 120, 40)), "decorative"),  # one orange is no face
        (np.random.default_rng(1).integers(0, 256, (300, 400, 3)), "diagram"),
        (np.repeat(np.linspace(0, 255, 400)[None, :, None], 300, 0).repeat(3, 2), "decorative"),  # 11 greys
        (np.concatenate((np.full((300, 400, 3), 90), np.repeat((np.arange(400) < 160)[None, :, None] * 255, 300, 0)), 2), "decorative"),  # mostly clear
    ],
)
def test_categories_from_pixels(spark, pixels, category):
    f = features(pixels.astype(np.uint8))
    row = spark.createDataFrame([tuple(float(f[n]) if t in ("detail", "transparency", "skin") else int(f[n]) for n, t in zip(FEATURES.names, FEATURES.names, strict=True))], FEATURES)
    assert row.select(files.triage()["category"].alias("c")).first().c == category, f


def test_a_turned_photograph_has_the_sides_that_are_seen():
    wide = np.random.default_rng(2).integers(0, 256, (200, 700, 3)).astype(np.uint8)
    f, g = features(wide), features(turned(wide, 6))
    assert (f["width"], f["height"], g["width"], g["height"]) == (700, 200, 200, 700) and abs(f["detail"] - g["detail"]) < 0.01


def test_a_view_shows_what_its_reader_may_read(spark):
    rows = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u1"), (4, None)], "artifact_id int, owner string")
    rules.readable_view(rows, "shown")
    see = lambda: sorted(r.artifact_id for r in spark.sql("SELECT * FROM shown").collect())
    assert see() == []
    spark.sql("SET VARIABLE reader_id = 'u1'")
    assert see() == [1, 3] and spark.sql("SELECT count(*) FROM shown WHERE artifact_id > 1").first()[0] == 1
    spark.sql("SET VARIABLE (reader_id, reader_role) = (SELECT 'x', 'admin')")
    assert see() == [1, 2, 3, 4]
    spark.sql("SET VARIABLE reader_role = 'editor'")
    assert see() == []
    for user, role in (("u2", "editor"), ("o'neil", "viewer"), ("any", "admin")):
        want = sorted(r.artifact_id for r in rows.filter(rules.may_read(F.col("owner"), F.lit(user), F.lit(role))).collect())
        assert sorted(r.artifact_id for r in rules.readable_by(spark, "shown", user, role).collect()) == want


def test_repetition_of_a_document(spark):
    text = "# A\n\n## Part\n\nThis sentence is long enough to be counted here. Short one. This  sentence is long enough to be COUNTED here.\n\n[[IMAGE: x]]\n\n[[IMAGE: x]]\n\n## part\n\n| a | b |\n\nshort"
    got = {r.kind: (r.total, r.unique_units, r.extra) for r in structure.document_repetition(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string")).collect()}
    assert got == {"paragraph": (8, 6, 2), "heading": (3, 2, 1), "figure": (2, 1, 1), "sentence": (2, 1, 1)}


def test_chunks_without_a_common_token_come_last(spark):
    keys = spark.createDataFrame([(d, c) for d in range(4) for c in range(2)], "doc_id long, chunk_no int")
    top = spark.createDataFrame([(1, 3, 0, 2.0, 1), (1, 0, 1, 1.0, 2)], "qid long, doc_id long, chunk_no int, score double, rank int")
    q = spark.createDataFrame([(1, "a"), (2, "b")], "qid long, query string")
    got = {}
    for r in index.with_unmatched(top, keys, q, 4).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.doc_id, r.chunk_no, r.score)
    assert got[1] == {1: (3, 0, 2.0), 2: (0, 1, 1.0), 3: (0, 0, 0.0), 4: (1, 0, 0.0)}
    assert got[2] == {1: (0, 0, 0.0), 2: (0, 1, 0.0), 3: (1, 0, 0.0), 4: (1, 1, 0.0)}


def test_the_restored_marker(spark):
    ok = "# T\n\n## A\n\ntext"
    row = spark.createDataFrame([(ok, ok + "\nWhat we plan to do?\n")], "a string, b string").select(*(rules.violates_contract(F.col(c), F.lit("summary"), F.lit(False)).alias(c) for c in "ab")).first()
    assert tuple(row) == (False, True)
