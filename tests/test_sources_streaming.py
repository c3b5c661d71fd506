import io
import json
import struct
import zipfile
import zlib

import numpy as np
from pyspark.sql import functions as F

from sparkloom.config import Limits
from sparkloom.functions import rules
from sparkloom.functions.register import chain, embedder, register
from sparkloom.operators import files
from sparkloom.operators.images import features, read_images
from sparkloom.sources import sinks, workspace
from sparkloom.streaming.jobs import SILENT
from sparkloom.streaming.limiter import Window, decide_stream

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'


def zipped(path, members):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for n, c in members.items():
            z.writestr(n, c)
    path.write_bytes(b.getvalue())


def test_workspace_reading(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git" / "x.md").write_text("hidden")
    (tmp_path / "sub" / "a.MD").write_bytes(b"caf\xc3\xa9 \xff ok")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    zipped(tmp_path / "c.docx", {"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:p/><w:p><w:r><w:t>Two</w:t></w:r></w:p></w:body></w:document>"})
    shape = '<p:sp><p:nvSpPr><p:nvPr><p:ph type="title"/></p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:t>Head</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:txBody><a:p><a:r><a:t>line</a:t></a:r></a:p></p:txBody></p:sp>'
    table = "<a:tbl><a:tr><a:tc><a:txBody><a:p><a:r><a:t>k</a:t></a:r></a:p></a:txBody></a:tc><a:tc><a:txBody><a:p><a:r><a:t>v</a:t></a:r></a:p></a:txBody></a:tc></a:tr></a:tbl>"
    zipped(tmp_path / "d.pptx", {"ppt/slides/slide1.xml": f"<p:sld {A}>{shape}{table}</p:sld>", "ppt/media/i1.png": b"x" * 13000, "ppt/media/i2.png": b"x" * 13000, "ppt/media/i3.png": b"small"})
    files = workspace.scan(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.text for r in workspace.texts(files).collect()}
    assert got == {"a.MD": "café  ok", "b.pdf": "", "bad.docx": "", "c.docx": "[Paragraph 1] One\n[Paragraph 3] Two", "d.pptx": "[Slide 1]\nTitle: Head\nline\nk | v"}
    assert {r.path.rsplit("/", 1)[1]: r.text for r in workspace.texts(files, parse_pdf=lambda b: "pdf").collect()}["b.pdf"] == "pdf"


def test_html_and_pairs(spark, tmp_path):
    df = spark.createDataFrame([("<p>A &amp; <b>b</b></p><script>x</script>",)], "html string")
    assert df.select(workspace.html_text(df.html).alias("t")).first().t == "A & b"
    (tmp_path / "p.csv").write_text('source_text,optimized_text,score\na,b,0.5\n"c ""q""",,\n')
    assert workspace.training_pairs(spark, str(tmp_path / "p.csv")).agg({"score": "avg"}).first()[0] == 0.25


def test_sinks(spark, tmp_path):
    runs = spark.createDataFrame([(1, "a"), (2, "b")], "run long, route string")
    sinks.append_runs(runs, str(tmp_path / "runs"))
    sinks.append_runs(runs, str(tmp_path / "runs"))
    assert spark.read.json(str(tmp_path / "runs")).count() == 4
    cache = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "key string, modified long")
    assert [r.key for r in sinks.retained(cache, 2).collect()] == ["a"]


def test_registered_functions_and_chains(spark):
    register(spark, lambda: lambda texts: [[float(len(t)), 1.0] for t in texts])
    assert spark.sql("SELECT tokenize('Aaa bb ccc') t, squeeze(' a  b ') s, size(text_windows('abcdef', 4, 2)) n").first() == (["aaa", "ccc"], "a b", 2)
    assert spark.sql("SELECT policy_flags('mail a.b@c.org') f").first().f == ["pii_detected:email"]
    assert spark.sql("SELECT doc_structure('## Part 1: A\n### Step 1: x\n### One') s").first().s.asDict() == {"parts": 1, "procedure_steps": 1, "topics": 1, "tables_rendered": 0, "table_rows": 0, "figures_embedded": 0}
    assert [r.text for r in spark.sql("SELECT * FROM chunk_text('aaa\n\nbbb\n\ncccccccccccc', 8, 2)").collect()] == ["aaa\n\nbbb", "cccccccc", "cccccc"]
    assert spark.sql("SELECT embed('abc') e").first().e == [3.0, 1.0]
    assert chain(spark.range(5), lambda d: d.filter("id > 1"), lambda d: d.limit(2)).count() == 2


def test_a_missing_embedding_model_gives_no_vectors(spark):
    def load():
        raise ImportError("no model")

    assert spark.range(2).select(embedder(load, "absent")(F.lit("x")).alias("e")).collect() == [(None,), (None,)]


def png(pixels):
    """A PNG file of rows of red, green, blue and perhaps alpha values."""
    h, w, c = pixels.shape
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {3: 2, 4: 6}[c], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_features_from_pixels(spark, tmp_path):
    rng = np.random.default_rng(1)
    flat = np.full((200, 300, 3), 200)
    noisy = rng.integers(0, 256, (200, 300, 3))
    clear = np.zeros((200, 300, 4))
    clear[:, :60] = (10, 10, 10, 255)
    skin = np.stack([rng.integers(150, 250, (300, 260)), rng.integers(60, 110, (300, 260)), rng.integers(30, 60, (300, 260))], axis=2)
    skin = np.repeat(np.repeat(skin[::20, ::20], 20, axis=0), 20, axis=1)[:300, :260]
    for name, pixels in (("flat", flat), ("noisy", noisy), ("clear", clear), ("skin", skin)):
        (tmp_path / f"{name}.png").write_bytes(png(pixels))
    (tmp_path / "broken.png").write_bytes(b"no image")
    rows = read_images(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1][:-4]: r for r in rows.select("*", *(c.alias(k) for k, c in files.triage().items())).collect()}
    assert (got["flat"].width, got["flat"].height, got["flat"].colors, got["flat"].detail, got["flat"].category) == (300, 200, 1, 0.0, "decorative")
    assert got["noisy"].detail > 0.1 and got["noisy"].category == "diagram" and got["noisy"].include
    assert abs(got["clear"].transparency - 0.8) < 0.02 and got["clear"].category == "decorative"
    assert got["skin"].skin > 0.9 and got["skin"].variety >= 8 and got["skin"].category == "portrait"
    assert got["broken"].category == "undecodable"
    for name, pixels in (("noisy", noisy), ("clear", clear)):
        want = features(pixels.astype(np.uint8))
        assert {k: got[name][k] for k in want} == want


def test_reports_thresholds_and_increments(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"version": "1", "gates": {"pass_rate": {"min": 1.0, "rationale": "all"}, "p95_latency_ms": {"max": 9}}}')
    assert {(r.metric, r.bound, r["limit"]) for r in workspace.thresholds(spark, str(tmp_path / "t.json")).collect()} == {("pass_rate", "min", 1.0), ("p95_latency_ms", "max", 9.0)}
    assert workspace.benchmark_snapshot(spark, str(tmp_path / "none.json")).first().status == "missing"
    (tmp_path / "r.json").write_text('{"mode": "mock", "case_count": 3, "summary": {"pass_rate": 1.0}, "advisory_case_ids": ["a"]}')
    got = workspace.benchmark_snapshot(spark, str(tmp_path / "r.json")).first()
    assert (got.status, got.mode, got.case_count, got.summary, got.advisory_case_ids) == ("available", "mock", 3, {"pass_rate": 1.0}, ["a"]) and got.updated_at
    (tmp_path / "a.md").write_text("one")
    first = spark.createDataFrame(workspace.scan(spark, str(tmp_path)).select("path", "modificationTime", "length").collect())
    (tmp_path / "b.md").write_text("two")
    assert [r.path.rsplit("/", 1)[1] for r in workspace.changed_files(workspace.scan(spark, str(tmp_path)), first).collect()] == ["b.md"]


def test_snapshots_of_jobs_and_metadata_of_artifacts(spark, tmp_path):
    jobs = [
        {"job_id": "a", "owner_user_id": "u1", "status": "running", "created_at": 1.0, "updated_at": 5.0, "request": {"prompt": "x"}, "result": None},
        {"job_id": "b", "owner_user_id": "u2", "status": "completed", "created_at": 2.0, "updated_at": 6.0, "result": {"n": [1, 2]}},
        {"job_id": "c", "owner_user_id": "u1", "status": "queued", "created_at": 11.0, "updated_at": 11.0},
        {"job_id": "d", "owner_user_id": "u1", "status": "queued", "created_at": 1.0, "updated_at": 1.0},
        {"job_id": "d", "owner_user_id": "u1", "status": "failed", "created_at": 1.0, "updated_at": 3.0, "error": "no source"},
    ]
    for i, x in enumerate(jobs):
        (tmp_path / f"j{i}.json").write_text(json.dumps(x, indent=1))
    (tmp_path / "broken.json").write_text("{")
    got = {r.job_id: (r.status, r.updated_at, r.error, json.loads(r.request or r.result or "null")) for r in workspace.job_snapshots(spark, str(tmp_path), 10.0).collect()}
    assert got == {"a": ("interrupted", 10.0, SILENT, {"prompt": "x"}), "b": ("completed", 6.0, None, {"n": [1, 2]}), "c": ("queued", 11.0, None, None), "d": ("failed", 3.0, "no source", None)}
    (tmp_path / "meta").mkdir()
    (tmp_path / "meta" / "1.json").write_text(json.dumps({"artifact_id": "x1", "owner_user_id": "u1", "format": "pdf", "mime_type": "application/pdf", "filename": "a.pdf", "path": "/s/a.pdf", "size_bytes": 7}))
    row = workspace.artifact_records(spark, str(tmp_path / "meta")).first()
    assert (row.owner, row.size_bytes, row.download_path) == ("u1", 7, "/artifacts/x1")
    rules.readable_view(workspace.artifact_records(spark, str(tmp_path / "meta")), "stored")
    assert rules.readable_by(spark, "stored", "u1", "editor").count() == 1 and rules.readable_by(spark, "stored", "u2", "editor").count() == 0


def test_limiter_as_a_stream(spark, tmp_path):
    hits = [("k", i, float(t)) for i, t in enumerate((0, 1, 30, 62))]
    for i, h in enumerate(hits):
        spark.createDataFrame([h], "key string, event_id long, ts double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, event_id long, ts double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = decide_stream(stream, Limits(2, 0, 60.0), expire=False).writeStream.format("memory").queryName("decided").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    state = Window(2, 60.0)
    assert {r.event_id: r.allowed for r in spark.table("decided").collect()} == {i: state.decide(t)[0] for _, i, t in hits}
