import datetime as dt
import os
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.sources import sinks
from sparkloom.streaming import ingest, jobs, records
from sparkloom.streaming.phases import PhaseListener, Stopwatch


def at(seconds):
    return dt.datetime(2026, 1, 1) + dt.timedelta(seconds=seconds)


def feed(spark, rows, schema, path):
    """One more file of a stream's source; files are taken in the order of their times."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    time.sleep(0.05)


JOBS = "job_id string, status string, at timestamp, error string"
BATCHES = [
    [("a", "queued", at(0), None), ("b", "queued", at(1), None), ("c", "running", at(2), None), ("d", "queued", at(3), None)],
    [("a", "running", at(10), None), ("b", "running", at(11), None), ("b", "queued", at(11), None), ("d", "failed", at(12), "no source")],
    [("a", "running", at(60), None), ("d", "running", at(61), None)],
    [("a", "completed", at(100), None), ("e", "queued", at(180), None)],
    [("e", "running", at(185), None)],
]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_silent_job_is_interrupted_and_a_working_one_is_not(spark, rocks, tmp_path):
    for rows in BATCHES:
        feed(spark, rows, JOBS, tmp_path / "in")
    stream = spark.readStream.schema(JOBS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.transitions(stream, 70).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(150)
    got = {}
    for r in spark.read.parquet(str(tmp_path / "out")).orderBy("job_id", "at").collect():
        got.setdefault(r.job_id, []).append((r.was, r.status, (r.at - at(0)).total_seconds(), r.error))
    assert [x[1] for x in got["a"]] == ["queued", "running", "running", "completed"]
    assert got["b"] == [(None, "queued", 1.0, None), ("queued", "running", 11.0, None), ("running", "interrupted", 81.0, jobs.SILENT)]
    assert got["d"] == [(None, "queued", 3.0, None), ("queued", "failed", 12.0, "no source")]
    assert "c" not in got and [x[1] for x in got["e"]] == ["queued", "running"]


def test_outcomes_of_a_table_are_those_of_the_stream(spark):
    updates = spark.createDataFrame([r for b in BATCHES for r in b], JOBS)
    got = {r.job_id: (r.status, (r.at - at(0)).total_seconds(), r.n_changes, r.error) for r in jobs.outcomes(updates, 70).collect()}
    assert got == {"a": ("completed", 100.0, 4, None), "b": ("interrupted", 81.0, 3, jobs.SILENT), "d": ("failed", 12.0, 2, "no source"), "e": ("running", 185.0, 2, None)}
    assert jobs.outcomes(updates.limit(0), 70).count() == 0


RUNS = "recorded_at timestamp, route string, succeeded boolean, total_latency_ms double"


def test_late_records_and_replayed_batches(spark, tmp_path):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    schema = "window_start timestamp, route string, runs long, succeeded long, success_rate double, total_latency_ms double, max_latency_ms double, batch_id int"
    run = lambda: records.keep_rollup(spark.readStream.schema(RUNS).option("maxFilesPerTrigger", 1).parquet(str(source)), out, str(cp), "1 minute", "2 minutes").awaitTermination()
    feed(spark, [(at(10), "x", True, 5.0), (at(20), "x", False, 7.0)], RUNS, source)
    feed(spark, [(at(150), "y", True, 1.0)], RUNS, source)
    feed(spark, [(at(50), "x", True, 9.0)], RUNS, source)  # late, inside the watermark of 30 s
    feed(spark, [(at(400), "y", True, 2.0)], RUNS, source)
    feed(spark, [(at(410), "y", True, 2.0)], RUNS, source)  # rows are held against the watermark of the batch before
    feed(spark, [(at(55), "x", True, 100.0)], RUNS, source)  # beyond it
    feed(spark, [(at(900), "z", True, 1.0)], RUNS, source)
    run()
    read = lambda: sorted(((r.window_start - at(0)).total_seconds(), r.route, r.runs, r.success_rate, r.total_latency_ms) for r in records.read_batches(spark, out, schema, "parquet").collect())
    want = [(0.0, "x", 3, 0.6667, 21.0), (120.0, "y", 1, 1.0, 1.0), (360.0, "y", 2, 1.0, 4.0)]
    assert read() == want
    last = max(int(p.name) for p in (cp / "commits").iterdir() if p.name.isdigit())
    for name in (str(last), f".{last}.crc"):
        (cp / "commits" / name).unlink(missing_ok=True)
    run()  # the last batch runs again
    assert read() == want


def test_records_are_appended_once(spark, tmp_path):
    source, out, cp = tmp_path / "in", str(tmp_path / "out"), tmp_path / "cp"
    run = lambda: records.append_records(spark.readStream.schema(RUNS).parquet(str(source)), out, str(cp)).awaitTermination()
    feed(spark, [(at(1), "x", True, 5.0)], RUNS, source)
    run()
    feed(spark, [(at(2), "y", False, 6.0), (at(3), "y", None, None)], RUNS, source)
    run()
    run()
    assert sorted(r.route for r in records.read_batches(spark, out, RUNS).collect()) == ["x", "y", "y"]
    rows = spark.createDataFrame([(at(9), "z", True, 1.0)], RUNS)
    for _ in range(2):
        records.by_batch(out)(rows, 7)
    assert records.read_batches(spark, out, RUNS).filter("route = 'z'").count() == 1


def test_phases_of_a_run(spark, tmp_path):
    ticks = iter([0.0, 1.0, 1.5, 2.0, 2.25, 5.0, 6.0])
    watch = Stopwatch("r1", clock=lambda: next(ticks))
    with watch.phase("scan"):
        spark.range(3).count()
    with pytest.raises(ValueError), watch.phase("rank"):
        raise ValueError
    watch.write(spark, str(tmp_path / "runs"))
    got = {r.phase: (r.part, r.duration_ms, r.succeeded) for r in spark.read.json(str(tmp_path / "runs")).collect()}
    assert got == {"scan": (0, 500.0, True), "rank": (1, 250.0, False), "total": (2, 5000.0, False)}
    assert watch.lap_ms() == 6000.0


def test_phases_of_a_stream(spark, tmp_path):
    listener = PhaseListener(spark)
    try:
        feed(spark, [(at(1), "x", True, 5.0)], RUNS, tmp_path / "in")
        stream = spark.readStream.schema(RUNS).parquet(str(tmp_path / "in"))
        q = stream.writeStream.queryName("timed").foreachBatch(records.by_batch(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        assert listener.write(str(tmp_path / "runs")) > 0 and listener.write(str(tmp_path / "runs")) == 0
    finally:
        listener.stop()
    got = {r.phase: r.duration_ms for r in spark.read.json(str(tmp_path / "runs")).filter("run = 'timed' AND part = 0").collect()}
    assert {"addBatch", "triggerExecution"} <= set(got) and got["triggerExecution"] >= got["addBatch"] >= 0


def test_only_changed_files_are_read_again(spark, tmp_path):
    root, home = tmp_path / "work", str(tmp_path / "home")
    root.mkdir()
    read = lambda: {r.path.rsplit("/", 1)[1]: r.text for r in ingest.current(spark, home).collect()}
    taken = lambda: sorted((r.batch_id, r.path.rsplit("/", 1)[1]) for r in spark.read.parquet(f"{home}/texts").collect())
    (root / "a.md").write_text("one")
    (root / "b c.txt").write_text("two")
    assert ingest.ingest(spark, str(root), home) == 2 and read() == {"a.md": "one", "b c.txt": "two"}
    assert ingest.ingest(spark, str(root), home) == 0 and len(taken()) == 2
    (root / "a.md").write_text("one, changed")
    os.utime(root / "a.md", (2_000_000_000, 2_000_000_000))
    assert ingest.ingest(spark, str(root), home) == 1
    assert read() == {"a.md": "one, changed", "b c.txt": "two"} and [x[1] for x in taken()].count("b c.txt") == 1
    ingest.note_changes(spark, str(root), home)
    (root / "d.md").write_text("new")
    assert ingest.note_changes(spark, str(root), home) == 1  # noted, and then the run was lost
    (root / "b c.txt").unlink()
    assert ingest.ingest(spark, str(root), home) == 1  # after a restart what was noted is taken, too
    assert read() == {"a.md": "one, changed", "d.md": "new"} and len(taken()) == 4


def test_retention_still_reads_by_key(spark):
    rows = spark.createDataFrame([("k", 1, "old"), ("k", 2, "new")], "key string, modified long, v string")
    assert [r.v for r in sinks.latest_per_key(rows).collect()] == ["new"]
    assert rows.select(F.max("modified")).first()[0] == 2
