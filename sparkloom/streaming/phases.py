"""Phase timers: where a run's time went, as run records.

``Stopwatch`` times the phases of a batch run by a monotonic clock. ``PhaseListener`` hears the progress of streaming
queries; Spark itself measures the phases of each trigger there (planning, reading offsets, adding the batch, commits).
"""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from sparkloom.sources.sinks import append_runs

SCHEMA = "run string, part long, phase string, duration_ms double, succeeded boolean"


class Stopwatch:
    """Laps and the total in milliseconds, to two places, and named phases."""

    def __init__(self, run: str = "", clock=time.perf_counter):
        self.run, self.clock, self.phases = run, clock, []
        self.began = self.last = clock()

    def lap_ms(self) -> float:
        now = self.clock()
        lap, self.last = now - self.last, now
        return round(lap * 1000, 2)

    def total_ms(self) -> float:
        return round((self.clock() - self.began) * 1000, 2)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        """Times what is run inside; a phase that raises is recorded as failed."""
        began, good = self.clock(), False
        try:
            yield
            good = True
        finally:
            self.phases.append((self.run, len(self.phases), name, round((self.clock() - began) * 1000, 2), good))

    def records(self, spark: SparkSession) -> DataFrame:
        """run, part, phase, duration_ms, succeeded: the phases in order and, last, the total."""
        total = (self.run, len(self.phases), "total", self.total_ms(), all(p[-1] for p in self.phases))
        return spark.createDataFrame([*self.phases, total], SCHEMA)

    def write(self, spark: SparkSession, path: str) -> None:
        append_runs(self.records(spark), path)


class PhaseListener(StreamingQueryListener):
    """Collects the phases of each batch of the session's streaming queries, until ``write`` takes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.found, self.lock, self.failed = spark, [], threading.Lock(), {}
        spark.streams.addListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.name or p.id), p.batchId, phase, float(ms), True) for phase, ms in sorted(p.durationMs.items())]
        with self.lock:
            self.found += rows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            with self.lock:
                self.found.append((str(event.id), -1, "terminated", 0.0, False))

    def write(self, path: str) -> int:
        """Appends what was heard as run records; how many."""
        self.spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        with self.lock:
            taken, self.found = self.found, []
        if taken:
            append_runs(self.spark.createDataFrame(taken, SCHEMA), path)
        return len(taken)

    def stop(self) -> None:
        self.spark.streams.removeListener(self)
