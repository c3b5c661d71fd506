"""Background jobs as a state machine: queued, running, then completed or failed; interrupted after a silence.

The same rules run over a stream of updates, with a value state and a timer for each job, and over a table of them.
An update that the rules do not allow (a second ``queued``, anything after an end, work on a job that was never queued)
changes nothing. Updates of one time take effect in the order of the states.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATES = ("queued", "running", "completed", "failed", "interrupted")
#: What may follow a state; the empty string stands for a job that is not known yet.
NEXT = {"": ("queued",), "queued": ("running", "failed"), "running": ("running", "completed", "failed"), "completed": (), "failed": (), "interrupted": ()}
OPEN = ("queued", "running")
SILENT = "No update came before the job ended. Submit the request again to continue."
_OUT = "job_id string, was string, status string, at timestamp, error string"


class JobMachine(StatefulProcessor):
    """State of a job: its status and the time of its last update (milliseconds). A timer stands ``silence_ms`` after that:
    it interrupts an open job, and forgets one that has ended."""

    def __init__(self, silence_ms: int):
        self.silence_ms = silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.job = handle, handle.getValueState("job", "status string, at long")

    def _await(self, at: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(at + self.silence_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows))
        found = found.assign(order=found["status"].map({s: i for i, s in enumerate(STATES)})).sort_values(["at", "order"])
        status, last = self.job.get() if self.job.exists() else ("", None)
        out = []
        for new, at, error in zip(found["status"], found["at"], found["error"], strict=True):
            if new in NEXT[status]:
                out.append((key[0], status or None, new, at, error if new == "failed" else None))
                status, last = new, at.value // 1_000_000
        if out:
            self.job.update((status, last))
            self._await(last)
            yield pd.DataFrame(out, columns=["job_id", "was", "status", "at", "error"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        status, last = self.job.get()
        if status in OPEN:
            due = last + self.silence_ms
            self.job.update(("interrupted", due))
            self._await(due)
            yield pd.DataFrame([(key[0], status, "interrupted", pd.Timestamp(due, unit="ms"), SILENT)], columns=["job_id", "was", "status", "at", "error"])
        else:
            self.job.clear()

    def close(self) -> None:
        pass


def transitions(updates: DataFrame, silence_s: float, late: str = "0 seconds") -> DataFrame:
    """A stream of job_id, was, status, at, error: the changes that a stream of (job_id, status, at, error) makes.

    Times are those of the updates: a job is interrupted once the watermark has passed its last update by ``silence_s``.
    The session needs the RocksDB state store, which holds states and timers outside the executors' heaps."""
    rows = updates.select("job_id", "status", "at", "error").withWatermark("at", late)
    return rows.groupBy("job_id").transformWithStateInPandas(JobMachine(int(silence_s * 1000)), _OUT, "append", "eventTime")


def outcomes(updates: DataFrame, silence_s: float) -> DataFrame:
    """job_id, status, at, n_changes, error of each job of a table of (job_id, status, at, error), as the rules leave it when
    the last update of all is the present. Rules are a fold over each job's updates in the order of time."""
    order = F.array_position(F.array(*[F.lit(x) for x in STATES]), F.col("status"))
    listed = updates.groupBy("job_id").agg(F.sort_array(F.collect_list(F.struct("at", order.alias("order"), "status", "error"))).alias("all"))
    follows = F.lit(False)
    silent = lambda s, x: (s["status"].isin(*OPEN)) & (F.unix_micros(x["at"]) - F.unix_micros(s["at"]) >= int(silence_s * 1e6))
    start = F.struct(F.lit("").alias("status"), F.lit(None).cast("timestamp").alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("error"))

    def step(s, x):
        ok = follows
        for was, may in NEXT.items():
            if may:
                ok = ok | ((s["status"] == was) & x["status"].isin(*may))
        gone = F.struct(F.lit("interrupted").alias("status"), (s["at"] + F.make_dt_interval(secs=F.lit(float(silence_s)))).alias("at"), (s["n"] + 1).alias("n"), F.lit(SILENT).alias("error"))
        taken = F.struct(x["status"].alias("status"), x["at"].alias("at"), (s["n"] + 1).alias("n"), F.when(x["status"] == "failed", x["error"]).alias("error"))
        return F.when(silent(s, x), gone).when(ok, taken).otherwise(s)

    now = updates.agg(F.max("at").alias("at"))
    last = listed.join(F.broadcast(now), how="cross").select("job_id", F.aggregate(F.concat("all", F.array(F.struct(F.col("at").alias("at"), F.lit(0).cast("bigint").alias("order"), F.lit("").alias("status"), F.lit(None).cast("string").alias("error")))), start, step).alias("s"))
    return last.filter("s.n > 0").select("job_id", "s.status", "s.at", F.col("s.n").alias("n_changes"), "s.error")
