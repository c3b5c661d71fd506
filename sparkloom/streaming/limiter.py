"""Sliding-window rate limiting. A denied request leaves no trace, so decisions depend on earlier decisions."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.config import DEFAULT, Limits

OUT = "key string, event_id long, ts double, allowed boolean, retry_after int"


class Window:
    """Accepted times of one key within the last ``window`` seconds."""

    def __init__(self, capacity: int, window: float, accepted=()):
        self.capacity, self.window, self.accepted = capacity, window, deque(accepted)

    def decide(self, now: float) -> tuple[bool, int]:
        while self.accepted and self.accepted[0] <= now - self.window:
            self.accepted.popleft()
        if len(self.accepted) < self.capacity:
            self.accepted.append(now)
            return True, 0
        return False, max(1, int(self.accepted[0] + self.window - now) + 1)


def capacity(limits: Limits) -> int:
    return limits.requests_per_minute + limits.burst


def decide_batch(hits: DataFrame, limits: Limits = DEFAULT.limits) -> DataFrame:
    """key, event_id, ts, allowed, retry_after of (key, event_id, ts seconds). Keys are dealt out and sorted by time, then
    streamed: a task holds one key's window, however many requests the key has. 0 requests a minute turns it off."""
    rows = hits.select("key", "event_id", F.col("ts").cast("double").alias("ts"))
    if limits.requests_per_minute <= 0:
        return rows.withColumns({"allowed": F.lit(True), "retry_after": F.lit(0)})
    most, window = capacity(limits), limits.window_s

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            out = []
            for key, ts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if state is None or key != last:
                    last, state = key, Window(most, window)
                out.append(state.decide(ts))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in out], pa.bool_()), pa.array([x[1] for x in out], pa.int32())], names=["key", "event_id", "ts", "allowed", "retry_after"])

    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInArrow(run, OUT)


def decide_stream(hits: DataFrame, limits: Limits = DEFAULT.limits, expire: bool = True) -> DataFrame:
    """The same over a stream, with the accepted times of each key as state; a key's state goes after a quiet window.

    Expiry by the clock keeps batches running without new data; ``expire=False`` suits bounded replays."""
    most, window = capacity(limits), limits.window_s

    def run(key, batches, state):
        if state.hasTimedOut:
            state.remove()
            return
        now = Window(most, window, state.get[0] if state.exists else ())
        whole = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        out = [now.decide(t) for t in whole["ts"]]
        state.update((list(now.accepted),))
        if expire:
            state.setTimeoutDuration(int(window * 1000))
        yield pd.DataFrame({"key": key[0], "event_id": whole["event_id"], "ts": whole["ts"], "allowed": [x[0] for x in out], "retry_after": [x[1] for x in out]})

    grouped = hits.select("key", "event_id", F.col("ts").cast("double").alias("ts")).groupBy("key")
    return grouped.applyInPandasWithState(run, OUT, "accepted array<double>", "append", "ProcessingTimeTimeout" if expire else "NoTimeout")
