"""Online state of tracks: last centre and a count per step length, so the median of all earlier steps is exact.

State lives in the state store: one value (last centre, its event, number of steps) and one map from step length to how often it was
seen.  A step that comes again only raises a counter, so the state grows with the different steps of a track, not with its rows, and every
batch writes back only the entries that it changed.  With a time to live, tracks and steps that were not seen for so long leave the state.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATES = "sample_id string, event_id long, step double, speed double, change double"


class Steps:
    """A multiset of numbers with its median, loaded from and saved to a map of counts."""

    def __init__(self, counts: dict[float, int]) -> None:
        self.counts = dict(counts)
        self.order = sorted(self.counts)
        self.total = sum(self.counts.values())
        self.changed: set[float] = set()
        # the value that holds place ``below`` .. ``below`` + its count - 1
        self.at, self.below = 0, 0

    def add(self, value: float) -> None:
        if value not in self.counts:
            place = bisect_left(self.order, value)
            insort(self.order, value)
            self.counts[value] = 0
            if place <= self.at and self.total:
                self.at += 1
        if self.total and value < self.order[self.at]:
            self.below += 1
        self.counts[value] += 1
        self.total += 1
        self.changed.add(value)

    def _value(self, place: int) -> float:
        """The value at a place; the pointer walks there from the last median, which lies near."""
        while place < self.below:
            self.at -= 1
            self.below -= self.counts[self.order[self.at]]
        while place >= self.below + self.counts[self.order[self.at]]:
            self.below += self.counts[self.order[self.at]]
            self.at += 1
        return self.order[self.at]

    def median(self) -> float | None:
        if not self.total:
            return None
        low = self._value((self.total - 1) // 2)
        return (low + self._value(self.total // 2)) / 2


class TrackState(StatefulProcessor):
    """Step, speed and change against the median of all earlier steps, row by row."""

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "x double, y double, event_id long", self.ttl_ms)
        self.steps = handle.getMapState("steps", "step double", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("event_id", kind="stable")
        x, y, before = self.last.get() if self.last.exists() else (None, None, None)
        past = Steps({k[0]: v[0] for k, v in self.steps.iterator()} if self.steps.exists() else {})
        out = []
        for event, cx, cy in zip(frame["event_id"].tolist(), frame["cx"].tolist(), frame["cy"].tolist()):
            step = speed = change = 0.0
            if x is not None:
                step = float(np.hypot(cx - x, cy - y))
                speed = step / max(event - before, 1)
                base = past.median()
                if base is not None:
                    change = abs(step - base) if base <= 0 else abs(step / base - 1.0)
                past.add(step)
            x, y, before = cx, cy, event
            out.append((key[0], event, step, speed, change))
        self.last.update((x, y, before))
        for value in past.changed:
            self.steps.updateValue((value,), (past.counts[value],))
        yield pd.DataFrame(out, columns=["sample_id", "event_id", "step", "speed", "change"])

    def close(self) -> None:
        pass


def track_states(points: DataFrame, late: str = "1 day", ttl_ms: int | None = None) -> DataFrame:
    """``step``, ``speed`` (per event number) and ``change`` of every point of a stream (run it inside ``stored``).

    Rows of a batch go by event_id; a row that comes late goes on from the centre known then.  With a time to live the stream looks for
    expired state for ever: start it with a processing-time trigger, since "available now" would not end.
    """
    return (
        points.withWatermark("ts", late)
        .select("sample_id", "event_id", "cx", "cy")
        .groupBy("sample_id")
        .transformWithStateInPandas(TrackState(ttl_ms), STATES, "append", "None" if ttl_ms is None else "ProcessingTime")
    )


@contextmanager
def stored(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which map states need; the session's own choice comes back afterwards."""
    own = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER, own) if own else spark.conf.unset(PROVIDER)
