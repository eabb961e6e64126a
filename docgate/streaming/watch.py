"""State per entity that outlives a run: a heartbeat that tells who fell silent, and the poll machine of remote recognition.

Both are stateful processors, so their state is in the checkpoint (RocksDB) and a restarted query goes on where it
stopped; a heartbeat's timer fires without a new event. A task holds the rows of one entity of one batch at most.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import Row

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: States of a heartbeat that are no longer watched, and those of a segment that nothing changes.
OVER = ("finished", "failed", "stopped")
FINAL = ("done", "failed")
STALE_MS = 6 * 60 * 60 * 1000
#: Silent entities are forgotten after so long.
FORGET_MS = 30 * 24 * 60 * 60 * 1000


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class Heartbeat(StatefulProcessor):
    """Emits an entity when it has been silent for `stale_ms`, and when it is heard again."""

    def __init__(self, stale_ms: int = STALE_MS, forget_ms: int = FORGET_MS):
        self.stale_ms, self.forget_ms = stale_ms, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "event_id long, at_us long, status string, silent boolean", self.forget_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(((r.at_us, r.event_id, r.status) for r in rows), key=lambda x: x[:2])
        before = self.last.get() if self.last.exists() else None
        if before is not None and (before[1], before[0]) > newest[:2]:
            return  # what comes late says nothing new
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        at_us, event_id, status = newest
        self.last.update((event_id, at_us, status, False))
        if status not in OVER:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.stale_ms)
        if before is not None and before[3]:
            yield Row(entity=key[0], event_id=event_id, at_us=at_us, status=status, event="heard")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.last.exists():
            event_id, at_us, status, _ = self.last.get()
            self.last.update((event_id, at_us, status, True))
            yield Row(entity=key[0], event_id=event_id, at_us=at_us, status=status, event="silent")

    def close(self) -> None:
        pass


def heartbeats(stream: DataFrame, stale_ms: int = STALE_MS, forget_ms: int = FORGET_MS) -> DataFrame:
    """stream: (entity, event_id, at, status). A row for each entity that falls silent or is heard again: entity, event_id and at of its last sign, status, event."""
    use_rocksdb(stream.sparkSession)
    kind = dict(stream.dtypes)["entity"]
    rows = stream.select("entity", "event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "status")
    made = rows.groupBy("entity").transformWithState(Heartbeat(stale_ms, forget_ms), f"entity {kind}, event_id long, at_us long, status string, event string", "Append", "ProcessingTime")
    return made.select("entity", "event_id", F.timestamp_micros("at_us").alias("at"), "status", "event")


class Polls(StatefulProcessor):
    """A segment's state: the first final one stands, whatever comes later; else the latest, with the number of polls and the states it went through."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "state string, steps long, ignored long")
        self.path = handle.getListState("path", "state string")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.now.update((initialState.state, initialState.steps, initialState.ignored))
        self.path.appendValue((initialState.state,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        state, steps, ignored = self.now.get() if self.now.exists() else ("", 0, 0)
        for _, _, new in sorted((r.at_us, r.event_id, r.state) for r in rows):
            if state in FINAL:
                ignored += 1
                continue
            if new != state:
                self.path.appendValue((new,))
            state, steps = new, steps + 1
        self.now.update((state, steps, ignored))
        yield Row(segment=key[0], state=state, steps=steps, ignored=ignored, path=",".join(p[0] for p in self.path.get()))

    def close(self) -> None:
        pass


def polls(stream: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """stream: (segment, event_id, at, state), batches in order of time. known: (segment, state, steps, ignored) from which the first run starts. A row for each segment of a batch, with its state after it."""
    use_rocksdb(stream.sparkSession)
    kind = dict(stream.dtypes)["segment"]
    start = None if known is None else known.select("segment", "state", F.col("steps").cast("long"), F.col("ignored").cast("long")).groupBy("segment")
    rows = stream.select("segment", "event_id", F.unix_micros(F.col("at").cast("timestamp")).alias("at_us"), "state")
    return rows.groupBy("segment").transformWithState(
        Polls(), f"segment {kind}, state string, steps long, ignored long, path string", "Update", "None", initialState=start
    )
