"""Logs as streams: the latest state of each entity, counts by stage and hour, and gaps in a heartbeat."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, files: int = 10) -> DataFrame:
    """A folder of Parquet files as a stream with event time."""
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def hourly_counts(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Calls by stage and hour; an hour is final once the watermark has passed it."""
    return stream.withWatermark("at", late).groupBy(F.window("at", "1 hour").alias("hour"), F.col("event_type").alias("stage")).agg(F.count(F.lit(1)).alias("calls"), F.sum("value").alias("cost"))


def latest_state(stream: DataFrame) -> DataFrame:
    """The latest event of each entity: one row of state per entity, by time and then id."""
    newest = F.max_by(F.struct("event_id", "event_type", "ts"), F.struct("ts", "event_id")).alias("last")
    return stream.groupBy(F.col("user_id").alias("entity")).agg(newest).select("entity", "last.event_id", F.col("last.event_type").alias("status"), "last.ts")


def breaker(stream: DataFrame, failed_above: float = 1.5, opens_at: int = 5, recovery_us: int = 60_000_000) -> DataFrame:
    """(stage, event_id, state): each event that opens its stage's breaker (the nth failure in a row), half-opens it (the first once it has recovered) or closes it (a success while half-open).

    Arbitrary state per stage: failures in a row, and when it opened, in event time. A failure while half-open opens it anew. Batches are taken in order of time."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        length, opened, half = state.get if state.exists else (0, None, False)
        made = []
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            at, failed = int(pd.Timestamp(e.ts).value // 1000), e.value > failed_above
            if opened is not None and not half and at - opened >= recovery_us:
                half = True
                made.append((key[0], int(e.event_id), "half_open"))
            if opened is not None and not half:
                continue  # nothing is called while it is open
            length = length + 1 if failed else 0
            if half and not failed:
                opened, half = None, False
                made.append((key[0], int(e.event_id), "closed"))
            elif half or length >= opens_at:
                opened, half, length = at, False, 0
                made.append((key[0], int(e.event_id), "open"))
        state.update((length, opened, half))
        yield pd.DataFrame(made, columns=["stage", "event_id", "state"])

    rows = stream.select("event_type", "event_id", "ts", "value")
    return rows.groupBy("event_type").applyInPandasWithState(run, "stage string, event_id long, state string", "length int, opened long, half boolean", "append", GroupStateTimeout.NoTimeout)


def _versions(spark: SparkSession, table: str) -> list[int]:
    """The complete versions of a table, in order."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(table)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    names = [s.getPath() for s in fs.listStatus(root)]
    return sorted(int(p.getName().removeprefix("v")) for p in names if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def read_latest(spark: SparkSession, table: str) -> DataFrame | None:
    """The latest state of every entity, one row each, as of the newest complete version."""
    found = _versions(spark, table)
    return spark.read.parquet(f"{table}/v{found[-1]:010d}") if found else None


def upsert_latest(stream: DataFrame, table: str, checkpoint: str):
    """Keeps one latest row of each entity in a folder of versions: a batch is merged with the version before it. A batch that is run again gives the same version."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = [v for v in _versions(spark, table) if v < number]
        rows = batch if not before else spark.read.parquet(f"{table}/v{before[-1]:010d}").unionByName(batch)
        newest = F.max_by(F.struct("event_id", "status", "ts"), F.struct("ts", "event_id")).alias("last")
        merged = rows.groupBy("entity").agg(newest).select("entity", "last.event_id", "last.status", "last.ts")
        merged.write.mode("overwrite").parquet(f"{table}/v{number:010d}")

    return latest_state(stream).writeStream.outputMode("update").foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
