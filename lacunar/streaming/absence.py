"""Streaming forms: hourly usage with watermarks, sessions, online suspicion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, folder: str, name: str = "events.parquet", files: int = 1) -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", name).option("maxFilesPerTrigger", files).parquet(folder)


def hourly_usage(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(series_id, ts, value): sums by hour and event type, emitted once the watermark has passed."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.sum("value").alias("value"))
    return out.select(F.col("event_type").alias("series_id"), F.col("window.start").alias("ts"), "value")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """(series_id, b, e, n): runs of events no further apart than gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = timed.groupBy(F.session_window("ts", gap).alias("s"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("event_type").alias("series_id"), F.col("s.start").alias("b"), F.col("s.end").alias("e"), "n")


SUSPICION = "series_id string, idx long, loc int, gap long, usage double"


def online_gaps(rows: DataFrame) -> DataFrame:
    """(SUSPICION) of a stream (series_id, idx, value, loc): time and usage since the last occurrence.

    State is one (last, usage) pair a series, however long the stream. Rows of a
    trigger are taken in order of idx.
    """

    def step(key, frames, state: GroupState):
        last, usage = state.get if state.exists else (0, 0.0)
        got = []
        for r in pd.concat(list(frames)).sort_values("idx").itertuples(index=False):
            if r.loc == 1:
                last, usage = int(r.idx), 0.0
            got.append((key[0], int(r.idx), int(r.loc), int(r.idx) - last, usage))
            usage += float(r.value)
        state.update((last, usage))
        yield pd.DataFrame(got, columns=["series_id", "idx", "loc", "gap", "usage"])

    return rows.groupBy("series_id").applyInPandasWithState(step, SUSPICION, "last long, usage double", "append", GroupStateTimeout.NoTimeout)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end and returns what it emitted, as a table in memory (for tests)."""
    stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.table(name)
