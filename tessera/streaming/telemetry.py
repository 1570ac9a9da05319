"""Telemetry streams: windows with watermarks, first sightings, and circuit breakers with their own state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """New Parquet files of a folder or of a table's path; zone-less times become instants."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, key: str, ts: str, size: str, late: str = "10 minutes", slide: str | None = None, value: Column | None = None) -> DataFrame:
    """Count and sum per key and window; rows later than the watermark are left out."""
    total = F.sum(value if value is not None else F.lit(1)).alias("total")
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), total).select(F.col("w.start").alias("window_start"), key, "n", "total")


def sessions(events: DataFrame, key: str, ts: str, gap: str, late: str = "10 minutes") -> DataFrame:
    """Runs of a key's events with pauses shorter than ``gap``."""
    w = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "n")


def first_seen(events: DataFrame, key: str, ts: str, late: str = "1 hour") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def breakers(calls: DataFrame, key: str, ts: str, failed: str, threshold: int = 3, cooldown: int = 60, late: str | None = None) -> DataFrame:
    """(key, at, streak, open) after each micro-batch's calls: opens at ``threshold`` failures in a row for ``cooldown`` seconds.

    With ``late``, the watermark's delay, there is a row too for the moment at which a breaker closes by itself, set off by
    a timer on event time once the watermark has passed it: no further call of that key is needed, and calls later than
    the watermark are left out. A call at that very moment finds the breaker closed."""
    kind = dict(calls.dtypes)[key]

    def work(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        streak, until = state.get if state.exists else (0, 0.0)
        rows = []
        closed = lambda: (name[0], pd.Timestamp(round(until * 1_000_000), unit="us"), 0, False)
        if state.hasTimedOut:
            rows.append(closed())
            streak, until = 0, 0.0
        else:
            calls = pd.concat(list(batches)).sort_values("at")
            for at, bad in zip(calls["at"], calls["bad"]):
                now = at.timestamp()
                if until and now >= until:
                    if late:
                        rows.append(closed())
                    streak, until = 0, 0.0
                streak = streak + 1 if bad else 0
                until = now + cooldown if streak >= threshold else until if bad else 0.0
                rows.append((name[0], at, streak, until > now))
        state.update((streak, until))
        if late and until:
            state.setTimeoutTimestamp(max(int(until * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["key", "at", "streak", "open"])

    rows = calls.select(F.col(key).alias("key"), F.col(ts).alias("at"), F.col(failed).alias("bad"))
    rows, timeout = (rows.withWatermark("at", late), GroupStateTimeout.EventTimeTimeout) if late else (rows, GroupStateTimeout.NoTimeout)
    return rows.groupBy("key").applyInPandasWithState(work, f"key {kind}, at timestamp, streak int, open boolean", "streak int, until double", "append", timeout)


def to_files(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Everything there is now, appended as Parquet; restarted runs go on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
