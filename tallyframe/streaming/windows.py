"""Windowed aggregates, the same expression over a table and a stream.

The batch references have no stream; these run the survey's counts on live events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, length: str, late: str = "2 hours") -> DataFrame:
    """Counts and sums per event type in tumbling windows; on a stream, rows later than
    ``late`` are dropped with the state of their window."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.window("ts", length), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, gap: str, late: str = "2 hours") -> DataFrame:
    """Sessions of each user: events without a pause of ``gap``."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        e = e.withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))


def first_by_key(events: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """The first event of each key, as upserts need it: in a table by time, then by the other
    columns; on a stream the first that arrives within the watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        return e.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])
    rest = [c for c in e.columns if c not in ("ts", key)]
    return e.groupBy(key).agg(F.min(F.struct("ts", *rest)).alias("fk_first")).select(*(key if c == key else f"fk_first.{c}" for c in e.columns))
