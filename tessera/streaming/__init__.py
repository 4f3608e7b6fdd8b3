"""Batch queries of the engine over unbounded input; an extension, since the engine itself is batch only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, *, size: str = "1 hour", late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Rows and values for each key and time window; works on a stream (with a watermark) and on a table alike."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark(time, late)
    return stamped.groupBy(F.window(time, size), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(
        F.col("window.start").alias("start"), key, "n", "value"
    )
