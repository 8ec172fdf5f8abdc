"""Event counts in tumbling slices over a stream, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def slice_counts(events: DataFrame, width: str = "15 minutes", late: str = "1 hour", by: str = "event_type") -> DataFrame:
    """(start, by, n) for each slice; works on a stream (append mode) and on a table alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    stream = timed.withWatermark("ts", late) if events.isStreaming else timed
    return stream.groupBy(F.window("ts", width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")
