"""Structured Streaming forms of operators that Spark's own state suffices for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, ts: str, within: str = "1 hour") -> DataFrame:
    """Rows whose key didn't occur before within the watermark: duplicates across batches are dropped, state is bounded."""
    return stream.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def tumbling_counts(stream: DataFrame, ts: str, by: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per window, final once the watermark has passed.."""
    counted = stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")
