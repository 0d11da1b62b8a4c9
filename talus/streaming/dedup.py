"""Streaming forms of deduplication across runs and of windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_seen(stream: DataFrame, key: str, time_col: str, within: str = "3 days") -> DataFrame:
    """Rows whose key was not seen within the watermark. Nanosecond-free timestamps are cast, as watermarks need."""
    return stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, within).dropDuplicatesWithinWatermark([key])


def counts_by_window(stream: DataFrame, key: str, time_col: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, key, n) in tumbling windows; rows later than ``late`` are left out."""
    timed = stream.withColumn(time_col, F.col(time_col).cast("timestamp")).withWatermark(time_col, late)
    return timed.groupBy(F.window(time_col, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")
