"""Structured Streaming forms of the history queries: cooldown, trailing counts, click counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_source(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def click_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours", ts: str = "ts") -> DataFrame:
    """Events per type and tumbling window; state is dropped once a window is later than ``late``."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def trailing_counts(events: DataFrame, days: int = 7, late: str = "1 day", ts: str = "ts") -> DataFrame:
    """Events of the last ``days``, sliding by a day."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, f"{days} days", "1 day")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.end").alias("day"), "n")


def first_uses(events: DataFrame, key: str, days: int = 21, ts: str = "ts") -> DataFrame:
    """Each key's first event within the cooldown; repeats are dropped while state is kept."""
    return events.withWatermark(ts, f"{days} days").dropDuplicatesWithinWatermark([key])
