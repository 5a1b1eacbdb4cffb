"""Running totals of events that keep arriving (an extension: the batch tables, kept up to date)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_totals(events: DataFrame, keys: list[str], value: str = "pp") -> DataFrame:
    """Count and sum per key over a stream, for output mode 'complete' or 'update'."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def windowed_totals(events: DataFrame, time: str, window: str, late: str, keys: list[str], value: str = "pp") -> DataFrame:
    """Totals per key and time window; rows later than ``late`` behind the watermark are dropped."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), *keys)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")
