"""Streams over submissions and usage: rate limits, repeated deliveries and rolling cost.

Every function takes a streaming or a batch DataFrame; event time must be `timestamp`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values.
LIMIT_PER_MINUTE = 5
COST_RANGES = (7, 30, 90)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Zone-less times as UTC timestamps: watermarks need the zoned type."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def over_limit(submissions: DataFrame, limit: int = LIMIT_PER_MINUTE, lateness: str = "2 minutes") -> DataFrame:
    """Clients above the limit in a minute."""
    counted = submissions.withWatermark("ts", lateness).groupBy(F.window("ts", "1 minute"), "client").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") > limit).select(F.col("window.start").alias("minute"), "client", "n")


def first_deliveries(events: DataFrame, key: str = "event_id", lateness: str = "1 day") -> DataFrame:
    """One row per delivered event. State is one key per event and is dropped once the watermark passes."""
    if events.isStreaming:
        return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])
    return events.dropDuplicates([key])


def rolling_cost(costed: DataFrame, days: int, lateness: str = "1 day") -> DataFrame:
    """Cost per model in windows of `days`, one per day; late rows count until the watermark."""
    if days not in COST_RANGES:
        raise ValueError(f"days must be one of {COST_RANGES}")
    # A row falls into `days` windows; summing per day first keeps that copy on one row per model and day.
    source = costed.withWatermark("ts", lateness)
    if not costed.isStreaming:
        source = source.groupBy(F.date_trunc("DAY", "ts").alias("ts"), "model_name").agg(F.sum("cost_usd").alias("cost_usd"))
    windowed = source.groupBy(F.window("ts", f"{days} days", "1 day"), "model_name").agg(F.round(F.sum("cost_usd"), 6).alias("cost_usd"))
    return windowed.select(F.col("window.start").alias("start"), "model_name", "cost_usd")
