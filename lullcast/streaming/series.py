"""Series statistics over a stream of daily demand rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.classify import lumpy, series_stats


def streaming_stats(rows: DataFrame, event_time: str = "ts", delay: str = "2 days") -> DataFrame:
    """The same mergeable sums as in batch, kept as streaming state: one row for each series.  Use ``update`` or ``complete`` mode."""
    return series_stats(rows.withWatermark(event_time, delay)).withColumn("lumpy", lumpy())


def daily_demand(stream: DataFrame, delay: str = "2 days") -> DataFrame:
    """Events to daily demand per series in tumbling days; rows later than ``delay`` are dropped."""
    day = F.window("ts", "1 day")
    return (
        stream.withWatermark("ts", delay)
        .groupBy(day.alias("w"), F.concat_ws("__", F.col("user_id").cast("string"), "event_type").alias("sku_id"))
        .agg(F.sum(F.round(F.col("value") * 100).cast("bigint")).cast("double").alias("demand"))
        .select("sku_id", F.col("w.start").alias("ts"), "demand")
    )
