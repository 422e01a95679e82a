"""Rolling-origin windows and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rolling_origins(panel: DataFrame, n: int = 2, val_days: int = 7, test_days: int = 7) -> DataFrame:
    """``origin, train_end, val_end, test_start, test_end``: a few rows, counted back from the panel's last day."""
    last = panel.agg(F.max("day").alias("total"))
    rows = last.select("total", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("origin"))
    val_end = F.col("total") - test_days * (n - F.col("origin") + 1)
    return rows.select(
        F.col("origin").cast("int").alias("origin"),
        (val_end - val_days).cast("int").alias("train_end"),
        val_end.cast("int").alias("val_end"),
        (val_end + 1).cast("int").alias("test_start"),
        F.least("total", val_end + test_days).cast("int").alias("test_end"),
    )


def split_days(rows: DataFrame, origins: DataFrame) -> DataFrame:
    """Each row once for every origin in whose validation or test days it lies, with ``split``."""
    inside = (F.col("day") > F.col("train_end")) & (F.col("day") <= F.col("test_end"))
    joined = rows.join(F.broadcast(origins), inside)  # one row for each origin
    return joined.withColumn("split", F.when(F.col("day") <= F.col("val_end"), "val").otherwise("test")).drop("train_end", "test_start")
