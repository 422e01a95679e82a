"""Series statistics and the lumpy class (inter-demand interval and size variability)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADI_MIN, CV2_MIN, MIN_NONZERO = 1.32, 0.49, 2


def _moments() -> list[Column]:
    d = F.col("demand")
    return [
        F.count("*").alias("n_active"),
        F.count_if(d > 0).alias("n_nonzero"),
        F.sum(F.when(d > 0, d).otherwise(0.0)).alias("sum_pos"),
        F.sum(F.when(d > 0, d * d).otherwise(0.0)).alias("sumsq_pos"),
    ]


def _finish(df: DataFrame) -> DataFrame:
    """Mean, CV2 (null below two demands) and ADI from mergeable sums; the variance numerator is exact for whole-number demand."""
    n, s, q = F.col("n_nonzero"), F.col("sum_pos"), F.col("sumsq_pos")
    var = F.when(n > 1, F.greatest((n * q - s * s) / F.nullif(n * (n - 1), F.lit(0)), F.lit(0.0)))  # greatest passes over nulls
    mean = s / F.nullif(n, F.lit(0))
    return df.withColumns({"mean_pos": mean, "cv2": var / F.nullif(mean * mean, F.lit(0.0)), "adi": F.when(n > 0, F.col("n_active") / F.nullif(n, F.lit(0))).otherwise(F.lit(float("inf")))})


def series_stats(active_rows: DataFrame, by: tuple[str, ...] = ("sku_id",)) -> DataFrame:
    """One hash aggregation with partial sums."""
    return _finish(active_rows.groupBy(*by).agg(*_moments()))


def extended_stats(active_rows: DataFrame, by: tuple[str, ...] = ("sku_id",)) -> DataFrame:
    """Also the first and last active and selling days (null if never sold) and total demand."""
    sold = F.when(F.col("demand") > 0, F.col("day"))
    extra = [F.min("day").alias("first_active"), F.max("day").alias("last_active"), F.min(sold).alias("first_sale"), F.max(sold).alias("last_sale"), F.sum("demand").alias("demand_total")]
    return _finish(active_rows.groupBy(*by).agg(*_moments(), *extra))


def lumpy(adi_min: float = ADI_MIN, cv2_min: float = CV2_MIN) -> Column:
    """Both bounds are strict; a series without a CV2 isn't lumpy."""
    return F.coalesce((F.col("adi") > adi_min) & (F.col("cv2") > cv2_min), F.lit(False))


def classified(active_rows: DataFrame, adi_min: float = ADI_MIN, cv2_min: float = CV2_MIN, min_nonzero: int = MIN_NONZERO) -> DataFrame:
    return series_stats(active_rows).filter(F.col("n_nonzero") >= min_nonzero).withColumn("lumpy", lumpy(adi_min, cv2_min))


def churn(active_rows: DataFrame, until: int) -> DataFrame:
    """How the lumpy population changes if only days up to ``until`` are seen: kept, dropped, new."""
    whole = classified(active_rows).filter("lumpy").select("sku_id", F.lit(1).alias("w"))
    early = classified(active_rows.filter(F.col("day") <= until)).filter("lumpy").select("sku_id", F.lit(1).alias("e"))
    both = whole.join(early, "sku_id", "full")
    return both.agg(F.count_if(F.expr("w is not null and e is not null")).alias("kept"), F.count_if(F.expr("e is null")).alias("dropped"), F.count_if(F.expr("w is null")).alias("new"))
