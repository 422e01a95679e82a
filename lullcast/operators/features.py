"""Leakage-aware lag, rolling and look-ahead features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LAGS, MEANS, STDS, HORIZON = (1, 2, 7), (3, 7), (7,), 3


def by_day(*keys: str) -> W:
    return W.partitionBy(*(keys or ("sku_id",))).orderBy("day")


def guarded(agg: Column, value: Column, frame: W, width: int) -> Column:
    """``agg`` over ``frame``, null until the frame holds ``width`` values."""
    return F.when(F.count(value).over(frame) == width, agg)


def rolling_mean(value: Column, width: int, last: int = 0) -> Column:
    f = by_day().rowsBetween(last - width + 1, last)
    return guarded(F.sum(value).over(f) / F.lit(float(width)), value, f, width)


def rolling_std(value: Column, width: int, last: int = 0) -> Column:
    """Sample deviation from sums of whole numbers, which are exact."""
    f = by_day().rowsBetween(last - width + 1, last)
    s, q = F.sum(value).over(f), F.sum(value * value).over(f)
    return guarded(F.sqrt(F.greatest(width * q - s * s, F.lit(0.0)) / float(width * (width - 1))), value, f, width)


def ahead(value: Column, horizon: int) -> Column:
    """Sum over the next ``horizon`` days, null where they aren't all there."""
    f = by_day().rowsBetween(1, horizon)
    return guarded(F.sum(value).over(f), value, f, horizon)


def lags(panel: DataFrame, days=LAGS, legacy: bool = False) -> DataFrame:
    """``lag_l`` is the demand l-1 days ago (lag_1 is today's); under ``legacy`` l days ago."""
    shift = lambda n: F.lag("demand", n).over(by_day()) if n else F.col("demand")
    return panel.withColumns({f"lag_{n}": shift(n if legacy else n - 1) for n in days})


def rolling(panel: DataFrame, means=MEANS, stds=STDS, legacy: bool = False) -> DataFrame:
    d, last = F.col("demand"), -1 if legacy else 0
    return panel.withColumns({f"rolling_mean_{w}": rolling_mean(d, w, last) for w in means} | {f"rolling_std_{w}": rolling_std(d, w, last) for w in stds})


def calendar(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """Today's and the next days' known calendar: events, snap days, weekends (Monday is 0)."""
    dow = F.weekday("date")
    flags = {"is_event": F.col("event_name_1").isNotNull().cast("int"), "is_weekend": (dow >= 5).cast("int")}
    out = panel.withColumns({"dow": dow, "month": F.month("date"), **flags})
    return out.withColumns({"event_h": ahead(F.col("is_event"), horizon), "snap_h": ahead(F.col("snap"), horizon), "weekend_h": ahead(F.col("is_weekend"), horizon)})


def matrix(panel: DataFrame, horizon: int = HORIZON) -> DataFrame:
    """All features and the target: demand over the next ``horizon`` days."""
    return calendar(rolling(lags(panel)), horizon).withColumn("target", ahead(F.col("demand"), horizon))


def complete(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.na.drop(subset=columns)


def identity_codes(df: DataFrame, columns: list[str]) -> DataFrame:
    """For each column its sorted distinct values with codes from 0: ``column, value, code``."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").distinct()
    return long.withColumn("code", (F.row_number().over(W.partitionBy("column").orderBy("value")) - 1).cast("int"))


def leakage(df: DataFrame, columns: list[str], target: str = "target") -> DataFrame:
    """``feature, abs_corr``: the absolute correlation of each feature with the target."""
    row = df.agg(*(F.abs(F.corr(c, target)).alias(c) for c in columns))
    return row.unpivot([], columns, "feature", "abs_corr")
