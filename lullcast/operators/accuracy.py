"""Forecast accuracy over the protection period: absolute, scaled, squared, signed and quantile errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import features


def pinball(error: Column, tau: float) -> Column:
    """The quantile loss of actual minus forecast."""
    return F.when(error >= 0, tau * error).otherwise((tau - 1) * error)


def naive_scale(panel: DataFrame, origins: DataFrame, horizon: int, least: int = 3) -> DataFrame:
    """``sku_id, origin, s1, s2``: mean absolute and squared change of the period's demand up to each origin's last validation day, from ``least`` changes or more."""
    past = panel.select("sku_id", "day", features.ahead(F.col("demand"), horizon).alias("actual")).join(F.broadcast(origins), F.col("day") <= F.col("val_end")).filter("actual is not null")  # one row for each origin
    d = F.col("actual") - F.lag("actual").over(W.partitionBy("sku_id", "origin").orderBy("day"))
    changes = past.withColumn("d", d).filter("d is not null").groupBy("sku_id", "origin")
    return changes.agg(F.avg(F.abs("d")).alias("s1"), F.avg(F.col("d") * F.col("d")).alias("s2"), F.count("*").alias("nd")).filter(F.col("nd") >= least).drop("nd")


def metrics(rows: DataFrame, scale: DataFrame, tau: float = 0.95, daily: bool = False) -> DataFrame:
    """``model, origin, split, sku_id, n, mae, mase, rmsse, me, pinball`` from forecasts with what came.

    ``rows`` has ``actual`` (demand over the protection period) and ``pred_sum``.  With ``daily``
    there is ``mae_core`` too: the forecast of the period against the one day's demand.
    """
    e = F.col("actual") - F.col("pred_sum")
    found = rows.filter("actual is not null").withColumn("e", e)
    core = [F.avg(F.abs(F.col("demand") - F.col("pred_sum"))).alias("mae_core")] if daily else []
    acc = found.groupBy("model", "origin", "split", "sku_id").agg(F.count("*").alias("n"), F.avg(F.abs("e")).alias("mae"), F.avg(F.col("e") * F.col("e")).alias("mse"), F.avg("e").alias("me"), F.avg(pinball(F.col("e"), tau)).alias("pinball"), *core)
    zero = F.lit(0.0)
    out = acc.join(scale, ["sku_id", "origin"], "left")
    return out.select("model", "origin", "split", "sku_id", "n", "mae", (F.col("mae") / F.nullif("s1", zero)).alias("mase"), F.sqrt(F.col("mse") / F.nullif("s2", zero)).alias("rmsse"), "me", "pinball", *(["mae_core"] if daily else []))
