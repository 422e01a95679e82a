"""Demand rates for every day in one pass over each series.

``rate`` at day t uses the days up to t (``inclusive``) or before t.  Exponential
smoothing is a prefix sum: with k the number of the observation from 0,
f_k = (1-a)^k * sum_{j<=k} w_j x_j (1-a)^-j, w_0 = 1 and w_j = a after that.  The sum
starts anew with every block of observations over which the powers shrink to 1e-100,
and the level at the end of the block before is carried over, so a series may be of any
length (what lies two blocks back weighs less than 1e-100).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ALPHA = 0.1
ALPHA_GRID = (0.05, 0.1, 0.2, 0.3, 0.5)


def _so_far() -> W:
    return W.partitionBy("sku_id").orderBy("day").rowsBetween(W.unboundedPreceding, 0)


def smoothed(df: DataFrame, value: Column, number: Column, alpha: float, name: str, twice: bool = True) -> DataFrame:
    """Adds the smoothing over the rows where ``value`` isn't null; ``number`` counts them from 0.  ``twice`` applies the last observation once more."""
    keep = 1 - alpha
    df = df.withColumn("_v", value)
    recent = F.last("_v", ignorenulls=True).over(_so_far())
    if keep <= 0:
        return df.withColumn(name, recent).drop("_v")
    size = max(1, int(100 / -math.log10(keep)))
    df = df.withColumns({"_n": number.cast("long"), "_b": F.floor(number / size)}).withColumn("_r", F.col("_n") - F.col("_b") * size)
    power = lambda k: F.pow(F.lit(keep), k)
    weight = F.when(F.col("_n") == 0, 1.0).otherwise(alpha)
    block = W.partitionBy("sku_id", "_b").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_l", power(F.col("_r")) * F.sum(weight * F.col("_v") * power(-F.col("_r"))).over(block))
    days = W.partitionBy("sku_id").orderBy("_b", "day")  # the order of days: blocks follow each other
    df = df.withColumn("_e", F.when(F.lead("_b").over(days) > F.col("_b"), F.col("_l")))
    carried = F.last("_e", ignorenulls=True).over(days.rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn("_l", F.col("_l") + power(F.col("_r") + 1) * F.coalesce(carried, F.lit(0.0)))
    level = alpha * F.last("_v", ignorenulls=True).over(days.rowsBetween(W.unboundedPreceding, 0)) + keep * F.col("_l") if twice else F.col("_l")
    return df.withColumn(name, level).drop("_v", "_n", "_b", "_r", "_l", "_e")


def debias(alpha: float) -> float:
    return 1 - alpha / 2


def croston(panel: DataFrame, alpha: float = ALPHA, factor: float | None = None, name: str = "rate") -> DataFrame:
    """Croston's rate with the bias factor; the gap before the first demand is no interval; one demand alone gives its size."""
    factor = debias(alpha) if factor is None else factor
    d = F.col("demand")
    hit = F.when(d > 0, d)
    df = panel.withColumns({"_k": F.sum((d > 0).cast("int")).over(_so_far()) - 1, "_before": F.max(F.when(d > 0, F.col("day"))).over(_so_far().rowsBetween(W.unboundedPreceding, -1))})
    gap = F.when((d > 0) & F.col("_before").isNotNull(), (F.col("day") - F.col("_before")).cast("double"))
    df = smoothed(df, hit, F.greatest(F.col("_k"), F.lit(0)), alpha, "_z")
    df = smoothed(df, gap, F.greatest(F.col("_k") - 1, F.lit(0)), alpha, "_p")
    rate = F.when(F.col("_k") < 0, 0.0).when(F.col("_k") == 0, factor * F.col("_z")).otherwise(factor * F.col("_z") / F.col("_p"))
    return df.withColumn(name, rate).drop("_k", "_before", "_z", "_p")


def ses(panel: DataFrame, alpha: float = ALPHA, name: str = "rate") -> DataFrame:
    k = F.row_number().over(W.partitionBy("sku_id").orderBy("day")) - 1
    return smoothed(panel.withColumn("_k", k), F.col("demand"), F.col("_k"), alpha, name).drop("_k")


def tsb(panel: DataFrame, alpha_d: float = 0.2, alpha_p: float = 0.2, name: str = "rate") -> DataFrame:
    """Teunter-Syntetos-Babai: smoothed demand probability (every day) times smoothed size (demand days)."""
    d = F.col("demand")
    df = panel.withColumns({"_k": F.row_number().over(W.partitionBy("sku_id").orderBy("day")) - 1, "_hits": F.sum((d > 0).cast("int")).over(_so_far()) - 1})
    df = smoothed(df, (d > 0).cast("double"), F.col("_k"), alpha_p, "_pr", twice=False)
    df = smoothed(df, F.when(d > 0, d), F.greatest(F.col("_hits"), F.lit(0)), alpha_d, "_sz", twice=False)
    return df.withColumn(name, F.when(F.col("_hits") < 0, 0.0).otherwise(F.col("_pr") * F.col("_sz"))).drop("_k", "_hits", "_pr", "_sz")


def trailing_mean(panel: DataFrame, width: int, name: str = "rate") -> DataFrame:
    """Mean of the last ``width`` days before t, of fewer at the start; 0 without history.  Width 1 is the naive rate."""
    frame = W.partitionBy("sku_id").orderBy("day").rowsBetween(-width, -1)
    return panel.withColumn(name, F.coalesce(F.sum("demand").over(frame) / F.nullif(F.count("demand").over(frame), F.lit(0)), F.lit(0.0)))


def before(df: DataFrame, name: str = "rate") -> DataFrame:
    """Turns a rate that knows day t into one that knows only the days before."""
    return df.withColumn(name, F.coalesce(F.lag(name).over(W.partitionBy("sku_id").orderBy("day")), F.lit(0.0)))


def tuned_ses_alpha(panel: DataFrame, train_end: int, val_end: int, grid=ALPHA_GRID, error: str = "one_step") -> DataFrame:
    """For each series the grid value with the least mean squared error on validation days; of equal ones the smallest.

    ``one_step``: a day's demand against the forecast from the days before it.  ``in_sample``
    holds that forecast against the last of the days that it knows, as the surveyed study does.
    """
    if error not in ("one_step", "in_sample"):
        raise ValueError(error)
    df = panel
    for i, a in enumerate(grid):
        df = ses(df, a, f"_f{i}")
    w = W.partitionBy("sku_id").orderBy("day")
    seen = F.col("demand") if error == "one_step" else F.lag("demand").over(w)
    first = F.lit(0.0) if error == "one_step" else F.lit(None).cast("double")  # no history: a forecast of 0, or no error
    df = df.withColumns({f"_e{i}": F.round(seen - F.coalesce(F.lag(f"_f{i}").over(w), first), 6) for i in range(len(grid))})
    errors = df.filter(F.col("day").between(train_end + 1, val_end)).groupBy("sku_id").agg(*(F.avg(F.col(f"_e{i}") * F.col(f"_e{i}")).alias(f"_m{i}") for i in range(len(grid))))
    options = F.array(*(F.struct(F.col(f"_m{i}").alias("mse"), F.lit(a).alias("alpha")) for i, a in enumerate(grid)))
    return errors.withColumn("best", F.array_min(options)).select("sku_id", F.col("best.alpha").alias("alpha"), F.col("best.mse").alias("mse"))


#: The named rate models: a function of the panel, and whether its rate already knows only earlier days.
RATES = {
    "naive": lambda p: trailing_mean(p, 1),
    "ma7": lambda p: trailing_mean(p, 7),
    "ma28": lambda p: trailing_mean(p, 28),
    "ses": ses,
    "croston": lambda p: croston(p, factor=1.0),
    "croston_sba": croston,
    "tsb": tsb,
}


def forecasts(panel: DataFrame, models: tuple[str, ...], horizon: int) -> DataFrame:
    """``sku_id, day, model, pred_sum``: each model's rate times the horizon.  All models share one exchange and sort."""
    df = panel
    for m in models:
        df = RATES[m](df).withColumnRenamed("rate", f"_r_{m}")
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), (F.col(f"_r_{m}") * horizon).alias("pred_sum")) for m in models))
    return df.withColumn("_x", F.explode(pairs)).select(*panel.columns, "_x.*")


def side_by_side(a: DataFrame, b: DataFrame, value: str = "pred_sum", keys: tuple[str, ...] = ("sku_id", "day"), suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two models' forecasts of the same series and days."""
    left, right = (x.select(*keys, F.col(value).alias(value + s)) for x, s in zip((a, b), suffixes, strict=True))
    return left.join(right, list(keys))
