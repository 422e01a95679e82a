"""Policies run again under other settings, each with forecasts of its own horizon."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep
from . import features, forecast, origins, policy


@dataclass(frozen=True)
class Variant:
    """How a run differs: review and lead time in days (their sum is the horizon), order rounding, starting stock, cost convention, days before billing, and whether billing stops a horizon before the end."""

    name: str
    review: int = 1
    lead: int = 2
    rounding: str = "none"
    moq: float = 0.0
    start: str = "level"
    convention: str = "per_unit_once"
    warmup: int = 1
    bounded: bool = True

    @property
    def horizon(self) -> int:
        return self.review + self.lead


VARIANTS = (
    Variant("base"),
    Variant("L3", lead=3),
    Variant("L7", lead=7),
    Variant("L14", lead=14),
    Variant("R7", review=7),
    Variant("per_unit_day", convention="per_unit_day"),
    Variant("zero_start", start="zero"),
    Variant("ceil", rounding="ceil"),
    Variant("moq16", rounding="moq", moq=16.0),
    Variant("warmup3", warmup=3),
    Variant("unbounded", bounded=False),
)
PATH = ("sku_id", "model", "origin", "tau")


def horizon_forecasts(panel: DataFrame, models: tuple[str, ...], horizons: tuple[int, ...]) -> DataFrame:
    """``panel``'s columns with ``model, horizon, pred_sum, actual``: every horizon from one pass, since a rate doesn't hang on it and all frames share one sort."""
    df = panel
    for h in horizons:
        df = df.withColumn(f"_a{h}", features.ahead(F.col("demand"), h))
    for m in models:
        df = forecast.RATES[m](df).withColumnRenamed("rate", f"_r_{m}")
    cell: list[Column] = [F.struct(F.lit(m).alias("model"), F.lit(h).alias("horizon"), F.round(F.col(f"_r_{m}") * h, 6).alias("pred_sum"), F.col(f"_a{h}").alias("actual")) for m in models for h in horizons]
    return df.withColumn("_x", F.explode(F.array(*cell))).select(*panel.columns, "_x.*")


def runs(panel: DataFrame, windows: DataFrame, models: tuple[str, ...], variants: tuple[Variant, ...] = VARIANTS, taus: tuple[float, ...] = (0.90, 0.95), scenario: tuple[float, float] = policy.SCENARIOS[0]) -> DataFrame:
    """``sku_id, model, origin, tau, variant`` with totals and costs of every path: forecasts, safety stock and simulation of each variant's own horizon.

    A horizon that leaves a series without a validation error leaves it without a path.
    """
    rows = origins.split_days(horizon_forecasts(panel, models, tuple(sorted({v.horizon for v in variants}))), windows)
    rows = keep(rows.select("sku_id", "day", "demand", "model", "origin", "split", "horizon", "pred_sum", "actual"))
    err = rows.filter("split = 'val'").withColumn("err", F.col("actual") - F.col("pred_sum")).filter("err is not null")
    ss = policy.quantiles(err, ["model", "origin", "horizon", "sku_id"], taus)
    levels = rows.filter("split = 'test'").join(ss, ["model", "origin", "horizon", "sku_id"])
    levels = keep(levels.select(*PATH, "day", "demand", "horizon", F.greatest(F.col("pred_sum") + F.col("ss"), F.lit(0.0)).alias("level")))
    parts = []
    for v in variants:
        trace = policy.simulate_net(levels.filter(F.col("horizon") == v.horizon).drop("horizon"), PATH, v.review, v.lead, v.rounding, v.moq, v.start)
        totals = policy.summarise(trace, PATH, v.warmup, v.horizon, v.bounded)
        parts.append(policy.with_costs(totals, (scenario,), v.convention).withColumn("variant", F.lit(v.name)))
    return reduce(DataFrame.unionByName, parts)


def against_base(costs: DataFrame, models: tuple[str, str]) -> DataFrame:
    """``variant, origin, tau, sku_id, rel``: by how much of the second model's cost the first one's differs, path by path."""
    wide = costs.groupBy("variant", "origin", "tau", "sku_id").pivot("model", list(models)).agg(F.first("cost_total")).na.drop()
    a, b = (F.round(m, 6) for m in models)
    return wide.filter(b != 0).select("variant", "origin", "tau", "sku_id", F.round((a - b) / b, 9).alias("rel"))
