"""A synthetic retail panel: four demand profiles, a weekly season, events, snap days and active windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Chance of a demand day, mean size, and spread of the size: smooth, erratic, intermittent, lumpy.
PROFILES = ((0.95, 8.0, 0.3), (0.9, 8.0, 1.2), (0.3, 4.0, 0.3), (0.25, 6.0, 1.2))


def synthetic_panel(spark: SparkSession, series: int = 150, days: int = 900, stores: int = 4, categories: int = 3, seed: int = 42, start: str = "2020-01-01") -> DataFrame:
    """A panel of ``series`` numbered series."""
    return panel_of(spark.range(series).withColumnRenamed("id", "s"), days, stores, categories, seed, start)


def panel_of(keys: DataFrame, days: int = 900, stores: int = 4, categories: int = 3, seed: int = 42, start: str = "2020-01-01") -> DataFrame:
    """One series for each number ``s`` of ``keys``: each cell's draws come from a hash of (seed, series, day), so partitioning does not change them."""
    u = lambda *salt: (F.pmod(F.xxhash64(F.lit(seed), *map(F.lit, salt), "s", "day"), F.lit(1_000_003)) + 1) / 1_000_004.0
    base = keys.select("s").withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(days))))
    pick = lambda i: F.element_at(F.array(*(F.lit(p[i]) for p in PROFILES)), (F.col("s") % len(PROFILES) + 1).cast("int"))
    normal = F.sqrt(-2 * F.log(u("a"))) * F.cos(2 * 3.141592653589793 * u("b"))
    season = 1 + 0.2 * F.sin(2 * 3.141592653589793 * F.col("day") / 7)
    size = F.greatest(F.lit(1.0), F.round(pick(1) * season * F.exp(pick(2) * normal - pick(2) * pick(2) / 2)))
    first = F.pmod(F.xxhash64(F.lit(seed), F.lit("first"), "s"), F.lit(max(1, days // 5))) + 1
    event = F.col("day") % 97 == 0
    store = F.col("s") % stores
    return base.select(
        F.format_string("ITEM_%05d", F.floor(F.col("s") / stores)).alias("item_id"),
        F.concat(F.lit("ST_"), store).alias("store_id"),
        F.concat(F.format_string("ITEM_%05d", F.floor(F.col("s") / stores)), F.lit("__ST_"), store).alias("sku_id"),
        "day",
        F.date_add(F.lit(start).cast("date"), F.col("day") - 1).alias("date"),
        F.when((F.col("day") >= first) & (u("c") < pick(0) * F.when(event, 1.3).otherwise(1.0)), size).otherwise(0.0).alias("demand"),
        F.when(F.col("day") >= first, 1.0 + F.col("s") % 9).alias("sell_price"),
        (F.dayofmonth(F.date_add(F.lit(start).cast("date"), F.col("day") - 1)) <= 10).cast("int").alias("snap"),
        F.when(event, F.lit("EVENT")).alias("event_name_1"),
        F.concat(F.lit("CAT_"), F.col("s") % categories).alias("cat_id"),
        F.concat(F.lit("STATE_"), store % 2).alias("state_id"),
    )
