"""Dense daily demand panels: one row for each series and day, zeros included."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ORIGIN = "2024-01-01"
KEY = "sku_id"
SEPARATOR = "__"


def day_number(ts: Column, origin: str) -> Column:
    """1 on the day of ``origin``."""
    return (F.datediff(ts.cast("date"), F.lit(origin).cast("date")) + 1).cast("int")


def dense_panel(rows: DataFrame, keys: list[str], active: str = "span", carry: tuple[str, ...] = ()) -> DataFrame:
    """``keys, day, demand, sell_price`` on every day from 1 to the last of all rows, and the series' ``carry`` columns.

    ``rows`` has ``keys``, ``day`` and ``demand``.  ``sell_price`` is 1.0 on active days,
    from a series' first to its last row (``span``) or on all days (``full``), else null.
    Each row is laid out over the days up to the series' next one, so the work is linear in
    the days made; the rows stay dealt by ``keys``, which later windows and groups reuse.
    """
    daily = rows.groupBy(*keys, "day").agg(F.sum("demand").alias("demand"), *(F.first(c).alias(c) for c in carry))
    last = F.broadcast(rows.agg(F.max("day").alias("last_day")))  # one row
    series = W.partitionBy(*keys)
    w = series.orderBy("day")
    found = daily.withColumns({"_before": F.lag("day").over(w), "_next": F.lead("day").over(w), "_lo": F.min("day").over(series), "_hi": F.max("day").over(series)}).crossJoin(last)
    begin = F.when(F.col("_before").isNull(), F.least(F.lit(1), F.col("day"))).otherwise(F.col("day"))
    out = found.withColumn("_at", F.explode(F.sequence(begin, F.coalesce(F.col("_next") - 1, F.col("last_day"))))).filter("_at >= 1")
    on = F.lit(True) if active == "full" else F.col("_at").between(F.col("_lo"), F.col("_hi"))
    return out.select(*keys, *carry, F.col("_at").cast("int").alias("day"), F.when(F.col("_at") == F.col("day"), F.col("demand")).otherwise(0.0).alias("demand"), F.when(on, F.lit(1.0)).alias("sell_price"))


def event_rows(events: DataFrame) -> DataFrame:
    """What the event panel is made of: ``sku_id, user_id, event_type, day, demand``, the demand in whole cents."""
    return events.filter("ts is not null and user_id is not null and event_type is not null").select(
        F.concat_ws(SEPARATOR, F.col("user_id").cast("string"), "event_type").alias(KEY), "user_id", "event_type",
        day_number(F.col("ts"), ORIGIN).alias("day"), F.round(F.col("value") * 100).cast("bigint").cast("double").alias("demand"),
    )


def event_panel(events: DataFrame, active: str = "span") -> DataFrame:
    """Series are (user, event type); demand is the day's value in cents, a whole number."""
    p = dense_panel(event_rows(events), [KEY], active, ("user_id", "event_type"))
    return p.select(
        KEY,
        F.col("user_id").cast("string").alias("item_id"),
        F.col("event_type").alias("store_id"),
        "day",
        F.date_add(F.lit(ORIGIN).cast("date"), F.col("day") - 1).alias("date"),
        "demand",
        "sell_price",
        F.when(F.col("day") % 5 == 0, 1).otherwise(0).alias("snap"),
        F.when((F.col("day") - 1) % 7 == 0, F.lit("EVENT")).alias("event_name_1"),
        F.concat(F.lit("CAT_"), F.col("user_id") % 3).alias("cat_id"),
        F.concat(F.lit("STATE_"), F.col("user_id") % 2).alias("state_id"),
    )


def lineitem_panel(lineitem: DataFrame, part: DataFrame, supplier: DataFrame, nation: DataFrame, region: DataFrame, origin: str = "1995-01-02") -> DataFrame:
    """Series are (brand, region); demand is the shipped quantity.  Catalyst chooses the joins."""
    rows = (
        lineitem.select("l_partkey", "l_suppkey", "l_shipdate", "l_quantity")
        .join(part.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
        .join(supplier.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nation.select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("p_brand").alias("item_id"), F.col("r_name").alias("store_id"), day_number(F.col("l_shipdate"), origin).alias("day"), F.col("l_quantity").alias("demand"))
    )
    return dense_panel(rows.withColumn(KEY, F.concat_ws(SEPARATOR, "item_id", "store_id")), [KEY], carry=("item_id", "store_id"))


def active(panel: DataFrame) -> DataFrame:
    """A null price marks a structural zero: such days are no observations."""
    return panel.filter(F.col("sell_price").isNotNull())


def key_parts(df: DataFrame, key: str = KEY) -> DataFrame:
    """``item_id``, ``store_id``, ``dept_id`` (item without its last token), ``cat_id`` and ``state_id`` from the composite key."""
    item, store = F.split(key, SEPARATOR)[0], F.split(key, SEPARATOR)[1]
    return df.withColumns({"item_id": item, "store_id": store, "dept_id": F.regexp_replace(item, "_[^_]*$", ""), "cat_id": F.substring_index(item, "_", 1), "state_id": F.substring_index(store, "_", 1)})
