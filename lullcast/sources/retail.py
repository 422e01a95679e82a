"""Readers of long and wide retail panels, calendar and price joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ("item_id", "store_id", "day", "demand", "sell_price")
OPTIONAL = ("date", "snap", "event_name_1", "cat_id", "state_id")


def require_columns(df: DataFrame, columns=REQUIRED) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    """A dimension must have one row for each key, or joins would multiply rows."""
    if not df.groupBy(*keys).count().filter("count > 1").isEmpty():
        raise ValueError(f"repeated keys: {', '.join(keys)}")
    return df


def normalise(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """The canonical long panel: ``sku_id``, typed columns, defaults for absent ones, others dropped."""
    require_columns(df)
    df = df.select(*(c for c in (*REQUIRED, *OPTIONAL, *extra) if c in df.columns))
    typed = {"sku_id": F.concat_ws("__", "item_id", "store_id"), "day": F.col("day").cast("int"), "demand": F.col("demand").cast("double"), "sell_price": F.expr("try_cast(sell_price as double)")}
    if "date" in df.columns:
        typed["date"] = F.expr("try_cast(date as date)")
    typed["snap"] = F.coalesce(F.col("snap").cast("int"), F.lit(0)) if "snap" in df.columns else F.lit(0)
    typed["cat_id"] = F.coalesce("cat_id", F.lit("CAT")) if "cat_id" in df.columns else F.lit("CAT")
    typed["state_id"] = F.coalesce("state_id", F.lit("STATE")) if "state_id" in df.columns else F.lit("STATE")
    return df.withColumns(typed)


def read_long(spark: SparkSession, path: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """A long CSV (compressed by extension)."""
    df = spark.read.option("header", True).csv(path)
    return normalise(df.withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("demand", "sell_price") if c in df.columns}), extra)


def unpivot_days(wide: DataFrame, ids: list[str], prefix: str = "d_") -> DataFrame:
    """One row for each ``d_<n>`` column: ``day`` and ``demand``."""
    days = [c for c in wide.columns if c.startswith(prefix)]
    return wide.unpivot(ids, days, "_d", "demand").withColumn("day", F.regexp_replace("_d", f"^{prefix}", "").cast("int")).drop("_d")


def join_calendar(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Left join on the day; Spark broadcasts the calendar if it is small."""
    return panel.join(calendar, "day", "left")


def join_prices(panel: DataFrame, prices: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on item, store and week; Spark picks the side by size."""
    return panel.join(prices, keys, "left")


def pick_state_flag(df: DataFrame, states: list[str], flag: str = "snap") -> DataFrame:
    """``flag`` := ``flag_<state>`` of the row's own state."""
    pick = F.lit(None)
    for s in states:
        pick = F.when(F.col("state_id") == s, F.col(f"{flag}_{s}")).otherwise(pick)
    return df.withColumn(flag, pick.cast("int"))


def read_wide(spark: SparkSession, sales: str, calendar: str, prices: str, states: list[str]) -> DataFrame:
    """Wide sales with calendar and weekly prices: the long panel, with each state's own flag."""
    read = lambda p: spark.read.option("header", True).csv(p)
    ids = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
    cal = read(calendar).withColumn("day", F.regexp_replace("d", "^d_", "").cast("int")).drop("d")
    long = join_calendar(unpivot_days(read(sales), ids), require_unique(cal, ["day"]))
    keys = ["store_id", "item_id", "wm_yr_wk"]
    return normalise(pick_state_flag(join_prices(long, require_unique(read(prices), keys), keys), states).withColumns({c: F.expr(f"try_cast({c} as double)") for c in ("demand", "sell_price")}), ("dept_id",))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    """A calendar CSV with ``day`` from ``d_<n>``, and ``snap``: whether any state's flag is set."""
    cal = spark.read.option("header", True).csv(path)
    flags = [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in cal.columns if c.startswith("snap_")]
    snap = F.greatest(F.lit(0), *flags) if flags else F.lit(0)
    return require_unique(cal.withColumns({"day": F.regexp_replace("d", "^d_", "").cast("int"), "snap": snap}).drop("d"), ["day"])


def read_keys(spark: SparkSession, path: str, names: tuple[str, str], keys: list[tuple], columns: list[str]) -> DataFrame:
    """``columns`` of the rows whose pair ``names`` is one of ``keys``; a pair without rows is an error.

    Both columns' values are filters that reach the Parquet scan; the pairs themselves, as
    many as the caller lists, are a broadcast semi join on what is left.
    """
    first, second = (sorted({k[i] for k in keys}) for i in (0, 1))
    rows = spark.read.parquet(path)
    wanted = F.broadcast(spark.createDataFrame(keys, rows.select(*names).schema))
    found = rows.filter(F.col(names[0]).isin(first) & F.col(names[1]).isin(second)).select(*dict.fromkeys((*names, *columns))).join(wanted, list(names), "left_semi")
    if missing := set(map(tuple, keys)) - {tuple(r) for r in found.select(*names).distinct().collect()}:  # as many as the keys at most
        raise ValueError(f"series without rows: {sorted(missing)}")
    return found.select(*columns)


def one_per_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Of rows with the same key the one that is first in ``order``."""
    others = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*others), order).alias("_x")).select(*keys, *(F.col(f"_x.{c}").alias(c) for c in others))


def last_of(spark: SparkSession, path: str, column: str = "day", name: str = "last_day") -> DataFrame:
    """The largest value of a whole-number or date column of Parquet files, from their footers: no column data is read.

    The pushed aggregate is a setting of the reader, so it is set in a session of its own over the same context.
    """
    footers = spark.newSession()
    footers.conf.set("spark.sql.sources.useV1SourceList", "")
    footers.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    return footers.read.parquet(path).agg(F.max(column).alias(name))
