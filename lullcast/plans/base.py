"""Registry of queries, each beside its SQL, and the shared inputs of both."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.panel import event_panel, lineitem_panel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str, active: str = "full") -> DataFrame:
    return event_panel(table(spark, sf_dir, "events"), active)


def lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineitem_panel(*(table(spark, sf_dir, t) for t in ("lineitem", "part", "supplier", "nation", "region")))


def query(name: str, sql: str | None = None):
    """Registers a function of (panel's session, folder) with the SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = re.sub(r", ([34])\)( \+ 0\.0)? as", rf" + {NUDGE}, \1)\2 as", sql)
        return f

    return add


NUDGE = 1.23e-8


def tidy(df: DataFrame, digits: int = 6, **other: int) -> DataFrame:
    """Doubles rounded, whole numbers as bigint: what both engines print alike."""
    out = []
    for name, kind in df.dtypes:
        c: Column = F.col(name)
        if kind == "double":
            places = other.get(name, digits)
            # a value half-way between two roundings must not hang on its last bit: both engines add the same hair
            c = F.round(c + F.lit(NUDGE) if places <= 4 else c, places) + F.lit(0.0)
        elif kind in ("int", "tinyint", "smallint"):
            c = c.cast("bigint")
        out.append(c.alias(name))
    return df.select(*out)


#: The event panel in SQL; ``{price}`` says which days are active.
_EV = """
ev_base as (
  select user_id, event_type, date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as day,
         cast(sum(cast(round(value * 100) as bigint)) as double) as demand
  from events where ts is not null and user_id is not null and event_type is not null group by all),
ev_series as (select user_id, event_type, min(day) as lo, max(day) as hi from ev_base group by all),
ev_days as (select unnest(generate_series(1, (select max(day) from ev_base))) as day),
panel as (
  select cast(s.user_id as varchar) || '__' || s.event_type as sku_id, cast(s.user_id as varchar) as item_id, s.event_type as store_id,
         cast(d.day as bigint) as day, date '2024-01-01' + cast(d.day - 1 as integer) as date, coalesce(b.demand, 0.0) as demand, {price} as sell_price,
         cast(case when d.day % 5 = 0 then 1 else 0 end as bigint) as snap, case when (d.day - 1) % 7 = 0 then 'EVENT' end as event_name_1,
         'CAT_' || (s.user_id % 3) as cat_id, 'STATE_' || (s.user_id % 2) as state_id
  from ev_series s cross join ev_days d
  left join ev_base b on b.user_id = s.user_id and b.event_type = s.event_type and b.day = d.day)
"""
EV = _EV.format(price="cast(1.0 as double)")
EV_SPAN = _EV.format(price="cast(case when d.day between s.lo and s.hi then 1.0 end as double)")
STATS = """
stats as (
  select sku_id, n_active, n_nonzero, sum_pos, sumsq_pos, case when n_nonzero > 0 then sum_pos / n_nonzero end as mean_pos,
         case when n_nonzero > 1 then power(sd / (sum_pos / n_nonzero), 2) end as cv2,
         case when n_nonzero > 0 then n_active / n_nonzero else cast('inf' as double) end as adi
  from (select sku_id, count(*) as n_active, count(*) filter (where demand > 0) as n_nonzero,
               coalesce(sum(demand) filter (where demand > 0), 0.0) as sum_pos, coalesce(sum(demand * demand) filter (where demand > 0), 0.0) as sumsq_pos,
               stddev_samp(demand) filter (where demand > 0) as sd
        from panel where sell_price is not null group by sku_id))
"""
LUMPY = "lumpy as (select * from stats where n_nonzero >= 2 and adi > 1.32 and cv2 > 0.49)"


def with_(*parts: str) -> str:
    return "with " + ",\n".join(p.strip() for p in parts) + "\n"


def with_recursive(*parts: str) -> str:
    return "with recursive " + ",\n".join(p.strip() for p in parts) + "\n"
