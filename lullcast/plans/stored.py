"""Queries that write files and read them again: long and wide CSV, calendar, sinks, checksums, audits, claims over them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims, classify
from ..sources import artefacts, retail
from ..sources.shared import keep, place
from .base import EV, EV_SPAN, STATS, events, query, table, tidy, with_


@query("long_csv_scan", with_(EV_SPAN) + "select sku_id, day, demand, sell_price, cast(date as varchar) as date, snap, event_name_1, cat_id, state_id from panel")
def long_csv_scan(spark, sf):
    """The panel as compressed long CSV with a further column, read by the long reader: only known columns, typed, come back."""
    where = place(spark)
    events(spark, sf, "span").withColumn("note", F.lit("x")).write.option("header", True).option("compression", "gzip").csv(where)
    back = retail.read_long(spark, where).withColumn("date", F.col("date").cast("string"))
    return tidy(back.select("sku_id", "day", "demand", "sell_price", "date", "snap", "event_name_1", "cat_id", "state_id"))


def _calendar(p, where):
    flags = {"snap_STATE_0": F.when(F.col("day") % 4 != 0, (F.col("day") % 2).cast("int")), "snap_STATE_1": (F.col("day") % 3 == 0).cast("int")}
    days = p.select("day", "date", "event_name_1").distinct()
    days.select(F.concat(F.lit("d_"), "day").alias("d"), "date", F.expr("cast((day - 1) div 7 + 1 as int)").alias("wm_yr_wk"), "event_name_1", *(c.alias(k) for k, c in flags.items())).write.option("header", True).csv(where)


_WIDE = """
select sku_id, day, demand, case when sum(demand) over (partition by sku_id, (day - 1) // 7) > 0 then 1 + 0.25 * ((day - 1) // 7 + 1) end as sell_price,
  cast(case when state_id = 'STATE_0' then case when day % 4 <> 0 then day % 2 else 0 end else cast(day % 3 = 0 as int) end as bigint) as snap, cat_id || '_1' as dept_id, store_id from panel"""


@query("wide_csv_etl", with_(EV) + _WIDE)
def wide_csv_etl(spark, sf):
    """Wide sales, calendar and weekly prices as CSV, through the wide reader into Parquet by store, and back."""
    p = keep(events(spark, sf))
    sales, calendar, prices, out = (place(spark) for _ in range(4))
    days = range(1, (p.agg(F.max("day")).first()[0] or 0) + 1)
    ids = ["item_id", "dept_id", "cat_id", "store_id", "state_id"]
    wide = p.withColumn("dept_id", F.concat("cat_id", F.lit("_1"))).groupBy(*ids).pivot("day", list(days)).agg(F.first("demand"))
    wide.toDF(*ids, *(f"d_{i}" for i in days)).write.option("header", True).csv(sales)
    _calendar(p, calendar)
    week = F.expr("cast((day - 1) div 7 + 1 as int)").alias("wm_yr_wk")
    sold = p.groupBy("store_id", "item_id", week).agg(F.sum("demand").alias("sold")).filter("sold > 0")
    sold.select("store_id", "item_id", "wm_yr_wk", (1 + 0.25 * F.col("wm_yr_wk")).alias("sell_price")).write.option("header", True).csv(prices)
    artefacts.write_parquet(retail.read_wide(spark, sales, calendar, prices, ["STATE_0", "STATE_1"]), out, ("store_id",))
    return tidy(spark.read.parquet(out).select("sku_id", "day", "demand", "sell_price", "snap", "dept_id", "store_id"))


@query("calendar_any_flag", with_(EV) + "select distinct day, cast(date as varchar) as date, event_name_1, cast(greatest(case when day % 4 <> 0 then day % 2 else 0 end, cast(day % 3 = 0 as int)) as bigint) as snap from panel")
def calendar_any_flag(spark, sf):
    """A calendar CSV: its flag says whether any state has one; an empty flag is none."""
    where = place(spark)
    _calendar(events(spark, sf), where)
    return tidy(retail.read_calendar(spark, where).select("day", "date", "event_name_1", "snap"))


@query("statistics_sinks", with_(EV, STATS) + "select sku_id, cast(n_nonzero as bigint) as n_nonzero, round(adi, 6) as adi, round(cv2, 6) as cv2, true as same from stats where n_nonzero > 0")
def statistics_sinks(spark, sf):
    """Series statistics as ordered, rounded, compressed CSV and as Parquet of fewer columns, read again and held against each other."""
    s = keep(classify.series_stats(events(spark, sf)).filter("n_nonzero > 0").select("sku_id", F.col("n_nonzero").cast("long").alias("n_nonzero"), "adi", "cv2"))
    text, columns = place(spark), place(spark)
    artefacts.write_csv(s, text, ["sku_id"], compress=True)
    artefacts.write_parquet(s.select("sku_id", "adi"), columns)
    back = spark.read.option("header", True).schema("sku_id string, n_nonzero long, adi double, cv2 double").csv(text)
    both = back.join(spark.read.parquet(columns).withColumnRenamed("adi", "_adi"), "sku_id", "full")
    return tidy(both.select("sku_id", "n_nonzero", "adi", "cv2", (F.abs(F.col("adi") - F.col("_adi")) < 1e-6).alias("same")))


@query("first_orders", "select o_custkey, min(o_orderkey) as o_orderkey, arg_min(o_totalprice, o_orderkey) as o_totalprice from orders where o_custkey is not null group by 1")
def first_orders(spark, sf):
    """One row for each key: a customer's first order."""
    rows = table(spark, sf, "orders").filter("o_custkey is not null").select("o_custkey", "o_totalprice", "o_orderkey", F.col("o_orderkey").alias("place"))
    return tidy(retail.one_per_key(rows, ["o_custkey"], "place").select("o_custkey", "o_orderkey", "o_totalprice"))


_REPORT = """'[' || chr(10) || '  {' || chr(10) || '    "event_type": "' || event_type || '",' || chr(10) || '    "n": ' || n || chr(10) || '  }' || chr(10) || ']'"""


@query("folder_checksums", f"select event_type || '.json' as path, sha256({_REPORT}) as sha256 from (select event_type, count(*) as n from events where event_type is not null group by 1)")
def folder_checksums(spark, sf):
    """A summary file for each event type, and the checksums of their folder without its manifest."""
    counts = keep(table(spark, sf, "events").filter("event_type is not null").groupBy("event_type").agg(F.count("*").alias("n")))
    where = place(spark)
    for r in artefacts.few(counts):  # a file each
        artefacts.write_text(spark, f"{where}/{r.event_type}.json", artefacts.summary_json(counts.filter(F.col("event_type") == r.event_type), ["event_type"]))
    artefacts.write_text(spark, f"{where}/manifest.sha256.json", artefacts.manifest(spark, where))
    return artefacts.checksums(spark, where)


_REQUIRED = {"region": (5, ("r_name",)), "events": (100_000_000, ("ts", "value")), "orders": (1, ("o_orderkey", "o_nothing")), "absent": (1, ("x",))}


@query("artefact_audit", """
select 'region' as artefact, true as present, count(*) as n_rows, '' as missing_columns, count(*) >= 5 as ok from region union all
select 'events', true, count(*), '', count(*) >= 100000000 from events union all
select 'orders', true, count(*), 'o_nothing', false from orders union all
select 'absent', false, null, 'x', false""")
def artefact_audit(spark, sf):
    found = artefacts.audit(spark, _REQUIRED, {t: table(spark, sf, t) for t in ("region", "events", "orders")})
    return found.withColumn("missing_columns", F.array_join("missing_columns", ","))


_STORED_CLAIMS = [
    {"id": "B1", "table": "means", "check": "row_count", "value": 10},
    {"id": "B2", "table": "means", "check": "lower_everywhere", "by": "store_id", "model_column": "part", "column": "mean", "models": ["weekend", "weekday"]},
    {"id": "B3", "table": "stats", "check": "count_where", "column": "n_nonzero", "operator": ">=", "value": 2, "expected": 0, "filter": {"store_id": "click"}},
    {"id": "B4", "table": "stats", "check": "all_less", "column": "adi", "value": 40, "filter": {"store_id": "purchase"}},
    {"id": "B5", "table": "stats", "check": "range", "column": "adi", "lo": 1, "hi": 40, "filter": {"store_id": "nowhere"}},
    {"id": "B6", "table": "means", "check": "row_count", "value": 9, "tolerance": 1, "mode": "full"},
]
_CHECKED = """
s as (select stats.*, split_part(sku_id, '__', 2) as store_id from stats where n_nonzero > 0),
means as (select store_id, case when isodow(date) >= 6 then 'weekend' else 'weekday' end as part, avg(demand) as mean from panel group by all),
sides as (select store_id, max(mean) filter (where part = 'weekend') as a, max(mean) filter (where part = 'weekday') as b from means group by 1),
facts as (select 'B1' as id, (select count(*) = 10 from means) as ok union all select 'B2', (select bool_and(a < b) from sides where a is not null and b is not null)
  union all select 'B3', (select case when count(*) > 0 then count(*) filter (where n_nonzero >= 2) = 0 end from s where store_id = 'click')
  union all select 'B4', (select bool_and(adi < 40) from s where store_id = 'purchase') union all select 'B5', (select case when count(*) > 0 then min(adi) >= 1 and max(adi) <= 40 end from s where store_id = 'nowhere')
  union all select 'B6', (select abs(count(*) - 9) <= 1 from means)),
checked as (select id, case when ok then 'match' when not ok then 'mismatch' else 'cannot be verified' end as status from facts)
"""


def _checked(spark, sf):
    p = events(spark, sf)
    s = classify.series_stats(p).filter("n_nonzero > 0").withColumn("store_id", F.element_at(F.split("sku_id", "__"), 2))
    part = F.when(F.weekday("date") >= 5, "weekend").otherwise("weekday")
    means = p.groupBy("store_id", part.alias("part")).agg(F.avg("demand").alias("mean"))
    return claims.check(spark, _STORED_CLAIMS, {"stats": keep(s), "means": keep(means)})


@query("filtered_claims", with_(EV, STATS, _CHECKED) + "select id, status from checked")
def filtered_claims(spark, sf):
    """Claims on rows that equal given values, of two models everywhere, and on numbers of rows."""
    return _checked(spark, sf).select("id", "status")


@query("claim_summary", with_(EV, STATS, _CHECKED) + "select status, count(*) as n from checked group by 1")
def claim_summary(spark, sf):
    return claims.summary(_checked(spark, sf))
