"""Queries on models, claims, manifests, names and files."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..operators import claims, classify, features, intermittent, ml, origins, panel
from ..operators.panel import event_rows
from ..sources import retail, synthetic
from ..sources.shared import keep
from .base import EV, STATS, events, query, table, tidy, with_, with_recursive
from .boosted import fits
from .panels import ORIGINS


def _matrix(spark, sf):
    return features.matrix(events(spark, sf))


#: Features known from a series' third day on, so that the first origin has days to learn from.
_EARLY = ("lag_1", "lag_2", "rolling_mean_3", "dow", "is_weekend", "is_event", "snap")


def _each_fit(spark, sf):
    """For each origin and split: until which day is known, and the days to predict."""
    return fits(origins.rolling_origins(event_rows(table(spark, sf, "events")))).orderBy("fit").collect()  # two rows for each origin


@query("rf_direct_forecast")
def rf_direct_forecast(spark, sf):
    """A forest for each origin and split, fitted on what was known, on all of its days."""
    m = keep(_matrix(spark, sf))
    parts = [ml.predict(ml.fit(m, f.until, "forest", _EARLY), m, f.first, f.last, _EARLY).withColumns({"origin": F.lit(f.origin), "split": F.lit(f.split)}) for f in _each_fit(spark, sf)]
    return tidy(reduce(lambda a, b: a.unionByName(b), parts))


@query("rf_importance")
def rf_importance(spark, sf):
    """Each feature's share in each fit."""
    m = keep(_matrix(spark, sf))
    parts = [ml.importances(spark, ml.fit(m, f.until, "forest", _EARLY)).withColumn("fit", F.lit(f.fit)) for f in _each_fit(spark, sf)]
    return tidy(reduce(lambda a, b: a.unionByName(b), parts))


@query("rf_recursive")
def rf_recursive(spark, sf):
    """Fitted one-day forests on their own predictions, from every validation and test day of every origin."""
    names = tuple(n for n in _EARLY)
    p = events(spark, sf)
    m = keep(ml.one_step(p))
    parts = []
    for f in _each_fit(spark, sf):
        forest = ml.trees(ml.fit(m, f.until + 2, "forest", names, (), numTrees=6, maxDepth=4))  # a day's target is known two days later than three days'
        parts.append(ml.recursive(p, forest, 3).filter(F.col("day").between(f.first, f.last)).select("sku_id", "day", F.lit(f.origin).alias("origin"), F.lit(f.split).alias("split"), "pred_sum"))
    return tidy(reduce(lambda a, b: a.unionByName(b), parts))


#: A stored forest of four trees for one day ahead, fitted on the smallest tables.
ONE_DAY = [
    ("dow", 1.5,
     ("rolling_mean_3", 538.83, ("lag_7", 15337.0, 2811.1, 8522.1), ("lag_2", 10875.5, 1390.7, 4973.0)),
     ("lag_7", 11005.5, ("rolling_mean_7", 3613.93, 1885.5, 1034.3), ("event_h", 0.5, 5616.4, 636.3))),
    ("lag_7", 15337.0,
     ("dow", 1.5, ("lag_1", 8617.0, 2588.2, 4604.8), ("rolling_std_7", 1240.3, 1427.8, 2095.3)),
     ("dow", 3.5, ("lag_1", 8617.0, 4003.8, 17668.6), ("rolling_mean_7", 3805.14, 502.4, 4177.2))),
    ("rolling_std_7", 5.29,
     ("dow", 4.5, ("is_event", 0.5, 7634.5, 2490.4), ("weekend_h", 0.5, 1401.1, 1213.7)),
     ("lag_7", 11005.5, ("lag_2", 5630.0, 2144.0, 1718.5), ("rolling_mean_7", 2021.36, 10321.8, 2775.2))),
    ("rolling_mean_3", 5422.5,
     ("lag_2", 109.0, ("weekend_h", 0.5, 2729.1, 1847.8), ("event_h", 0.5, 1645.2, 600.0)),
     ("weekend_h", 0.5, ("snap_h", 0.5, 433.5, 2017.2), ("lag_7", 3419.5, 1294.3, 5750.2))),
]


def _step_sql(k: int) -> str:
    """Step k of the recursion: features of the state ``h`` and the known calendar, the prediction, the next state."""
    return f"""
p{k} as (select *, {ml.as_sql(ONE_DAY)} as p from (select * exclude (d0), h[7] as lag_1, h[6] as lag_2, h[1] as lag_7, list_sum(h[5:7]) / 3 as rolling_mean_3, list_sum(h) / 7 as rolling_mean_7,
  sqrt(greatest(7 * list_sum(list_transform(h, lambda x: x * x)) - power(list_sum(h), 2), 0.0) / 42) as rolling_std_7, isodow(d0 + {k}) - 1 as dow, ev[{k + 1}] as is_event, ev[{k + 2}] as event_h, sn[{k + 1}] as snap, sn[{k + 2}] as snap_h, cast(isodow(d0 + {k + 1}) >= 6 as int) as weekend_h, d0 from s{k}) where h is not null),
s{k + 1} as (select sku_id, day, d0, ev, sn, list_append(h[2:7], p) as h, total + p as total from p{k} where p is not null)"""


_RECURSION = ",".join([f"""
s0 as (select * from (select sku_id, day, date as d0, [cast(event_name_1 is not null as int), lead(cast(event_name_1 is not null as int), 1) over w, lead(cast(event_name_1 is not null as int), 2) over w, lead(cast(event_name_1 is not null as int), 3) over w] as ev,
  [snap, lead(snap, 1) over w, lead(snap, 2) over w, lead(snap, 3) over w] as sn, case when day >= 7 then list(demand) over (partition by sku_id order by day rows between 6 preceding and current row) end as h, 0.0::double as total from panel window w as (partition by sku_id order by day)) where day <= (select max(day) from panel) - 3)""", *map(_step_sql, range(3))])


@query("rf_recursive_frozen", with_(EV, ORIGINS, _RECURSION) + "select sku_id, day, origin, case when day <= val_end then 'val' else 'test' end as split, round(total, 4) as pred_sum from s3 join origins on day > train_end and day <= test_end")
def rf_recursive_frozen(spark, sf):
    """A stored one-day forest on its own predictions, from every validation and test day of every origin."""
    rows = ml.recursive(events(spark, sf), ONE_DAY, 3).filter("pred_sum is not null")
    split = origins.split_days(rows, origins.rolling_origins(event_rows(table(spark, sf, "events"))))
    return tidy(split.select("sku_id", "day", "origin", "split", "pred_sum"), 4)


@query("gbt_forecast")
def gbt_forecast(spark, sf):
    m = _matrix(spark, sf)
    return tidy(ml.predict(ml.fit(m, 23, "boosted", maxIter=5), m, 24, 27))


@query("rf_grid")
def rf_grid(spark, sf):
    return tidy(ml.grid(_matrix(spark, sf), 16, 23, [{"numTrees": 5, "maxDepth": 3}, {"numTrees": 5, "maxDepth": 6}]))


_GRID = "[" + ", ".join(map(repr, intermittent.GRID)) + "]"
#: Every array that is smoothed, then every weight step by step, then the best of each.
_SMOOTHED = f"""
hist as (select sku_id, origin, list(demand order by day) as d from panel join origins on day < test_start group by all),
placed as (select *, list_filter(list_transform(range(1, len(d) + 1), lambda i: case when d[i] > 0 then i end), lambda p: p is not null) as p from hist),
wide as (select *, cast(greatest(1, round_even(p[len(p)] / len(p), 0)) as int) as m from placed where len(p) > 0),
arrays as (select sku_id, origin, 'bucket' as kind, w, list_transform(range(1, len(d) // w + 1), lambda i: list_sum(d[len(d) - (len(d) // w) * w + (i - 1) * w + 1 : len(d) - (len(d) // w) * w + i * w])) as x from (select *, unnest(range(1, m + 1)) as w from wide)
  union all select sku_id, origin, 'size', 0, list_filter(d, lambda v: v > 0) from wide union all select sku_id, origin, 'gap', 0, list_transform(range(1, len(p) + 1), lambda i: cast(p[i] - case when i = 1 then 0 else p[i - 1] end as double)) from wide),
walk(sku_id, origin, kind, w, x, a, i, level, loss) as (select *, unnest({_GRID}), 1::bigint, x[1], 0.0::double from arrays where len(x) > 0
  union all select sku_id, origin, kind, w, x, a, i + 1, a * x[i + 1] + (1 - a) * level, loss + (x[i + 1] - level) * (x[i + 1] - level) from walk where i < len(x)),
best as (select sku_id, origin, kind, w, min({{'s': loss, 'l': level}}).l as level from walk where i = len(x) group by all),
each as (select h.sku_id, h.origin, m, coalesce((select level / m from best b where b.sku_id = h.sku_id and b.origin = h.origin and kind = 'bucket' and b.w = m), 0.0) as adida, coalesce((select sum(level / w) / m from best b where b.sku_id = h.sku_id and b.origin = h.origin and kind = 'bucket'), 0.0) as imapa,
  coalesce((select max(level) filter (where kind = 'size') / max(level) filter (where kind = 'gap') from best b where b.sku_id = h.sku_id and b.origin = h.origin), 0.0) as croston_optimised from hist h left join wide w on w.sku_id = h.sku_id and w.origin = h.origin)
"""


@query("intermittent_rates", with_recursive(EV, ORIGINS, _SMOOTHED) + "select sku_id, origin, x.model, round(case x.model when 'adida' then adida when 'imapa' then imapa else croston_optimised end, 4) as rate from each, (values ('adida'), ('imapa'), ('croston_optimised')) x(model)")
def intermittent_rates(spark, sf):
    """Aggregated and tuned rates of every series at the start of every test."""
    starts = origins.rolling_origins(event_rows(table(spark, sf, "events"))).select("origin", F.col("test_start").alias("start"))
    return tidy(intermittent.rates(events(spark, sf), starts), 4)


@query("leaky_target", with_(EV) + """select sku_id, day, sum(demand) over w + (3 - count(*) over w) * last_value(demand) over (partition by sku_id order by day rows between unbounded preceding and unbounded following) as leaky
from panel window w as (partition by sku_id order by day rows between current row and 2 following)""")
def leaky_target(spark, sf):
    from pyspark.sql import Window as W

    w = W.partitionBy("sku_id").orderBy("day")
    f = w.rowsBetween(0, 2)
    last = F.last("demand").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return tidy(events(spark, sf).select("sku_id", "day", (F.sum("demand").over(f) + (3 - F.count("*").over(f)) * last).alias("leaky")))


@query("missing_series", with_(EV) + "select 'x__' || store_id as sku_id from panel where day = 1 group by 1 union all select sku_id from (select sku_id from panel where day = 1) where false")
def missing_series(spark, sf):
    """Requested series that the panel doesn't have."""
    p = events(spark, sf).filter("day = 1")
    wanted = p.select("sku_id").union(p.select(F.concat(F.lit("x__"), "store_id"))).distinct()
    return wanted.join(p.select("sku_id"), "sku_id", "left_anti")


@query("last_day", with_(EV) + "select max(day) as last_day from panel")
def last_day(spark, sf):
    """The panel's last day, from the footers of its stored rows."""
    stored = keep(event_rows(table(spark, sf, "events")))
    return tidy(retail.last_of(spark, stored.lullcast_path))


CLAIMS = [
    {"id": "A1", "table": "stats", "check": "all_greater", "column": "n_active", "value": 0},
    {"id": "A2", "table": "stats", "check": "range", "column": "adi", "lo": 1, "hi": 30},
    {"id": "A3", "table": "stats", "check": "all_true", "column": "lumpy"},
    {"id": "A4", "table": "types", "check": "sequence", "column": "place", "values": [1, 2, 3, 4, 5], "order": ["store_id"]},
    {"id": "A5", "table": "stats", "check": "count_where", "column": "n_nonzero", "operator": "<", "value": 2, "expected": 0},
    {"id": "A6", "table": "none", "check": "row_count", "value": 1},
    {"id": "A7", "table": "stats", "check": "range", "column": "nothing", "lo": 0, "hi": 1},
    {"id": "A8", "table": "types", "check": "row_count", "value": 5, "mode": "quick"},
]


@query("claim_checks", with_(EV, STATS, "s as (select *, coalesce(adi > 1.32 and cv2 > 0.49, false) as lumpy from stats where n_nonzero >= 2)", "t as (select count(distinct store_id) as n from panel)") + """
select 'A1' as id, case when (select bool_and(n_active > 0) from s) then 'match' else 'mismatch' end as status union all
select 'A2', case when (select min(adi) >= 1 and max(adi) <= 30 from s) then 'match' else 'mismatch' end union all
select 'A3', case when (select bool_and(lumpy) from s) then 'match' else 'mismatch' end union all
select 'A4', case when (select n = 5 from t) then 'match' else 'mismatch' end union all
select 'A5', case when (select count(*) filter (where n_nonzero < 2) = 0 from s) then 'match' else 'mismatch' end union all
select 'A6', 'cannot be verified' union all select 'A7', 'cannot be verified' union all select 'A8', 'cannot be verified'""")
def claim_checks(spark, sf):
    p = events(spark, sf)
    stores = p.groupBy("store_id").agg(F.lit(1).alias("x"))
    from pyspark.sql import Window as W

    # the stores are few
    types = stores.withColumn("place", F.row_number().over(W.orderBy("store_id")))
    return claims.check(spark, CLAIMS, {"stats": classify.classified(p), "types": types}).select("id", "status")


@query("synthetic_profile_stats")
def synthetic_profile_stats(spark, sf):
    """Classes of a generated panel with one series for each part, by the profile that made it."""
    keys = table(spark, sf, "part").select(F.col("p_partkey").alias("s"))
    p = synthetic.panel_of(keys, 200)
    s = classify.classified(panel.active(p)).withColumn("profile", F.col("sku_id").substr(-1, 1))
    return tidy(s.groupBy("profile").agg(F.count("*").alias("n"), F.count_if("lumpy").alias("n_lumpy"), F.avg("adi").alias("adi_mean"), F.avg("cv2").alias("cv2_mean")))
