"""Queries on panels, series classes, samples and features."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import classify, features, forecast, origins, panel, sampling
from .base import EV, EV_SPAN, LUMPY, STATS, events, lineitems, query, table, tidy, with_

_STAT_COLS = "cast(n_active as bigint) as n_active, cast(n_nonzero as bigint) as n_nonzero, round(sum_pos, 6) as sum_pos, round(sumsq_pos, 6) as sumsq_pos, round(mean_pos, 6) as mean_pos, round(cv2, 6) as cv2, round(adi, 6) as adi"
_PANEL_COLS = "sku_id, item_id, store_id, day, date, demand, sell_price, snap, event_name_1, cat_id, state_id"


@query("daily_panel", with_(EV_SPAN) + f"select {_PANEL_COLS} from panel")
def daily_panel(spark, sf):
    return tidy(events(spark, sf, "span"))


@query("active_period", with_(EV_SPAN) + f"select {_PANEL_COLS} from panel where sell_price is not null")
def active_period(spark, sf):
    return tidy(panel.active(events(spark, sf, "span")))


@query("series_stats", with_(EV_SPAN, STATS) + f"select sku_id, {_STAT_COLS} from stats")
def series_stats(spark, sf):
    return tidy(classify.series_stats(panel.active(events(spark, sf, "span"))))


@query("series_stats_extended", with_(EV_SPAN, STATS) + f"""
select s.sku_id, {_STAT_COLS}, first_active, last_active, first_sale, last_sale, demand_total
from stats s join (select sku_id, min(day) as first_active, max(day) as last_active, min(day) filter (where demand > 0) as first_sale,
  max(day) filter (where demand > 0) as last_sale, sum(demand) as demand_total from panel where sell_price is not null group by 1) e using (sku_id)""")
def series_stats_extended(spark, sf):
    return tidy(classify.extended_stats(panel.active(events(spark, sf, "span"))))


@query("lumpy_classification", with_(EV, STATS) + f"select sku_id, {_STAT_COLS}, coalesce(adi > 1.32 and cv2 > 0.49, false) as lumpy from stats where n_nonzero >= 2")
def lumpy_classification(spark, sf):
    return tidy(classify.classified(events(spark, sf)))


@query("lumpy_restricted_churn", with_(EV, STATS, LUMPY, STATS.replace("stats as", "early as", 1).replace("sell_price is not null", "sell_price is not null and day <= 20"), "cut as (select * from early where n_nonzero >= 2 and adi > 1.32 and cv2 > 0.49)") + """
select count(*) filter (where l.sku_id is not null and c.sku_id is not null) as kept, count(*) filter (where c.sku_id is null) as dropped, count(*) filter (where l.sku_id is null) as new
from lumpy l full join cut c on l.sku_id = c.sku_id""")
def lumpy_restricted_churn(spark, sf):
    return classify.churn(events(spark, sf), 20)


_LI = """
li as (select p_brand as item_id, r_name as store_id, date_diff('day', date '1995-01-02', cast(l_shipdate as date)) + 1 as day, sum(l_quantity) as demand
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by all),
panel as (select s.item_id || '__' || s.store_id as sku_id, d.day, coalesce(b.demand, 0.0) as demand, cast(case when d.day between lo and hi then 1.0 end as double) as sell_price
  from (select item_id, store_id, min(day) as lo, max(day) as hi from li group by all) s cross join (select unnest(generate_series(1, (select max(day) from li))) as day) d
  left join li b on b.item_id = s.item_id and b.store_id = s.store_id and b.day = d.day)
"""


@query("shipment_series_stats", with_(_LI, STATS) + f"select sku_id, {_STAT_COLS}, coalesce(adi > 1.1 and cv2 > 0.4, false) as lumpy from stats where n_nonzero >= 2")
def shipment_series_stats(spark, sf):
    return tidy(classify.classified(panel.active(lineitems(spark, sf)), 1.1, 0.4))


@query("key_parts", with_(EV) + """select distinct sku_id, item_id, store_id, regexp_replace(item_id, '_[^_]*$', '') as dept_id, split_part(item_id, '_', 1) as cat_id, split_part(store_id, '_', 1) as state_id from panel""")
def key_parts(spark, sf):
    return panel.key_parts(events(spark, sf).select("sku_id").distinct())


_STRATA = """
pop as (select l.*, p.cat_id, p.state_id, row_number() over (order by adi, l.sku_id) as ra, row_number() over (order by cv2, l.sku_id) as rc, count(*) over () as nn
  from lumpy l join (select distinct sku_id, cat_id, state_id from panel) p on p.sku_id = l.sku_id),
quart as (select *, case when ra <= 1 + (nn - 1) * 1 / 4.0 then 0 when ra <= 1 + (nn - 1) * 2 / 4.0 then 1 when ra <= 1 + (nn - 1) * 3 / 4.0 then 2 else 3 end as adi_q,
  case when rc <= 1 + (nn - 1) * 1 / 4.0 then 0 when rc <= 1 + (nn - 1) * 2 / 4.0 then 1 when rc <= 1 + (nn - 1) * 3 / 4.0 then 2 else 3 end as cv2_q from pop),
strata as (select *, adi_q || '-' || cv2_q || '-' || cat_id || '-' || state_id as stratum from quart),
sizes as (select stratum, count(*) as available, (select count(*) from strata) as n_all from strata group by 1)
"""
_CORE_ALLOC = "alloc as (select stratum, available, least(available, greatest(1, cast(round_even(40.0 * available / n_all, 0) as bigint))) as take from sizes)"
_LR_ALLOC = """
shares as (select *, 40.0 * available / n_all as share from sizes),
floors as (select *, floor(share) as low, share - floor(share) as frac from shares),
placed as (select *, row_number() over (order by round(frac, 12) desc, stratum) as place, 40 - sum(low) over () as rest from floors),
alloc as (select stratum, available, cast(least(available, low + case when place <= rest then 1 else 0 end) as bigint) as take from placed)
"""


def _population(spark, sf):
    p = events(spark, sf)
    meta = p.groupBy("sku_id").agg(F.min("cat_id").alias("cat_id"), F.min("state_id").alias("state_id"))
    return classify.classified(p).filter("lumpy").join(meta, "sku_id")


@query("quartile_strata", with_(EV, STATS, LUMPY, _STRATA) + "select sku_id, cast(adi_q as bigint) as adi_q, cast(cv2_q as bigint) as cv2_q, stratum from strata")
def quartile_strata(spark, sf):
    return tidy(sampling.with_strata(_population(spark, sf)).select("sku_id", "adi_q", "cv2_q", "stratum"))


@query("strata_allocation_core", with_(EV, STATS, LUMPY, _STRATA, _CORE_ALLOC) + "select stratum, available, take from alloc")
def strata_allocation_core(spark, sf):
    return sampling.allocate(sampling.with_strata(_population(spark, sf)), 40)


@query("strata_allocation_lr", with_(EV, STATS, LUMPY, _STRATA, _LR_ALLOC) + "select stratum, available, take from alloc")
def strata_allocation_lr(spark, sf):
    return sampling.allocate(sampling.with_strata(_population(spark, sf)), 40, "remainder")


_PICK = "picked as (select s.*, row_number() over (partition by s.stratum order by md5('42' || sku_id), sku_id) as place, take from strata s join alloc a on a.stratum = s.stratum)"


@query("stratified_sample", with_(EV, STATS, LUMPY, _STRATA, _CORE_ALLOC, _PICK) + "select sku_id, stratum from picked where place <= take order by adi_q, cv2_q, sku_id limit 40")
def stratified_sample(spark, sf):
    return sampling.stratified(sampling.with_strata(_population(spark, sf)), 40).select("sku_id", "stratum")


@query("stratified_sample_lr", with_(EV, STATS, LUMPY, _STRATA, _LR_ALLOC, _PICK) + "select sku_id, stratum from picked where place <= take")
def stratified_sample_lr(spark, sf):
    return sampling.stratified(sampling.with_strata(_population(spark, sf)), 40, "remainder").select("sku_id", "stratum")


@query("simple_sample", with_(EV, STATS, LUMPY) + "select sku_id from lumpy order by md5('42' || sku_id), sku_id limit 40")
def simple_sample(spark, sf):
    return sampling.simple(classify.classified(events(spark, sf)).filter("lumpy").select("sku_id"), 40)


_W = "over (partition by sku_id order by day)"
_LAGS = f"demand as lag_1, lag(demand, 1) {_W} as lag_2, lag(demand, 6) {_W} as lag_7"


@query("lag_features", with_(EV) + f"select sku_id, day, {_LAGS} from panel")
def lag_features(spark, sf):
    return tidy(features.lags(events(spark, sf)).select("sku_id", "day", "lag_1", "lag_2", "lag_7"))


@query("legacy_features", with_(EV) + f"""select sku_id, day, lag(demand, 1) {_W} as lag_1, lag(demand, 2) {_W} as lag_2, lag(demand, 7) {_W} as lag_7,
round(case when day > 7 then avg(demand) over (partition by sku_id order by day rows between 7 preceding and 1 preceding) end, 4) as rolling_mean_7,
round(case when day > 7 then stddev_samp(demand) over (partition by sku_id order by day rows between 7 preceding and 1 preceding) end, 4) as rolling_std_7 from panel""")
def legacy_features(spark, sf):
    df = features.rolling(features.lags(events(spark, sf), legacy=True), means=(7,), stds=(7,), legacy=True)
    return tidy(df.select("sku_id", "day", "lag_1", "lag_2", "lag_7", "rolling_mean_7", "rolling_std_7"), 4)


def _roll(w: int, agg: str) -> str:
    return f"case when day >= {w} then {agg}(demand) over (partition by sku_id order by day rows between {w - 1} preceding and current row) end"


_ROLL = f"round({_roll(3, 'avg')}, 4) as rolling_mean_3, round({_roll(7, 'avg')}, 4) as rolling_mean_7, round({_roll(7, 'stddev_samp')}, 4) as rolling_std_7"


@query("rolling_features", with_(EV) + f"select sku_id, day, {_ROLL} from panel")
def rolling_features(spark, sf):
    return tidy(features.rolling(events(spark, sf)).select("sku_id", "day", "rolling_mean_3", "rolling_mean_7", "rolling_std_7"), 4)


_TARGET = "case when day <= (select max(day) from panel) - 3 then sum(demand) over (partition by sku_id order by day rows between 1 following and 3 following) end as target"


@query("forward_target", with_(EV) + f"select sku_id, day, {_TARGET} from panel")
def forward_target(spark, sf):
    p = events(spark, sf)
    return tidy(p.select("sku_id", "day", features.ahead(F.col("demand"), 3).alias("target")))


_AHEAD = "case when day <= (select max(day) from panel) - 3 then cast(sum({}) over (partition by sku_id order by day rows between 1 following and 3 following) as bigint) end"
_CAL = f"""cast(isodow(date) - 1 as bigint) as dow, cast(month(date) as bigint) as month, cast(isodow(date) >= 6 as bigint) as is_weekend, cast(event_name_1 is not null as bigint) as is_event, snap,
{_AHEAD.format("cast(event_name_1 is not null as int)")} as event_h, {_AHEAD.format("snap")} as snap_h, {_AHEAD.format("cast(isodow(date) >= 6 as int)")} as weekend_h"""


@query("calendar_features", with_(EV) + f"select sku_id, day, {_CAL} from panel")
def calendar_features(spark, sf):
    return tidy(features.calendar(events(spark, sf)).select("sku_id", "day", "dow", "month", "is_weekend", "is_event", "snap", "event_h", "snap_h", "weekend_h"))


_FEATURES = ["lag_1", "lag_2", "lag_7", "rolling_mean_3", "rolling_mean_7", "rolling_std_7", "dow", "month", "is_weekend", "is_event", "snap", "event_h", "snap_h", "weekend_h"]
_MATRIX = f"features as (select sku_id, day, {_LAGS}, {_ROLL}, {_CAL}, {_TARGET} from panel)"


@query("feature_matrix", with_(EV, _MATRIX) + "select * from features where lag_7 is not null and target is not null")
def feature_matrix(spark, sf):
    df = features.matrix(events(spark, sf)).select("sku_id", "day", *_FEATURES, "target")
    return tidy(features.complete(df, [*_FEATURES, "target"]), 4)


@query("identity_codes", with_(EV) + """
select c as "column", value, cast(row_number() over (partition by c order by value) - 1 as bigint) as code from (
 select distinct 'cat_id' as c, cat_id as value from panel union all select distinct 'store_id', store_id from panel union all select distinct 'state_id', state_id from panel)""")
def identity_codes(spark, sf):
    return tidy(features.identity_codes(events(spark, sf), ["cat_id", "store_id", "state_id"]))


@query("leakage_correlation", with_(EV, _MATRIX) + " union all ".join(f"select '{f}' as feature, round(abs(corr({f}, target)), 6) as abs_corr from features where lag_7 is not null and target is not null" for f in ("lag_1", "lag_2", "lag_7", "rolling_mean_7", "event_h", "snap_h")))
def leakage_correlation(spark, sf):
    df = features.complete(features.matrix(events(spark, sf)), ["lag_7", "target"])
    return tidy(features.leakage(df, ["lag_1", "lag_2", "lag_7", "rolling_mean_7", "event_h", "snap_h"]))


ORIGINS = """
origins as (select cast(i as bigint) as origin, t - 7 * (2 - i + 1) - 7 as train_end, t - 7 * (2 - i + 1) as val_end, t - 7 * (2 - i + 1) + 1 as test_start, least(t, t - 7 * (2 - i + 1) + 7) as test_end
  from (select max(day) as t from panel), (select unnest([1, 2]) as i))
"""


@query("rolling_origins", with_(EV, ORIGINS) + "select * from origins")
def rolling_origins(spark, sf):
    return tidy(origins.rolling_origins(events(spark, sf)))


@query("split_counts", with_(EV, ORIGINS) + "select origin, case when day <= val_end then 'val' else 'test' end as split, count(*) as n, sum(demand) as demand from panel join origins on day > train_end and day <= test_end group by all")
def split_counts(spark, sf):
    p = events(spark, sf)
    return tidy(origins.split_days(p, origins.rolling_origins(p)).groupBy("origin", "split").agg(F.count("*").alias("n"), F.sum("demand").alias("demand")))


_BEFORE = "over (partition by sku_id order by day rows between {} preceding and 1 preceding)"


def _mean(width: int) -> str:
    return f"round(coalesce(avg(demand) {_BEFORE.format(width)}, 0.0) * 3, 4)"


for _name, _width in (("naive", 1), ("ma7", 7), ("ma28", 28)):

    @query(f"{_name}_forecast", with_(EV) + f"select sku_id, day, {_mean(_width)} as pred_sum from panel")
    def _trailing(spark, sf, name=_name):
        p = events(spark, sf)
        return tidy(forecast.forecasts(p, (name,), 3).select("sku_id", "day", "pred_sum"), 4)


def _ses_sql(xs: str, a: float, twice: bool = True) -> str:
    level = f"list_reduce({xs}, lambda f, x: {a} * x + {1 - a} * f)"
    return f"({a} * {xs}[-1] + {1 - a} * {level})" if twice else level


_SO_FAR = "over (partition by sku_id order by day rows between unbounded preceding and current row)"
LISTS = f"""
gaps as (select *, case when demand > 0 then day - max(case when demand > 0 then day end) over (partition by sku_id order by day rows between unbounded preceding and 1 preceding) end as gap from panel),
lists as (select sku_id, day, demand, cat_id, list(demand) {_SO_FAR} as xs, list(demand) filter (where demand > 0) {_SO_FAR} as zs, list(cast(gap as double)) filter (where gap is not null) {_SO_FAR} as ps,
  list(cast(demand > 0 as double)) {_SO_FAR} as hs from gaps)
"""


def croston_sql(a: float, factor: float) -> str:
    return f"case when zs is null then 0.0 when ps is null then {factor} * {_ses_sql('zs', a)} else {factor} * {_ses_sql('zs', a)} / {_ses_sql('ps', a)} end"


@query("croston_sba_forecast", with_(EV, LISTS) + f"select sku_id, day, round(3 * {croston_sql(0.1, 0.95)}, 4) as pred_sum from lists")
def croston_sba_forecast(spark, sf):
    return tidy(forecast.forecasts(events(spark, sf), ("croston_sba",), 3).select("sku_id", "day", "pred_sum"), 4)


@query("croston_classic_forecast", with_(EV, LISTS) + f"select sku_id, day, round(3 * {croston_sql(0.1, 1.0)}, 4) as pred_sum from lists")
def croston_classic_forecast(spark, sf):
    return tidy(forecast.forecasts(events(spark, sf), ("croston",), 3).select("sku_id", "day", "pred_sum"), 4)


@query("croston_exclusive", with_(EV, LISTS, f"r as (select sku_id, day, {croston_sql(0.1, 0.95)} as rate from lists)") + "select sku_id, day, round(coalesce(lag(rate) over (partition by sku_id order by day), 0.0), 4) as rate from r")
def croston_exclusive(spark, sf):
    return tidy(forecast.before(forecast.croston(events(spark, sf))).select("sku_id", "day", "rate"), 4)


@query("ses_forecast", with_(EV, LISTS) + f"select sku_id, day, round(3 * {_ses_sql('xs', 0.1)}, 4) as pred_sum from lists")
def ses_forecast(spark, sf):
    return tidy(forecast.forecasts(events(spark, sf), ("ses",), 3).select("sku_id", "day", "pred_sum"), 4)


@query("tsb_forecast", with_(EV, LISTS) + f"select sku_id, day, round(case when zs is null then 0.0 else {_ses_sql('hs', 0.2, False)} * {_ses_sql('zs', 0.2, False)} end, 4) as rate from lists")
def tsb_forecast(spark, sf):
    return tidy(forecast.tsb(events(spark, sf)).select("sku_id", "day", "rate"), 4)


_TUNE = ", ".join(f"{_ses_sql('xs', a)} as f{i}" for i, a in enumerate(forecast.ALPHA_GRID))
_TUNE_LAG = ", ".join(f"coalesce(lag(f{i}) over (partition by sku_id order by day), 0.0) as g{i}" for i in range(5))
_TUNE_MSE = ", ".join(f"{{'mse': avg(round(demand - g{i}, 6) * round(demand - g{i}, 6)), 'alpha': cast({a} as double)}}" for i, a in enumerate(forecast.ALPHA_GRID))


@query("ses_alpha_tuning", with_(EV, LISTS, f"f as (select sku_id, day, demand, {_TUNE} from lists)", f"g as (select *, {_TUNE_LAG} from f)") + f"""
select sku_id, b.alpha as alpha, round(b.mse, 4) as mse from (select sku_id, list_min([{_TUNE_MSE}]) as b from g where day between 17 and 23 group by 1)""")
def ses_alpha_tuning(spark, sf):
    return tidy(forecast.tuned_ses_alpha(events(spark, sf), 16, 23), 4)


_TUNE_LAG_SEEN = ", ".join(f"lag(f{i}) over (partition by sku_id order by day) as g{i}" for i in range(5))


@query("ses_alpha_tuning_in_sample", with_(EV, LISTS, f"f as (select sku_id, day, demand, {_TUNE} from lists)", f"g as (select sku_id, day, lag(demand) over (partition by sku_id order by day) as demand, {_TUNE_LAG_SEEN} from f)") + f"""
select sku_id, b.alpha as alpha, round(b.mse, 4) as mse from (select sku_id, list_min([{_TUNE_MSE}]) as b from g where day between 17 and 23 group by 1)""")
def ses_alpha_tuning_in_sample(spark, sf):
    return tidy(forecast.tuned_ses_alpha(events(spark, sf), 16, 23, error="in_sample"), 4)


@query("unpivot_wide_panel", with_(EV) + "select sku_id, day, demand from panel")
def unpivot_wide_panel(spark, sf):
    """Every day of the panel as a column, and back; the days are counted in the events, not in the panel."""
    from ..sources.retail import unpivot_days

    days = range(1, (panel.event_rows(table(spark, sf, "events")).agg(F.max("day")).first()[0] or 0) + 1)
    wide = events(spark, sf).groupBy("sku_id").pivot("day", list(days)).agg(F.first("demand"))
    return tidy(unpivot_days(wide.toDF("sku_id", *(f"d_{i}" for i in days)), ["sku_id"]))


@query("state_snap_pick", with_(EV) + """select sku_id, day, cast(case state_id when 'STATE_0' then day % 2 when 'STATE_1' then day % 3 end as bigint) as snap from panel""")
def state_snap_pick(spark, sf):
    from ..sources.retail import pick_state_flag

    p = events(spark, sf).drop("snap").withColumns({"snap_STATE_0": F.col("day") % 2, "snap_STATE_1": F.col("day") % 3})
    return tidy(pick_state_flag(p, ["STATE_0", "STATE_1"]).select("sku_id", "day", "snap"))


@query("price_join", with_(EV, "cal as (select distinct day, (day - 1) // 7 as week from panel)", "prices as (select distinct item_id, store_id, week, 1.0 + (week % 3) as sell_price from panel join cal using (day) where demand > 0)") + """
select sku_id, p.day, cast(cal.week as bigint) as week, cast(pr.sell_price as double) as sell_price from panel p join cal on cal.day = p.day left join prices pr on pr.item_id = p.item_id and pr.store_id = p.store_id and pr.week = cal.week""")
def price_join(spark, sf):
    from ..sources.retail import join_calendar, join_prices

    p = events(spark, sf).select("sku_id", "item_id", "store_id", "day", "demand")
    cal = p.select("day").distinct().withColumn("week", F.floor((F.col("day") - 1) / 7))
    dated = join_calendar(p, cal)
    prices = dated.filter("demand > 0").select("item_id", "store_id", "week").distinct().withColumn("sell_price", 1.0 + F.col("week") % 3)
    return tidy(join_prices(dated, prices, ["item_id", "store_id", "week"]).select("sku_id", "day", "week", "sell_price"))


@query("volume_extremes", with_(EV, "v as (select sku_id, sum(demand) as demand_total from panel group by 1)", "r as (select *, row_number() over (order by demand_total, sku_id) as rn, count(*) over () as n from v)") + "select sku_id, demand_total, cast(rn as bigint) as place from r where rn in (1, n // 2 + 1, n)")
def volume_extremes(spark, sf):
    from ..operators.ranks import global_row_number

    v = events(spark, sf).groupBy("sku_id").agg(F.sum("demand").alias("demand_total"))
    n = F.broadcast(v.agg(F.count("*").alias("n")))  # one row
    df = global_row_number(v, "demand_total", "sku_id", "place").crossJoin(n)
    return tidy(df.filter("place in (1, n div 2 + 1, n)").select("sku_id", "demand_total", "place"))


@query("value_quartiles", with_(EV, STATS, LUMPY, "e as (select quantile_cont(cv2, [0.25, 0.5, 0.75]) as q, min(cv2) as lo, max(cv2) as hi from lumpy)") + "select sku_id, (select count(distinct x) from (select unnest(q) as x) where x > lo and x < hi and x < cv2) as quartile from lumpy, e")
def value_quartiles(spark, sf):
    from ..operators.ranks import value_quartiles as classes

    return tidy(classes(classify.classified(events(spark, sf)).filter("lumpy"), "cv2", []).select("sku_id", "quartile"))


@query("boundary_fill", with_(EV, f"t as (select sku_id, day, {_TARGET} from panel)") + """
select sku_id, day, coalesce(last_value(target ignore nulls) over (partition by sku_id order by day rows between unbounded preceding and current row), first_value(target ignore nulls) over (partition by sku_id order by day rows between current row and unbounded following)) as level from t""")
def boundary_fill(spark, sf):
    p = events(spark, sf).select("sku_id", "day", features.ahead(F.col("demand"), 3).alias("target"))
    w = W.partitionBy("sku_id").orderBy("day")
    back = F.last("target", True).over(w.rowsBetween(W.unboundedPreceding, 0))
    return tidy(p.select("sku_id", "day", F.coalesce(back, F.first("target", True).over(w.rowsBetween(0, W.unboundedFollowing))).alias("level")))
