"""The study under other lead times, review times, roundings, conventions and billing windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import classify, origins, ranks, sensitivity, stats
from ..operators.panel import event_rows
from ..sources.shared import keep
from .base import EV, LUMPY, STATS, events, query, table, tidy, with_recursive
from .panels import LISTS, ORIGINS, croston_sql
from .policies import MODELS, _wilcoxon_sql

TAUS = (0.90, 0.95)


def _runs(spark, sf):
    p = events(spark, sf)
    p = p.join(classify.classified(p).filter("lumpy").select("sku_id"), "sku_id", "left_semi")
    return sensitivity.runs(p, origins.rolling_origins(event_rows(table(spark, sf, "events"))), MODELS, taus=TAUS)


_ROWS = ", ".join(f"('{v.name}', {v.review}, {v.lead}, '{v.rounding}', {v.moq}, '{v.start}', '{v.convention}', {v.warmup}, {str(v.bounded).lower()})" for v in sensitivity.VARIANTS)
#: Every variant day by day: stock, the orders under way as a list, what is ordered today.
_SENS = f"""
variants as (select * from (values {_ROWS}) v(variant, review, lead, rounding, moq, start, convention, warmup, bounded)),
hz as (select distinct review + lead as h from variants),
totals as (select sku_id, day, demand, sum(demand) over (partition by sku_id order by day) as so_far, coalesce(avg(demand) over (partition by sku_id order by day rows between 7 preceding and 1 preceding), 0.0) as ma7 from panel where sku_id in (select sku_id from lumpy)),
rates as (select t.*, {croston_sql(0.1, 0.95)} as croston_sba from totals t join lists using (sku_id, day)),
predh as (select r.sku_id, r.day, r.demand, h, x.model, round(case x.model when 'ma7' then r.ma7 else r.croston_sba end * h, 6) as pred_sum, z.so_far - r.so_far as actual from rates r cross join hz cross join (values ('ma7'), ('croston_sba')) x(model) left join totals z on z.sku_id = r.sku_id and z.day = r.day + h),
rowz as (select p.*, origin, case when day <= val_end then 'val' else 'test' end as split from predh p join origins on day > train_end and day <= test_end),
ssq as (select model, origin, h, sku_id, quantile_cont(actual - pred_sum, [{", ".join(map(str, TAUS))}]) as q from rowz where split = 'val' and actual is not null group by all),
ss as (select model, origin, h, sku_id, cast(unnest([{", ".join(map(str, TAUS))}]) as double) as tau, unnest(q) as ss from ssq),
numbered as (select v.*, r.sku_id, r.model, r.origin, s.tau, r.day, r.demand, greatest(pred_sum + ss, 0.0) as level, row_number() over (partition by variant, r.sku_id, r.model, r.origin, s.tau order by r.day) as rn, max(r.day) over (partition by variant, r.sku_id, r.model, r.origin, s.tau) as last_day
  from rowz r join ss s on s.sku_id = r.sku_id and s.model = r.model and s.origin = r.origin and s.h = r.h join variants v on v.review + v.lead = r.h where r.split = 'test'),
moved as (select n.*, case start when 'level' then level else 0.0 end - demand as net, case start when 'level' then level else 0.0 end as before, cast(0.0 as double) as received, list_resize([]::double[], lead - 1, 0.0) as under from numbered n where rn = 1),
sim as (select *, case when (rn - 1) % review <> 0 then 0.0 else case rounding when 'none' then greatest(level - net - coalesce(list_sum(under), 0.0), 0.0) when 'ceil' then greatest(ceil(round(level - net - coalesce(list_sum(under), 0.0), 6)), 0.0) else greatest(ceil(round((level - net - coalesce(list_sum(under), 0.0)) / moq, 6)) * moq, 0.0) end end as placed from moved
 union all select *, case when (rn - 1) % review <> 0 then 0.0 else case rounding when 'none' then greatest(level - net - coalesce(list_sum(under), 0.0), 0.0) when 'ceil' then greatest(ceil(round(level - net - coalesce(list_sum(under), 0.0), 6)), 0.0) else greatest(ceil(round((level - net - coalesce(list_sum(under), 0.0)) / moq, 6)) * moq, 0.0) end end as placed
  from (select n.*, s.net + list_append(s.under, s.placed)[1] - n.demand as net, s.net as before, list_append(s.under, s.placed)[1] as received, list_append(s.under, s.placed)[2:] as under
   from sim s join numbered n on n.variant = s.variant and n.sku_id = s.sku_id and n.model = s.model and n.origin = s.origin and n.tau = s.tau and n.rn = s.rn + 1)),
runs as (select variant, sku_id, model, origin, tau, any_value(convention) as convention, count(*) filter (where b) as billed_days, coalesce(sum(demand) filter (where b), 0.0) as demand, coalesce(sum(demand - least(greatest(before + received, 0.0), demand)) filter (where b), 0.0) as unmet,
  coalesce(sum(greatest(-net, 0.0)) filter (where b), 0.0) as backlog_days, coalesce(sum(greatest(net, 0.0)) filter (where b), 0.0) as on_hand from (select *, rn > warmup and (not bounded or day <= last_day - review - lead) as b from sim) group by variant, sku_id, model, origin, tau),
paid as (select *, case convention when 'per_unit_once' then unmet else backlog_days end * 5.0 + on_hand as cost_total, 1 - unmet / nullif(demand, 0) as fill_rate from runs)
"""
_PARTS = (EV, STATS, LUMPY, ORIGINS, LISTS, _SENS)


@query("sensitivity_runs", with_recursive(*_PARTS) + "select variant, sku_id, model, origin, tau, billed_days, round(demand, 4) as demand, round(unmet, 4) as unmet, round(backlog_days, 4) as backlog_days, round(on_hand, 4) as on_hand, round(cost_total, 3) as cost_total, round(fill_rate, 6) as fill_rate from paid")
def sensitivity_runs(spark, sf):
    """Totals and costs of every path under every variant."""
    return tidy(_runs(spark, sf).select("variant", *sensitivity.PATH, "billed_days", "demand", "unmet", "backlog_days", "on_hand", "cost_total", "fill_rate"), 4, cost_total=3, fill_rate=6)


@query("sensitivity_variants", with_recursive(*_PARTS) + "select variant, model, tau, count(*) as n, count(*) filter (where billed_days > 0) as n_billed, round(quantile_cont(cost_total, 0.5), 3) as cost_median, round(quantile_cont(fill_rate, 0.5), 6) as fill_median from paid group by variant, model, tau")
def sensitivity_variants(spark, sf):
    """Median cost and fill rate by variant and model: each variant a run of its own."""
    rows = keep(_runs(spark, sf).select("variant", "model", "tau", "billed_days", "cost_total", "fill_rate"))
    by = ["variant", "model", "tau"]
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("billed_days") > 0).alias("n_billed"))
    return tidy(counts.join(ranks.medians(rows, ["cost_total", "fill_rate"], by).withColumnsRenamed({"cost_total": "cost_median", "fill_rate": "fill_median"}), by), 6, cost_median=3)


_REL_SENS = """
gap as (select variant, origin, tau, sku_id, round((round(a, 6) - round(b, 6)) / round(b, 6), 9) as rel from (select variant, origin, tau, sku_id, max(cost_total) filter (where model = 'ma7') as a, max(cost_total) filter (where model = 'croston_sba') as b from paid group by all) where a is not null and b is not null and round(b, 6) <> 0)
"""


@query("sensitivity_tests", with_recursive(*_PARTS, _REL_SENS, _wilcoxon_sql("gap", "variant, origin, tau", "rel")) + "select variant, origin, tau, n_pairs, n, z, r_rank_biserial, round(median_diff, 6) as median_diff from wilcoxon")
def sensitivity_tests(spark, sf):
    """The models' relative cost under each variant, tested path by path."""
    rel = keep(sensitivity.against_base(_runs(spark, sf), MODELS))
    return tidy(stats.wilcoxon(rel, ["variant", "origin", "tau"], "rel").select("variant", "origin", "tau", "n_pairs", "n", "z", "r_rank_biserial", "median_diff"))
