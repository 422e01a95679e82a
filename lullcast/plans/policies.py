"""Queries on safety stock, simulated policies, costs and tests: two rate models at two origins."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dist import EXACT, SIGNED_RANK_SQL, chi2_upper_2, normal_upper, normal_upper_sql, signed_rank_upper
from ..operators import accuracy, classify, features, forecast, origins, policy, sampling, stats
from ..operators.panel import event_rows
from ..operators.ranks import medians
from ..sources import artefacts
from ..sources.shared import keep
from .base import EV, LUMPY, STATS, events, query, table, tidy, with_, with_recursive
from .panels import LISTS, ORIGINS, croston_sql

MODELS = ("ma7", "croston_sba")
HORIZON = 3
_TAUS = "[0.5, 0.7, 0.85, 0.95, 0.99]"


def _inputs(spark, sf):
    """Forecasts of the lumpy series on validation and test days, with the demand that came."""
    p = events(spark, sf)
    lumpy = classify.classified(p).filter("lumpy").select("sku_id")
    p = p.join(lumpy, "sku_id", "left_semi").withColumn("actual", features.ahead(F.col("demand"), HORIZON))
    windows = origins.rolling_origins(event_rows(table(spark, sf, "events")))  # the panel's last day without the panel
    return origins.split_days(forecast.forecasts(p, MODELS, HORIZON), windows)


def _errors(spark, sf, rows=None):
    return (_inputs(spark, sf) if rows is None else rows).filter("split = 'val'").withColumn("err", F.col("actual") - F.round("pred_sum", 6)).filter("err is not null")


def _levels(spark, sf):
    """Levels on test days for each quantile of a series' own validation errors; both come from one pass over the forecasts."""
    rows = _inputs(spark, sf).withColumn("pred_sum", F.round("pred_sum", 6))
    err = F.when(F.col("split") == "val", F.col("actual") - F.col("pred_sum"))
    taus = F.array(*(F.lit(t) for t in policy.TAUS))
    ss = F.percentile(err, taus).over(W.partitionBy("sku_id", "model", "origin"))
    test = rows.withColumn("_q", ss).filter("split = 'test' and _q is not null")
    each = F.explode(F.arrays_zip(taus.alias("tau"), F.col("_q").alias("ss")))
    test = test.withColumn("_x", each).select("sku_id", "model", "origin", "day", "demand", "pred_sum", F.col("_x").getField("tau").alias("tau"), F.col("_x").getField("ss").alias("ss"))
    return test.select("sku_id", "model", "origin", "tau", "day", "demand", F.greatest(F.col("pred_sum") + F.col("ss"), F.lit(0.0)).alias("level"))


_PRED = f"""
fwd as (select p.sku_id, p.day, p.demand, p.cat_id, case when day <= (select max(day) from panel) - 3 then sum(demand) over (partition by p.sku_id order by day rows between 1 following and 3 following) end as actual,
  round(coalesce(avg(demand) over (partition by p.sku_id order by day rows between 7 preceding and 1 preceding), 0.0) * 3, 6) as ma7 from panel p where sku_id in (select sku_id from lumpy)),
cro as (select sku_id, day, round(3 * {croston_sql(0.1, 0.95)}, 6) as croston_sba from lists),
pred as (select f.sku_id, f.day, demand, cat_id, actual, 'ma7' as model, ma7 as pred_sum from fwd f union all select f.sku_id, f.day, demand, cat_id, actual, 'croston_sba', croston_sba from fwd f join cro using (sku_id, day)),
rowz as (select p.*, origin, case when day <= val_end then 'val' else 'test' end as split from pred p join origins on day > train_end and day <= test_end),
errs as (select sku_id, cat_id, model, origin, day, actual - pred_sum as err from rowz where split = 'val' and actual is not null)
"""
_SS = f"""
ssq as (select model, origin, sku_id, quantile_cont(err, {_TAUS}) as q from errs group by all),
ss as (select model, origin, sku_id, cast(unnest({_TAUS}) as double) as tau, unnest(q) as ss from ssq),
levels as (select r.sku_id, r.model, r.origin, tau, day, demand, greatest(pred_sum + ss, 0.0) as level from rowz r join ss on ss.sku_id = r.sku_id and ss.model = r.model and ss.origin = r.origin where split = 'test')
"""
_BASE = (EV, STATS, LUMPY, ORIGINS, LISTS, _PRED)


def _sim(rounding: str = "{}", name: str = "sim") -> str:
    """The day loop as a recursion: net stock, the order under way and the one that arrives next."""
    day = """
      select l.sku_id, l.model, l.origin, l.tau, l.day, l.demand, l.level, {net} as before, {come} as received,
        {net} + {come} - l.demand as net, {under} as under, {net} + {come} - l.demand + {under} as position{more}"""
    placed = rounding.format("greatest(0.0, level - position)")
    body = """
      select sku_id, model, origin, tau, day, demand, level, {net0} as net0, {step} as step, before, received, net, under, {placed} as placed from ({inner})"""
    first = body.format(inner=day.format(net="l.level", come="cast(0.0 as double)", under="cast(0.0 as double)", more="") + " from numbered l where l.rn = 1", net0="level", step="1", placed=placed)
    join = f" from {name} s join numbered l on l.sku_id = s.sku_id and l.model = s.model and l.origin = s.origin and l.tau = s.tau and l.rn = s.step + 1"
    later = body.format(inner=day.format(net="s.net", come="s.under", under="s.placed", more=", s.net0, s.step") + join, net0="net0", step="step + 1", placed=placed)
    return f"numbered as (select *, row_number() over (partition by sku_id, model, origin, tau order by day) as rn from levels),\n{name} as ({first} union all {later})"


_TRACE = """
trace as (select *, least(greatest(before, 0.0) + received, greatest(-before, 0.0)) as settled, least(greatest(before + received, 0.0), demand) as served,
  demand - least(greatest(before + received, 0.0), demand) as unmet, greatest(net, 0.0) as on_hand, greatest(-net, 0.0) as backlog from sim)
"""
_SUM = """
ends as (select sku_id, model, origin, tau, max(day) as last_day, max(step) as last_step from trace group by all),
sweep as (select t.sku_id, t.model, t.origin, t.tau, count(*) filter (where b) as billed_days, coalesce(sum(demand) filter (where b), 0.0) as demand, coalesce(sum(unmet) filter (where b), 0.0) as unmet,
  coalesce(sum(backlog) filter (where b), 0.0) as backlog_days, coalesce(sum(on_hand) filter (where b), 0.0) as on_hand, count(*) filter (where placed > 1e-9) as order_days,
  sum(unmet) as unmet_all, sum(settled) as settled_all, max(backlog) filter (where step = last_step) as backlog_end
  from (select t.*, last_step, step > 1 and day <= last_day - 3 as b from trace t join ends e on e.sku_id = t.sku_id and e.model = t.model and e.origin = t.origin and e.tau = t.tau) t group by all),
filled as (select *, round(1 - unmet / nullif(demand, 0), 9) as fill_rate from sweep)
"""
_COSTS = """
costs as (select f.*, cs, ch, unmet * cs as cost_stockout, on_hand * ch as cost_holding, unmet * cs + on_hand * ch as cost_total from filled f, (values (5.0::double, 1.0::double), (10.0, 1.0), (20.0, 1.0)) s(cs, ch)),
goals as (select cast(unnest([0.9, 0.95, 0.98]) as double) as fill_target),
eq0 as (select sku_id, model, origin, cs, ch, fill_target, max({'f': fill_rate, 'c': cost_total}) filter (where fill_rate <= fill_target) as lo, min({'f': fill_rate, 'c': cost_total}) filter (where fill_rate > fill_target) as hi,
  min(fill_rate) as fill_min, max(fill_rate) as fill_max from costs, goals group by all),
eq as (select sku_id, model, origin, cs, ch, fill_target, coalesce(fill_min <= fill_target and fill_target <= fill_max, true) as covered, fill_min, fill_max,
  case when not coalesce(fill_min <= fill_target and fill_target <= fill_max, true) then null when lo.f = fill_target or hi is null then lo.c else lo.c + (fill_target - lo.f) * (hi.c - lo.c) / (hi.f - lo.f) end as cost_at_target from eq0)
"""
_ALL = (*_BASE, _SS, _sim(), _TRACE, _SUM, _COSTS)


def _sweep(spark, sf, **how):
    return policy.summarise(policy.simulate_net(_levels(spark, sf), **how), horizon=HORIZON).withColumn("fill_rate", F.round("fill_rate", 9))


def _equal(spark, sf):
    return policy.at_equal_service(policy.with_costs(_sweep(spark, sf)))


@query("validation_errors", with_(*_BASE) + "select sku_id, model, origin, day, round(err, 4) as err from errs")
def validation_errors(spark, sf):
    return tidy(_errors(spark, sf).select("sku_id", "model", "origin", "day", "err"), 4)


@query("safety_stock_quantiles", with_(*_BASE, _SS) + "select model, origin, sku_id, tau, round(ss, 4) as ss from ss")
def safety_stock_quantiles(spark, sf):
    return tidy(policy.quantiles(_errors(spark, sf), ["model", "origin", "sku_id"]), 4)


_POOL = f"""
own as (select model, origin, sku_id, count(*) as n, min(cat_id) as cat_id, quantile_cont(err, {_TAUS}) as q from errs group by 1, 2, 3),
cats as (select model, origin, cat_id, quantile_cont(err, {_TAUS}) as qc from errs group by 1, 2, 3),
pooled as (select o.model, o.origin, sku_id, cast(unnest({_TAUS}) as double) as tau, unnest(case when n >= 7 then q else qc end) as ss, n, case when n >= 7 then 'series' else 'category' end as source from own o join cats c on c.model = o.model and c.origin = o.origin and c.cat_id = o.cat_id)
"""


def _pooled(spark, sf):
    # the second origin's last validation days lack their look-ahead at the panel's end: a bound of 7 leaves both sources in use
    return policy.pooled_safety_stock(_errors(spark, sf), min_obs=7)


@query("safety_stock_pooled", with_(*_BASE, _POOL) + "select model, origin, sku_id, tau, round(ss, 4) as ss, n, source from pooled")
def safety_stock_pooled(spark, sf):
    return tidy(_pooled(spark, sf), 4)


@query("safety_stock_diagnostics", with_(*_BASE, _POOL) + "select model, origin, tau, count(*) filter (where source = 'series') as n_own, count(*) filter (where source <> 'series') as n_pooled, round(quantile_cont(ss, 0.5), 4) as ss_median, round(min(ss), 4) as ss_min, round(max(ss), 4) as ss_max, count(*) filter (where ss < 0) as ss_negative from pooled group by all")
def safety_stock_diagnostics(spark, sf):
    df = _pooled(spark, sf).groupBy("model", "origin", "tau").agg(F.count_if(F.col("source") == "series").alias("n_own"), F.count_if(F.col("source") != "series").alias("n_pooled"), F.percentile("ss", F.lit(0.5)).alias("ss_median"), F.min("ss").alias("ss_min"), F.max("ss").alias("ss_max"), F.count_if(F.col("ss") < 0).alias("ss_negative"))
    return tidy(df, 4)


@query("order_up_to_level", with_(*_BASE, _SS) + "select sku_id, model, origin, tau, day, demand, round(level, 4) as level from levels")
def order_up_to_level(spark, sf):
    return tidy(_levels(spark, sf), 4)


_TRACE_COLS = "sku_id, model, origin, tau, day, round(received, 4) + 0.0 as received, round(settled, 4) + 0.0 as settled, round(unmet, 4) + 0.0 as unmet, round(on_hand, 4) + 0.0 as on_hand, round(backlog, 4) + 0.0 as backlog, round(placed, 4) + 0.0 as order_qty"


def _trace(df):
    return tidy(df.select("sku_id", "model", "origin", "tau", "day", "received", "settled", "unmet", "on_hand", "backlog", "order_qty"), 4)


@query("net_simulation_trace", with_recursive(*_BASE, _SS, _sim(), _TRACE) + f"select {_TRACE_COLS} from trace")
def net_simulation_trace(spark, sf):
    return _trace(policy.simulate_net(_levels(spark, sf)))


@query("net_simulation_ceil", with_recursive(*_BASE, _SS, _sim("ceil(round({}, 6))"), _TRACE) + f"select {_TRACE_COLS} from trace")
def net_simulation_ceil(spark, sf):
    return _trace(policy.simulate_net(_levels(spark, sf), rounding="ceil"))


@query("net_simulation_moq", with_recursive(*_BASE, _SS, _sim("ceil(round({} / 16, 6)) * 16"), _TRACE) + f"select {_TRACE_COLS} from trace")
def net_simulation_moq(spark, sf):
    return _trace(policy.simulate_net(_levels(spark, sf), rounding="moq", moq=16.0))


_SWEEP_COLS = "sku_id, model, origin, tau, billed_days, round(demand, 4) as demand, round(unmet, 4) as unmet, round(backlog_days, 4) as backlog_days, round(on_hand, 4) as on_hand, order_days, round(unmet_all, 4) as unmet_all, round(settled_all, 4) as settled_all, round(backlog_end, 4) as backlog_end, round(fill_rate, 6) as fill_rate"
_SWEEP = ("sku_id", "model", "origin", "tau", "billed_days", "demand", "unmet", "backlog_days", "on_hand", "order_days", "unmet_all", "settled_all", "backlog_end", "fill_rate")


@query("policy_sweep", with_recursive(*_ALL[:-1]) + f"select {_SWEEP_COLS} from filled")
def policy_sweep(spark, sf):
    return tidy(_sweep(spark, sf).select(*_SWEEP), 4, fill_rate=6)


@query("cost_scenarios", with_recursive(*_ALL) + "select sku_id, model, origin, tau, cs, ch, round(cost_stockout, 3) as cost_stockout, round(cost_holding, 3) as cost_holding, round(cost_total, 3) as cost_total from costs")
def cost_scenarios(spark, sf):
    return tidy(policy.with_costs(_sweep(spark, sf)).select("sku_id", "model", "origin", "tau", "cs", "ch", "cost_stockout", "cost_holding", "cost_total"), 3)


@query("service_equalized", with_recursive(*_ALL) + "select sku_id, model, origin, cs, ch, fill_target, round(cost_at_target, 3) as cost_at_target, covered, round(fill_min, 6) as fill_min, round(fill_max, 6) as fill_max from eq")
def service_equalized(spark, sf):
    return tidy(_equal(spark, sf), 6, cost_at_target=3)


@query("coverage_counts", with_recursive(*_ALL) + "select model, origin, fill_target, count(*) as n, count(*) filter (where covered) as n_covered, count(*) filter (where covered and cost_at_target is null) as n_covered_empty from eq where cs = 5 group by all")
def coverage_counts(spark, sf):
    df = _equal(spark, sf).filter("cs = 5").groupBy("model", "origin", "fill_target")
    return tidy(df.agg(F.count("*").alias("n"), F.count_if("covered").alias("n_covered"), F.count_if(F.col("covered") & F.col("cost_at_target").isNull()).alias("n_covered_empty")))


@query("covered_intersection", with_recursive(*_ALL) + "select origin, sku_id from eq where cs = 5 group by all having bool_and(cost_at_target is not null)")
def covered_intersection(spark, sf):
    return tidy(_equal(spark, sf).filter("cs = 5").groupBy("origin", "sku_id").agg(F.bool_and(F.col("cost_at_target").isNotNull()).alias("all_")).filter("all_").drop("all_"))


@query("operating_points", with_recursive(*_ALL, "near as (select model, origin, sku_id, fill_target, min({'g': round(abs(fill_rate - fill_target), 9), 't': tau}) as m, max(fill_rate) < fill_target as below from filled, goals where fill_rate is not null group by model, origin, sku_id, fill_target)") + "select model, origin, fill_target, count(*) as n, round(quantile_cont(m.t, 0.5), 6) as tau_median, round(quantile_cont(m.g, 0.5), 6) as gap_median, count(*) filter (where below) as n_below from near group by all")
def operating_points(spark, sf):
    goals = F.explode(F.array(*(F.lit(t) for t in policy.TARGETS)))
    df = _sweep(spark, sf).filter("fill_rate is not null").withColumn("fill_target", goals)
    near = df.groupBy("model", "origin", "sku_id", "fill_target").agg(F.min(F.struct(F.round(F.abs(F.col("fill_rate") - F.col("fill_target")), 9).alias("g"), F.col("tau").alias("t"))).alias("m"), (F.max("fill_rate") < F.col("fill_target")).alias("below"))
    return tidy(near.groupBy("model", "origin", "fill_target").agg(F.count("*").alias("n"), F.percentile("m.t", F.lit(0.5)).alias("tau_median"), F.percentile("m.g", F.lit(0.5)).alias("gap_median"), F.count_if("below").alias("n_below")))


@query("nonmonotone_curves", with_recursive(*_ALL, "steps as (select model, origin, sku_id, fill_rate - lag(fill_rate) over (partition by model, origin, sku_id order by tau) as d from filled)") + "select model, origin, count(*) as n, count(*) filter (where falls) as n_falling from (select model, origin, sku_id, coalesce(bool_or(d < -1e-8), false) as falls from steps group by all) group by all")
def nonmonotone_curves(spark, sf):
    w = W.partitionBy("model", "origin", "sku_id").orderBy("tau")
    df = _sweep(spark, sf).withColumn("d", F.col("fill_rate") - F.lag("fill_rate").over(w))
    each = df.groupBy("model", "origin", "sku_id").agg(F.coalesce(F.bool_or(F.col("d") < -1e-8), F.lit(False)).alias("falls"))
    return tidy(each.groupBy("model", "origin").agg(F.count("*").alias("n"), F.count_if("falls").alias("n_falling")))


_RESIDUALS = """
residuals as (select abs(net - (before + received - demand)) as stock, abs(backlog - (greatest(-net0, 0.0) + sum(unmet - settled) over (partition by sku_id, model, origin, tau order by day))) as owed,
  least(on_hand, backlog, unmet, served, placed) as least, abs(served + unmet - demand) as units, net + under + placed - level as above from trace)
"""


@query("simulation_invariants", with_recursive(*_BASE, _SS, _sim(), _TRACE, _RESIDUALS) + "select max(stock) < 1e-6 as stock_balance, max(owed) < 1e-6 as backlog_balance, min(least) > -1e-6 as non_negative, max(units) < 1e-6 as units_balance, min(above) > -1e-6 as position_reached from residuals")
def simulation_invariants(spark, sf):
    return policy.invariants(policy.simulate_net(_levels(spark, sf)))


def _core(legacy: bool) -> str:
    """The fold that ignores orders under way, as a recursion with a lead time of two days."""
    paid = "0.0" if legacy else "least(have, owed)"
    out = """select sku_id, model, origin, tau, {n} as step, demand, have - paid - served as on_hand, owed - paid + demand - served as backlog, demand - served as unmet, next1 as pipe1,
      greatest(level - (have - paid - served - (owed - paid + demand - served)), 0.0) as pipe2 from (select *, least(have - {paid}, demand) as served, {paid} as paid from ({inner}))"""
    first = out.format(inner="select sku_id, model, origin, tau, demand, level, ceil(round(greatest(level, 0.0), 9)) as have, cast(0.0 as double) as owed, cast(0.0 as double) as next1, 0 as step from numbered where rn = 1", n="1", paid=paid)
    later = out.format(inner="select l.sku_id, l.model, l.origin, l.tau, l.demand, l.level, s.on_hand + s.pipe1 as have, s.backlog as owed, s.pipe2 as next1, s.step from fold s join numbered l on l.sku_id = s.sku_id and l.model = s.model and l.origin = s.origin and l.tau = s.tau and l.rn = s.step + 1", n="step + 1", paid=paid)
    return f"numbered as (select *, row_number() over (partition by sku_id, model, origin, tau order by day) as rn from levels),\nfold as ({first} union all {later})"


_CORE_OUT = "select sku_id, model, origin, tau, round(sum(demand) filter (where step > 1), 4) as demand, round(sum(unmet) filter (where step > 1), 4) as unmet, round(sum(on_hand) filter (where step > 1), 4) as on_hand, round(max(backlog) filter (where step = 7), 4) as backlog_end, round(1 - sum(unmet) filter (where step > 1) / nullif(sum(demand) filter (where step > 1), 0), 6) as fill_rate from fold group by all"


@query("core_simulation_summary", with_recursive(*_BASE, _SS, _core(False)) + _CORE_OUT)
def core_simulation_summary(spark, sf):
    return tidy(policy.simulate_core(_levels(spark, sf)), 4, fill_rate=6)


@query("legacy_simulation", with_recursive(*_BASE, _SS, _core(True)) + _CORE_OUT)
def legacy_simulation(spark, sf):
    return tidy(policy.simulate_core(_levels(spark, sf), legacy=True), 4, fill_rate=6)


_ACC = """
scaled as (select sku_id, origin, avg(abs(d)) as s1, avg(d * d) as s2, count(*) as nd from (select f.sku_id, origin, actual - lag(actual) over (partition by f.sku_id, origin order by f.day) as d from fwd f join origins on f.day <= val_end where actual is not null) where d is not null group by all),
acc as (select r.model, r.origin, r.split, r.sku_id, count(*) as n, avg(abs(actual - pred_sum)) as mae, avg(abs(actual - pred_sum)) / nullif(max(case when nd > 2 then s1 end), 0) as mase, sqrt(avg(power(actual - pred_sum, 2)) / nullif(max(case when nd > 2 then s2 end), 0)) as rmsse,
  avg(actual - pred_sum) as me, avg(case when actual >= pred_sum then 0.95 * (actual - pred_sum) else 0.05 * (pred_sum - actual) end) as pinball
  from rowz r left join scaled s on s.sku_id = r.sku_id and s.origin = r.origin where actual is not null group by all)
"""


def _accuracy(spark, sf):
    windows = origins.rolling_origins(event_rows(table(spark, sf, "events")))
    return accuracy.metrics(_inputs(spark, sf).withColumn("pred_sum", F.round("pred_sum", 6)), accuracy.naive_scale(events(spark, sf), windows, HORIZON))


@query("accuracy_metrics", with_(*_BASE, _ACC) + "select model, origin, split, sku_id, n, round(mae, 3) as mae, round(mase, 6) as mase, round(rmsse, 6) as rmsse, round(me, 3) as me, round(pinball, 3) as pinball from acc")
def accuracy_metrics(spark, sf):
    return tidy(_accuracy(spark, sf), 3, mase=6, rmsse=6)


@query("accuracy_rollup", with_(*_BASE, _ACC) + "select model, origin, split, count(distinct sku_id) as n_sku, round(quantile_cont(mae, 0.5), 3) as mae, round(quantile_cont(mase, 0.5), 6) as mase, round(quantile_cont(rmsse, 0.5), 6) as rmsse from acc group by all")
def accuracy_rollup(spark, sf):
    half = F.lit(0.5)
    df = _accuracy(spark, sf).groupBy("model", "origin", "split").agg(F.countDistinct("sku_id").alias("n_sku"), F.percentile("mae", half).alias("mae"), F.percentile("mase", half).alias("mase"), F.percentile("rmsse", half).alias("rmsse"))
    return tidy(df, 6, mae=3)


_TAIL = "select model, origin, " + ", ".join(f"round(avg(case when err >= 0 then {t} * err else {t} * err - err end), 3) as pinball_{int(t * 100)}" for t in (0.85, 0.9, 0.95)) + " from errs group by all"


@query("pinball_tail", with_(*_BASE) + _TAIL)
def pinball_tail(spark, sf):
    e = F.col("err")
    loss = lambda t: F.avg(F.when(e >= 0, t * e).otherwise(t * e - e)).alias(f"pinball_{int(t * 100)}")
    return tidy(_errors(spark, sf).groupBy("model", "origin").agg(*(loss(t) for t in (0.85, 0.9, 0.95))), 3)


# --- tests on the equalised costs -------------------------------------------------------

_REL = """
wide as (select sku_id, origin, cs, fill_target, max(cost_at_target) filter (where model = 'ma7') as a, max(cost_at_target) filter (where model = 'croston_sba') as b from eq group by all),
rel as (select sku_id, origin, cs, fill_target, round(a, 6) as a, round(b, 6) as b, round(round(a, 6) - round(b, 6), 6) as diff, round((round(a, 6) - round(b, 6)) / round(b, 6), 9) as rel from wide where a is not null and b is not null and round(b, 6) <> 0)
"""


def _relative(spark, sf):
    """Paired costs of both models at equal service: difference, and share of the second model's cost; stored, since tests read it several times."""
    return keep(_paired(_equal(spark, sf), MODELS))


def _paired(equal, models):
    w = equal.groupBy("sku_id", "origin", "cs", "fill_target").pivot("model", list(models)).agg(F.first("cost_at_target")).na.drop()
    a, b = (F.round(m, 6) for m in models)
    return w.select("sku_id", "origin", "cs", "fill_target", a.alias("a"), b.alias("b")).filter("b <> 0").withColumns({"diff": F.round(F.col("a") - F.col("b"), 6), "rel": F.round((F.col("a") - F.col("b")) / F.col("b"), 9)})


def _wilcoxon_sql(source: str, by: str, value: str) -> str:
    return f"""
wx as (select {by}, {value} as d from {source} where {value} is not null),
centre as (select {by}, count(*) as n_pairs, quantile_cont(d, 0.5) as median_diff from wx group by all),
ranked as (select {by}, d, rank() over (partition by {by} order by abs(d)) + (count(*) over (partition by {by}, abs(d)) - 1) / 2.0 as r, count(*) over (partition by {by}, abs(d)) as t from wx where d <> 0),
tests as (select {by}, cast(count(*) as double) as n, coalesce(sum(r) filter (where d > 0), 0) as w_pos, coalesce(sum(r) filter (where d < 0), 0) as w_neg, sum(t * t - 1) as ties from ranked group by all),
wilcoxon as (select c.*, cast(coalesce(n, 0) as bigint) as n, cast(w_pos as double) as w_pos, cast(w_neg as double) as w_neg, round((w_pos - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48.0), 6) as z, round((w_neg - w_pos) / (w_neg + w_pos), 6) as r_rank_biserial
  from centre c left join tests using ({by}))
"""


@query("wilcoxon_statistic", with_recursive(*_ALL, _REL, _wilcoxon_sql("rel", "origin, cs, fill_target", "diff")) + "select origin, cs, fill_target, n_pairs, round(median_diff, 4) as median_diff, n, w_pos, w_neg, z, r_rank_biserial from wilcoxon")
def wilcoxon_statistic(spark, sf):
    return tidy(stats.wilcoxon(_relative(spark, sf), ["origin", "cs", "fill_target"]).drop("mean_diff", "n_neg"), 6, median_diff=4)


def _h1(spark, sf):
    rows = _relative(spark, sf).filter("cs = 5 and fill_target = 0.95")
    return stats.wilcoxon(rows, ["origin"], "rel", least=5).withColumn("pct_cheaper", F.col("n_neg") / F.col("n_pairs") * 100)


@query("h1_relative_cost", with_recursive(*_ALL, _REL, _wilcoxon_sql("(select * from rel where cs = 5 and fill_target = 0.95)", "origin", "rel")) + "select origin, n_pairs, round(median_diff, 6) as median_diff, n, w_pos, w_neg, z, r_rank_biserial, (select round(avg(cast(rel < 0 as int)) * 100, 6) from rel r where cs = 5 and fill_target = 0.95 and r.origin = w.origin) as pct_cheaper from wilcoxon w")
def h1_relative_cost(spark, sf):
    return tidy(_h1(spark, sf).drop("mean_diff", "n_neg"))


def _holm_sql(source: str, p: str, name: str, by: str = "") -> str:
    """``source`` with the step-down adjusted ``p`` over its rows, within ``by``."""
    part = f"partition by {by} " if by else ""
    return f"""
{name} as (select *, case when {p} is not null then least(1.0, max((m - rn + 1) * {p}) over ({part}order by rn rows unbounded preceding)) end as {p}_holm
  from (select *, row_number() over ({part}order by {p} nulls last) as rn, count({p}) over ({"partition by " + by if by else ""}) as m from {source}))
"""


_H1_P = (
    _wilcoxon_sql("(select * from rel where cs = 5 and fill_target = 0.95)", "origin", "rel"),
    f"h1p as (select w.*, {normal_upper_sql('-z')} as p_less, (select round(avg(cast(rel < 0 as int)) * 100, 6) from rel r where cs = 5 and fill_target = 0.95 and r.origin = w.origin) as pct_cheaper from wilcoxon w)",
    _holm_sql("h1p", "p_less", "h1"),
)


def _with_p(h1):
    """One-sided p of H1 by the normal tail, and Holm over its rows: one for each origin, bounded and read several times."""
    return stats.holm(artefacts.here(h1.withColumn("z", F.round("z", 6)).withColumn("p_less", normal_upper(-F.col("z")))), "p_less", name="p_less_holm").withColumn("supported", F.coalesce(F.col("p_less_holm") < 0.05, F.lit(False)))


@query("wilcoxon_pvalue", with_recursive(*_ALL, _REL, *_H1_P, SIGNED_RANK_SQL) + f"""select origin, n_pairs, n, w_pos, w_neg, z, r_rank_biserial, round(median_diff, 6) as median_diff, pct_cheaper, round(p_less, 9) as p_less, round(p_less_holm, 9) as p_less_holm, coalesce(p_less_holm < 0.05, false) as supported,
 case when n between 1 and {EXACT} then round((select coalesce(sum(ways), 0) from signed_rank s where s.n = h1.n and s.w >= w_neg) / power(2.0, n), 9) end as p_exact from h1""")
def wilcoxon_pvalue(spark, sf):
    """H1 with one-sided p (normal tail, and exact for few untied differences) and Holm over origins."""
    h1 = _with_p(_h1(spark, sf)).withColumn("p_exact", signed_rank_upper("w_neg", "n"))
    return tidy(h1.drop("n_neg", "mean_diff"), p_less=9, p_less_holm=9, p_exact=9)


_TREND = """
trend as (select sku_id, origin, max(rel) filter (where fill_target = 0.9) as t90, max(rel) filter (where fill_target = 0.95) as t95, max(rel) filter (where fill_target = 0.98) as t98 from rel where cs = 5 group by all),
full3 as (select *, 1.0 * ((t95 < t90)::int + (t98 < t90)::int) + (1 + (t95 = t90)::int + (t98 = t90)::int + 1) / 2.0 as r1, 1.0 * ((t90 < t95)::int + (t98 < t95)::int) + (1 + (t90 = t95)::int + (t98 = t95)::int + 1) / 2.0 as r2,
  1.0 * ((t90 < t98)::int + (t95 < t98)::int) + (1 + (t90 = t98)::int + (t95 = t98)::int + 1) / 2.0 as r3 from trend where t90 is not null and t95 is not null and t98 is not null)
"""


def _trend(spark, sf):
    rows = _relative(spark, sf).filter("cs = 5")
    return rows.groupBy("sku_id", "origin").pivot("fill_target", list(policy.TARGETS)).agg(F.first("rel")).toDF("sku_id", "origin", "t90", "t95", "t98")


@query("page_statistic", with_recursive(*_ALL, _REL, _TREND) + "select origin, count(*) as n, cast(sum(r1 + 2 * r2 + 3 * r3) as double) as page_l, round((sum(r1 + 2 * r2 + 3 * r3) - count(*) * 3 * 16 / 4.0) / sqrt(count(*) * 9 * 4 * 8 / 144.0), 6) as page_z from full3 group by 1")
def page_statistic(spark, sf):
    return tidy(stats.page(_trend(spark, sf), ["t90", "t95", "t98"], ["origin"]))


@query("friedman_statistic", with_recursive(*_ALL, _REL, _TREND) + """
select origin, n, case when n >= 5 then round((12.0 / (n * 12) * (s1 * s1 + s2 * s2 + s3 * s3) - 12 * n) / nullif(1 - ties / (n * 24.0), 0), 6) end as chi2 from (
 select origin, count(*) as n, sum(r1) as s1, sum(r2) as s2, sum(r3) as s3, sum(case when t90 = t95 and t95 = t98 then 24.0 when t90 = t95 or t95 = t98 or t90 = t98 then 6.0 else 0.0 end) as ties from full3 group by 1)""")
def friedman_statistic(spark, sf):
    return tidy(stats.friedman(_trend(spark, sf), ["t90", "t95", "t98"], ["origin"]))


@query("h2_trend", with_recursive(*_ALL, _REL, _TREND, _wilcoxon_sql("(select origin, t98 - t90 as delta from full3)", "origin", "round(delta, 9)")) + """
select origin, count(*) as n, round(quantile_cont(t90, 0.5), 6) as median_90, round(quantile_cont(t95, 0.5), 6) as median_95, round(quantile_cont(t98, 0.5), 6) as median_98, round(max(w.median_diff), 6) as median_delta,
 quantile_cont(t90, 0.5) < quantile_cont(t95, 0.5) and quantile_cont(t95, 0.5) < quantile_cont(t98, 0.5) as rising, max(w.z) as contrast_z from full3 join wilcoxon w using (origin) group by 1""")
def h2_trend(spark, sf):
    t = keep(_trend(spark, sf).na.drop())
    med = t.groupBy("origin").agg(F.count("*").alias("n")).join(medians(t, ["t90", "t95", "t98"], ["origin"]).toDF("origin", "median_90", "median_95", "median_98"), "origin")
    contrast = stats.wilcoxon(t.withColumn("delta", F.round(F.col("t98") - F.col("t90"), 9)), ["origin"], "delta").select("origin", F.col("median_diff").alias("median_delta"), F.col("z").alias("contrast_z"))
    rising = (F.col("median_90") < F.col("median_95")) & (F.col("median_95") < F.col("median_98"))
    return tidy(med.withColumn("rising", rising).join(contrast, "origin"))


_H2_P = (
    _wilcoxon_sql("(select origin, round(t98 - t90, 9) as delta from full3)", "origin", "delta"),
    "paged as (select origin, (sum(r1 + 2 * r2 + 3 * r3) - count(*) * 3 * 16 / 4.0) / sqrt(count(*) * 9 * 4 * 8 / 144.0) as page_z from full3 group by 1)",
    """fried as (select origin, count(*) as n, sum(r1) as s1, sum(r2) as s2, sum(r3) as s3, sum(case when t90 = t95 and t95 = t98 then 24.0 when t90 = t95 or t95 = t98 or t90 = t98 then 6.0 else 0.0 end) as ties from full3 group by 1)""",
    f"""h2p as (select p.origin, cast(f.n as bigint) as n, page_z, w.z as contrast_z, w.median_diff as median_delta, {normal_upper_sql("page_z")} as p_page, case when w.n_pairs >= 5 then {normal_upper_sql("w.z")} end as p_contrast,
  case when f.n >= 5 then exp(-(12.0 / (f.n * 12) * (s1 * s1 + s2 * s2 + s3 * s3) - 12 * f.n) / nullif(1 - ties / (f.n * 24.0), 0) / 2) end as p_friedman from paged p join fried f using (origin) join wilcoxon w using (origin))""",
    _holm_sql("h2p", "p_page", "h2a"),
    _holm_sql("(select * exclude (rn, m) from h2a)", "p_contrast", "h2b"),
    """h2 as (select h2b.*, m90 < m95 and m95 < m98 as rising, m90, m95, m98, coalesce(p_page_holm < 0.05, false) and m90 < m95 and m95 < m98 as supported
  from h2b join (select origin, quantile_cont(t90, 0.5) as m90, quantile_cont(t95, 0.5) as m95, quantile_cont(t98, 0.5) as m98 from full3 group by 1) using (origin))""",
)
_H2_OUT = "select origin, n, round(page_z, 6) as page_z, round(contrast_z, 6) as contrast_z, round(median_delta, 6) as median_delta, round(m90, 6) as median_t90, round(m95, 6) as median_t95, round(m98, 6) as median_t98, rising, round(p_page, 9) as p_page, round(p_page_holm, 9) as p_page_holm, round(p_contrast, 9) as p_contrast, round(p_contrast_holm, 9) as p_contrast_holm, round(p_friedman, 9) as p_friedman, supported from h2"


def _h2(trend):
    """H2 of a table of relative costs ``t90, t95, t98``: trend, contrast and Friedman p, Holm over origins, medians and the verdict."""
    t = keep(trend.na.drop())
    names = ["t90", "t95", "t98"]
    page = stats.page(t, names, ["origin"]).select("origin", "n", "page_z", normal_upper("page_z").alias("p_page"))
    contrast = stats.wilcoxon(t.withColumn("delta", F.round(F.col("t98") - F.col("t90"), 9)), ["origin"], "delta")
    contrast = contrast.withColumn("z", F.round("z", 6)).select("origin", F.col("median_diff").alias("median_delta"), F.col("z").alias("contrast_z"), F.when(F.col("n_pairs") >= 5, normal_upper("z")).alias("p_contrast"))
    fr = stats.friedman(t, names, ["origin"]).select("origin", chi2_upper_2(F.col("chi2")).alias("p_friedman"))
    df = artefacts.here(page.join(contrast, "origin").join(fr, "origin").join(medians(t, names, ["origin"], "median_"), "origin"))
    df = artefacts.here(stats.holm(df, "p_page", name="p_page_holm"))
    df = stats.holm(df, "p_contrast", name="p_contrast_holm")
    rising = (F.col("median_t90") < F.col("median_t95")) & (F.col("median_t95") < F.col("median_t98"))
    df = df.withColumn("rising", rising).withColumn("supported", F.coalesce(F.col("p_page_holm") < 0.05, F.lit(False)) & F.col("rising"))
    return tidy(df, **{c: 9 for c in df.columns if c.startswith("p_")})


@query("h2_pvalues", with_recursive(*_ALL, _REL, _TREND, *_H2_P) + _H2_OUT)
def h2_pvalues(spark, sf):
    """Page, contrast and Friedman p; the first two with Holm over origins; medians by target and the verdict."""
    return _h2(_trend(spark, sf))


@query("holm_adjust", """with f as (select p_partkey as i, p_partkey % 2 as family, (p_partkey * 7919 % 1000) / 1000.0 as p from part),
r as (select *, row_number() over (partition by family order by p, i) as rn, count(*) over (partition by family) as m from f)
select cast(i as bigint) as i, cast(family as bigint) as family, cast(p as double) as p, round(cast(least(1.0, max((m - rn + 1) * p) over (partition by family order by rn rows unbounded preceding)) as double), 6) as p_holm from r""")
def holm_adjust(spark, sf):
    i = F.col("p_partkey")
    df = table(spark, sf, "part").select(i.alias("i"), (i % 2).alias("family"), (i * 7919 % 1000 / 1000.0).alias("p"))
    return tidy(stats.holm(df, "p", ("family",)))


@query("hodges_lehmann", with_recursive(*_ALL, _REL, "d as (select origin, diff, row_number() over (partition by origin order by md5('42' || sku_id), sku_id) as i from rel where cs = 5 and fill_target = 0.95)") + "select x.origin, round(quantile_cont((x.diff + y.diff) / 2, 0.5), 4) as hodges_lehmann from d x join d y on x.origin = y.origin and x.i <= y.i group by 1")
def hodges_lehmann(spark, sf):
    return tidy(stats.hodges_lehmann(_relative(spark, sf).filter("cs = 5 and fill_target = 0.95"), ["origin"]), 4)


@query("mann_whitney_statistic", with_recursive(*_ALL, """g as (select e.origin, s.adi, not e.covered as grp from eq e join stats s using (sku_id) where e.model = 'ma7' and cs = 5 and fill_target = 0.98)""", """
mr as (select origin, grp, rank() over (partition by origin order by adi) + (count(*) over (partition by origin, adi) - 1) / 2.0 as r, count(*) over (partition by origin, adi) as t from g)""") + """
select origin, count(*) filter (where grp) as n1, count(*) filter (where not grp) as n2, cast(sum(r) filter (where grp) - count(*) filter (where grp) * (count(*) filter (where grp) + 1) / 2.0 as double) as u,
 round((sum(r) filter (where grp) - count(*) filter (where grp) * (count(*) filter (where grp) + 1) / 2.0 - count(*) filter (where grp) * count(*) filter (where not grp) / 2.0) / sqrt(count(*) filter (where grp) * count(*) filter (where not grp) / 12.0 * (count(*) + 1 - sum(t * t - 1) / (count(*) * (count(*) - 1.0)))), 6) as z from mr group by 1""".replace("select origin, count(*) filter (where grp) as n1", f"select *, round({normal_upper_sql('z')}, 9) as p_greater from (select origin, count(*) filter (where grp) as n1") + ")")
def mann_whitney_statistic(spark, sf):
    s = classify.series_stats(events(spark, sf)).select("sku_id", "adi")
    rows = _equal(spark, sf).filter("model = 'ma7' and cs = 5 and fill_target = 0.98").select("sku_id", "origin", (~F.col("covered")).alias("grp")).join(s, "sku_id")
    out = tidy(stats.mann_whitney(rows, "adi", "grp", ["origin"]))
    return tidy(out.withColumn("p_greater", normal_upper("z")), p_greater=9)


def _boot_sql(by: str, draws: int, unit: str) -> str:
    """Medians of resampled units (``units``: the groups' numbered units; ``members``: their values)."""
    return f"""
sizes as (select {by}, count(*) as k from units group by all),
drawn as (select {by}, k, b, cast(('0x' || substr(md5('42:' || b || ':' || j), 1, 12)) as bigint) % k as i from (select *, unnest(range(1, k + 1)) as j from (select *, unnest(range(1, {draws} + 1)) as b from sizes))),
meds as (select {by}, b, max(k) as k, quantile_cont(v, 0.5) as m from drawn join units using ({by}, i) join members using ({by}, c) group by {by}, b),
boot as (select {by}, max(k) as {unit}, case when max(k) >= 2 then round(quantile_cont(m, 0.025), 6) end as lo, case when max(k) >= 2 then round(quantile_cont(m, 0.975), 6) end as hi from meds group by {by})
"""


_STORES = """
members as (select origin, split_part(sku_id, '__', 2) as c, rel as v from rel where cs = 5 and fill_target = 0.95),
units as (select origin, c, row_number() over (partition by origin order by c) - 1 as i from (select distinct origin, c from members))
"""
_ROWS = """
units as (select origin, sku_id as c, row_number() over (partition by origin order by rel, sku_id) - 1 as i from rel where cs = 5 and fill_target = 0.95),
members as (select origin, sku_id as c, rel as v from rel where cs = 5 and fill_target = 0.95)
"""


@query("cluster_bootstrap", with_recursive(*_ALL, _REL, _STORES, _boot_sql("origin", 2000, "clusters")) + "select origin, clusters, lo, hi from boot")
def cluster_bootstrap(spark, sf):
    """Intervals of the median relative cost over resampled stores."""
    rows = _relative(spark, sf).filter("cs = 5 and fill_target = 0.95").withColumn("store", F.substring_index("sku_id", "__", -1))
    return tidy(stats.cluster_bootstrap(rows, "rel", "store", ("origin",)))


@query("simple_bootstrap", with_recursive(*_ALL, _REL, _ROWS, _boot_sql("origin", 5000, "n")) + "select origin, n, lo, hi from boot")
def simple_bootstrap(spark, sf):
    """Intervals of the median relative cost over resampled series."""
    return tidy(stats.simple_bootstrap(_relative(spark, sf).filter("cs = 5 and fill_target = 0.95"), "rel", ("origin",)))


@query("heterogeneity", with_recursive(*_ALL, _REL, """meta as (select distinct sku_id, cat_id, store_id, state_id from panel)""", """
het as (select 'cat_id' as dimension, cat_id as value, rel from rel join meta using (sku_id) where cs = 5 and fill_target = 0.95 union all select 'store_id', store_id, rel from rel join meta using (sku_id) where cs = 5 and fill_target = 0.95 union all select 'state_id', state_id, rel from rel join meta using (sku_id) where cs = 5 and fill_target = 0.95)""", _wilcoxon_sql("het", "dimension, value", "rel"), f"hetp as (select *, {normal_upper_sql('-z')} as p from wilcoxon)", _holm_sql("hetp", "p", "heth", "dimension")) + "select dimension, value, n_pairs, round(median_diff, 6) as median_diff, n, w_pos, w_neg, z, r_rank_biserial, round(p, 9) as p, round(p_holm, 9) as p_holm from heth")
def heterogeneity(spark, sf):
    meta = events(spark, sf).groupBy("sku_id").agg(*(F.min(c).alias(c) for c in ("cat_id", "store_id", "state_id")))
    rows = _relative(spark, sf).filter("cs = 5 and fill_target = 0.95").join(meta, "sku_id")
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("cat_id", "store_id", "state_id"))))
    found = stats.wilcoxon(rows.withColumn("x", pairs).select("x.*", "rel"), ["dimension", "value"], "rel").withColumn("z", F.round("z", 6)).withColumn("p", normal_upper(-F.col("z")))
    return tidy(stats.holm(keep(found), "p", ("dimension",)).drop("mean_diff", "n_neg"), p=9, p_holm=9)  # a row for each value


@query("cost_ratio_invariance", with_recursive(*_ALL, _REL) + "select origin, fill_target, round(max(abs(m - m5)), 6) as max_deviation from (select origin, fill_target, cs, quantile_cont(rel, 0.5) as m, max(quantile_cont(rel, 0.5)) filter (where cs = 5) over (partition by origin, fill_target) as m5 from rel group by 1, 2, 3) group by 1, 2")
def cost_ratio_invariance(spark, sf):
    m = _relative(spark, sf).groupBy("origin", "fill_target", "cs").agg(F.percentile("rel", F.lit(0.5)).alias("m"))
    base = F.max(F.when(F.col("cs") == 5, F.col("m"))).over(W.partitionBy("origin", "fill_target"))
    return tidy(m.withColumn("d", F.abs(F.col("m") - base)).groupBy("origin", "fill_target").agg(F.max("d").alias("max_deviation")))


@query("pairwise_models", with_recursive(*_ALL, _REL, _wilcoxon_sql("rel", "origin, cs, fill_target", "diff")) + "select w.origin, w.cs, w.fill_target, n_pairs, n, z, round(quantile_cont(a, 0.5), 3) as median_a, round(quantile_cont(b, 0.5), 3) as median_b, count(*) filter (where diff < 0) as wins_a, count(*) filter (where diff > 0) as wins_b from wilcoxon w join rel r on r.origin = w.origin and r.cs = w.cs and r.fill_target = w.fill_target group by all")
def pairwise_models(spark, sf):
    rows = _relative(spark, sf)
    by = ["origin", "cs", "fill_target"]
    half = F.lit(0.5)
    each = rows.groupBy(*by).agg(F.percentile("a", half).alias("median_a"), F.percentile("b", half).alias("median_b"), F.count_if(F.col("diff") < 0).alias("wins_a"), F.count_if(F.col("diff") > 0).alias("wins_b"))
    return tidy(stats.wilcoxon(rows, by).select(*by, "n_pairs", "n", "z").join(each, by), 6, median_a=3, median_b=3)


@query("sampled_trace", with_recursive(*_BASE, _SS, _sim(), _TRACE) + f"select {_TRACE_COLS} from trace where tau = 0.95 and sku_id in (select sku_id from lumpy order by md5('42' || sku_id), sku_id limit 3)")
def sampled_trace(spark, sf):
    few = sampling.simple(classify.classified(events(spark, sf)).filter("lumpy").select("sku_id"), 3)
    levels = _levels(spark, sf).filter("tau = 0.95").join(F.broadcast(few), "sku_id", "left_semi")  # three keys
    return _trace(policy.simulate_net(levels))
