"""The learned forecaster against Croston's: predictions of a stored forest, and the tests that follow from them.

The forest is frozen: fitted once, on other tables than it is asked about, and kept as plain values, so
that both engines make the same predictions and everything after them can be compared row by row.
"""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dist import normal_upper, normal_upper_sql
from ..operators import accuracy, classify, features, forecast, ml, origins, policy, ranks, stats
from ..operators.panel import event_rows
from ..sources.shared import keep
from .base import EV, LUMPY, STATS, events, query, table, tidy, with_, with_recursive
from .panels import _CAL, _LAGS, _TARGET, LISTS, ORIGINS, _roll, croston_sql
from .policies import _ACC, _COSTS, _H1_P, _H2_OUT, _H2_P, _REL, _SUM, _TAUS, _TRACE, _TREND, HORIZON, _boot_sql, _h2, _holm_sql, _paired, _sim, _wilcoxon_sql, _with_p

MODELS = ("rf", "croston_sba")
#: A forest of five trees over the features of ``features.matrix``, fitted on the smallest tables:
#: a leaf is its value, a node its feature, threshold and both sides.
FOREST = [
    ("rolling_mean_7", 4577.07,
     ("rolling_std_7", 6940.0, ("snap_h", 0.5, 7336.0, 5760.9), ("lag_1", 122.0, 10950.5, 6023.0)),
     ("rolling_mean_3", 4.67, 13092.6, ("rolling_std_7", 8052.52, 2794.7, 5918.5))),
    ("rolling_std_7", 10171.03,
     ("rolling_mean_3", 5467.83, ("rolling_mean_3", 3744.17, 6253.4, 8938.6), ("lag_7", 3458.0, 3449.2, 6941.9)),
     ("rolling_mean_3", 1034.33, ("snap_h", 0.5, 26037.6, 12735.0), ("rolling_mean_3", 8464.17, 8921.5, 3872.3))),
    ("dow", 1.5,
     ("rolling_mean_3", 815.67, ("lag_2", 1391.0, 9277.1, 2612.2), ("lag_1", 587.0, 7443.2, 5361.9)),
     ("rolling_mean_3", 5995.83, ("weekend_h", 0.5, 7444.4, 6079.2), ("lag_7", 4576.5, 3230.0, 9616.1))),
    ("rolling_std_7", 10171.03,
     ("rolling_mean_7", 4132.57, ("lag_7", 10892.5, 6309.1, 10237.0), ("lag_7", 15337.0, 4146.2, 8209.6)),
     ("rolling_mean_3", 4.67, ("snap_h", 0.5, 30143.6, 13488.7), ("dow", 5.5, 4899.7, 15389.2))),
    ("rolling_mean_3", 5467.83,
     ("lag_7", 15337.0, ("rolling_mean_3", 3744.17, 6579.7, 8366.1), ("snap_h", 0.5, 13540.0, 7365.8)),
     ("rolling_std_7", 4830.61, ("dow", 4.5, 5605.9, 11461.5), ("lag_2", 214.5, 4820.3, 2675.2))),
]


def _inputs(spark, sf, models=MODELS):
    """The models' forecasts of the lumpy series on validation and test days, stored: the forest's look-ahead features end before the panel."""
    p = events(spark, sf)
    p = p.join(classify.classified(p).filter("lumpy").select("sku_id"), "sku_id", "left_semi")
    rows = forecast.RATES["croston_sba"](ml.frozen(features.matrix(p, HORIZON), FOREST, "_rf")).withColumnRenamed("target", "actual")
    sums = {"rf": F.col("_rf"), "croston_sba": F.col("rate") * HORIZON}
    if "ma7" in models:
        rows = forecast.RATES["ma7"](rows.withColumnRenamed("rate", "_croston")).withColumnRenamed("rate", "_ma7").withColumnRenamed("_croston", "rate")
        sums["ma7"] = F.col("_ma7") * HORIZON
    pairs = F.array(*(F.struct(F.lit(m).alias("model"), F.round(sums[m], 6).alias("pred_sum")) for m in models))
    rows = rows.withColumn("_x", F.explode(pairs)).select("sku_id", "day", "demand", "actual", "cat_id", "_x.*")
    return origins.split_days(rows, origins.rolling_origins(event_rows(table(spark, sf, "events"))))


def _levels(spark, sf, models=MODELS):
    """Order-up-to levels on test days; days without a forecast take the one before, or the first after."""
    rows = keep(_inputs(spark, sf, models))
    err = rows.filter("split = 'val'").withColumn("err", F.col("actual") - F.col("pred_sum")).filter("err is not null")
    ss = policy.quantiles(err, ["model", "origin", "sku_id"])
    own = rows.filter("split = 'test'").join(ss, ["model", "origin", "sku_id"])
    level = F.when(F.col("pred_sum").isNotNull(), F.greatest(F.col("pred_sum") + F.col("ss"), F.lit(0.0)))
    w = W.partitionBy(*policy.PATH).orderBy("day")
    filled = F.coalesce(F.last("_l", True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.first("_l", True).over(w.rowsBetween(0, W.unboundedFollowing)))
    return own.withColumn("_l", level).select(*policy.PATH, "day", "demand", filled.alias("level"))


def _equal(spark, sf, models=MODELS):
    sweep = policy.summarise(policy.simulate_net(_levels(spark, sf, models)), horizon=HORIZON).withColumn("fill_rate", F.round("fill_rate", 9))
    return policy.at_equal_service(policy.with_costs(sweep))


def _relative(spark, sf):
    return keep(_paired(_equal(spark, sf), MODELS))


_RF = f"""
feats as (select sku_id, day, demand, cat_id, {_LAGS}, {_roll(3, 'avg')} as rolling_mean_3, {_roll(7, 'avg')} as rolling_mean_7, {_roll(7, 'stddev_samp')} as rolling_std_7, {_CAL}, {_TARGET} from panel where sku_id in (select sku_id from lumpy)),
fwd as (select sku_id, day, demand, cat_id, target as actual, round({ml.as_sql(FOREST)}, 6) as rf from feats),
cro as (select sku_id, day, round(3 * {croston_sql(0.1, 0.95)}, 6) as croston_sba from lists),
pred as (select sku_id, day, demand, cat_id, actual, 'rf' as model, rf as pred_sum from fwd union all select f.sku_id, f.day, demand, cat_id, actual, 'croston_sba', croston_sba from fwd f join cro using (sku_id, day)),
rowz as (select p.*, origin, case when day <= val_end then 'val' else 'test' end as split from pred p join origins on day > train_end and day <= test_end),
errs as (select sku_id, cat_id, model, origin, day, actual - pred_sum as err from rowz where split = 'val' and actual is not null and pred_sum is not null)
"""
_LEVELS = f"""
ssq as (select model, origin, sku_id, quantile_cont(err, {_TAUS}) as q from errs group by all),
ss as (select model, origin, sku_id, cast(unnest({_TAUS}) as double) as tau, unnest(q) as ss from ssq),
level0 as (select r.sku_id, r.model, r.origin, tau, day, demand, case when pred_sum is not null then greatest(pred_sum + ss, 0.0) end as l from rowz r join ss on ss.sku_id = r.sku_id and ss.model = r.model and ss.origin = r.origin where split = 'test'),
levels as (select sku_id, model, origin, tau, day, demand, coalesce(last_value(l ignore nulls) over (w rows between unbounded preceding and current row), first_value(l ignore nulls) over (w rows between current row and unbounded following)) as level
  from level0 window w as (partition by sku_id, model, origin, tau order by day))
"""
_BASE_RF = (EV, STATS, LUMPY, ORIGINS, LISTS, _RF)
_ALL_RF = (*_BASE_RF, _LEVELS, _sim(), _TRACE, _SUM, _COSTS, _REL.replace("'ma7'", "'rf'"))


@query("rf_frozen_forecast", with_(*_BASE_RF) + "select sku_id, day, model, origin, split, round(actual, 4) as actual, round(pred_sum, 4) as pred_sum from rowz")
def rf_frozen_forecast(spark, sf):
    """The stored forest's predictions beside Croston's, on every validation and test day."""
    return tidy(_inputs(spark, sf).select("sku_id", "day", "model", "origin", "split", "actual", "pred_sum"), 4)


@query("rf_service_equalized", with_recursive(*_ALL_RF) + "select sku_id, model, origin, cs, ch, fill_target, round(cost_at_target, 3) as cost_at_target, covered, round(fill_min, 6) as fill_min, round(fill_max, 6) as fill_max from eq")
def rf_service_equalized(spark, sf):
    return tidy(_equal(spark, sf), 6, cost_at_target=3)


@query("rf_accuracy_rollup", with_(*_BASE_RF, _ACC) + "select model, origin, split, count(distinct sku_id) as n_sku, round(quantile_cont(mae, 0.5), 3) as mae, round(quantile_cont(mase, 0.5), 6) as mase, round(quantile_cont(rmsse, 0.5), 6) as rmsse from acc group by all")
def rf_accuracy_rollup(spark, sf):
    windows = origins.rolling_origins(event_rows(table(spark, sf, "events")))
    rows = _inputs(spark, sf).filter("pred_sum is not null or actual is null")
    each = keep(accuracy.metrics(rows, accuracy.naive_scale(events(spark, sf), windows, HORIZON)))
    by = ["model", "origin", "split"]
    return tidy(each.groupBy(*by).agg(F.countDistinct("sku_id").alias("n_sku")).join(ranks.medians(each, ["mae", "mase", "rmsse"], by), by), 6, mae=3)


@query("h1_rf", with_recursive(*_ALL_RF, *_H1_P) + "select origin, n_pairs, n, w_pos, w_neg, z, r_rank_biserial, round(median_diff, 6) as median_diff, pct_cheaper, round(p_less, 9) as p_less, round(p_less_holm, 9) as p_less_holm, coalesce(p_less_holm < 0.05, false) as supported from h1")
def h1_rf(spark, sf):
    """Is the forest cheaper than Croston at the middle target, at equal service?"""
    rows = _relative(spark, sf).filter("cs = 5 and fill_target = 0.95")
    h1 = stats.wilcoxon(rows, ["origin"], "rel", least=5).withColumn("pct_cheaper", F.col("n_neg") / F.col("n_pairs") * 100)
    return tidy(_with_p(h1).drop("n_neg", "mean_diff"), p_less=9, p_less_holm=9)


@query("h2_rf", with_recursive(*_ALL_RF, _TREND, *_H2_P) + _H2_OUT)
def h2_rf(spark, sf):
    """Does the forest's relative cost rise with the target?"""
    rows = _relative(spark, sf).filter("cs = 5")
    return _h2(rows.groupBy("sku_id", "origin").pivot("fill_target", list(policy.TARGETS)).agg(F.first("rel")).toDF("sku_id", "origin", "t90", "t95", "t98"))


_TAILS = (0.85, 0.9, 0.95)
_TAIL_RF = """
loss as (select origin, sku_id, model, tau, avg(case when err >= 0 then tau * err else (tau - 1) * err end) as l from errs, (select unnest([0.85::double, 0.9, 0.95]) as tau) group by all),
maes as (select origin, sku_id, model, avg(abs(err)) as l from errs group by all),
tails as (select x.origin, x.tau, round(x.l - y.l, 4) as d from loss x join loss y on x.origin = y.origin and x.sku_id = y.sku_id and x.tau = y.tau where x.model = 'rf' and y.model = 'croston_sba'
  union all select x.origin, null, round(x.l - y.l, 4) from maes x join maes y on x.origin = y.origin and x.sku_id = y.sku_id where x.model = 'rf' and y.model = 'croston_sba'),
named as (select origin, coalesce('pinball_' || cast(round(tau * 100) as int), 'mae') as metric, d from tails)
"""


@query("rf_tail_test", with_(*_BASE_RF, _TAIL_RF, _wilcoxon_sql("named", "origin, metric", "d")) + "select origin, metric, n_pairs, n, z, r_rank_biserial, round(median_diff, 4) as median_diff, round(2 * least(u, 1 - u), 9) as p_two_sided from (select *, " + normal_upper_sql("z") + " as u from wilcoxon)")
def rf_tail_test(spark, sf):
    """Paired tests of both models' absolute error and upper quantile losses, with two-sided p."""
    e = F.col("err")
    err = _inputs(spark, sf).filter("split = 'val'").withColumn("err", F.col("actual") - F.col("pred_sum")).filter("err is not null")
    losses = [F.avg(F.abs(e)).alias("mae"), *(F.avg(F.when(e >= 0, t * e).otherwise((t - 1) * e)).alias(f"pinball_{round(t * 100)}") for t in _TAILS)]
    each = err.groupBy("origin", "sku_id", "model").agg(*losses).unpivot(["origin", "sku_id", "model"], ["mae", *(f"pinball_{round(t * 100)}" for t in _TAILS)], "metric", "l")
    diffs = each.groupBy("origin", "sku_id", "metric").pivot("model", list(MODELS)).agg(F.first("l")).select("origin", "metric", F.round(F.col("rf") - F.col("croston_sba"), 4).alias("d"))
    out = stats.wilcoxon(keep(diffs), ["origin", "metric"], "d").withColumn("z", F.round("z", 6))
    upper = normal_upper("z")
    out = out.withColumn("p_two_sided", 2 * F.least(upper, 1 - upper))
    return tidy(out.select("origin", "metric", "n_pairs", "n", "z", "r_rank_biserial", "median_diff", "p_two_sided"), 6, median_diff=4, p_two_sided=9)


#: The family of comparisons: every two of these, at every target.
FAMILY = ("rf", "croston_sba", "ma7")
_MORE = _RF.replace("as rf from feats)", "as rf, round(coalesce(avg(demand) over (partition by sku_id order by day rows between 7 preceding and 1 preceding), 0.0) * 3, 6) as ma7 from feats)").replace("rowz as (", "pred3 as (select * from pred union all select sku_id, day, demand, cat_id, actual, 'ma7', ma7 from fwd),\nrowz as (").replace("from pred p join", "from pred3 p join")
_FAMILY = f"""
trio as (select sku_id, origin, fill_target, round(max(cost_at_target) filter (where model = 'rf'), 6) as x1, round(max(cost_at_target) filter (where model = 'croston_sba'), 6) as x2, round(max(cost_at_target) filter (where model = 'ma7'), 6) as x3 from eq where cs = 5 group by all),
pairs as (select sku_id, origin, fill_target, m.model_a, m.model_b, case m.model_a when 'rf' then x1 else x2 end as a, case m.model_b when 'croston_sba' then x2 else x3 end as b from trio, (values ('rf', 'croston_sba'), ('rf', 'ma7'), ('croston_sba', 'ma7')) m(model_a, model_b)),
duel as (select *, round(a - b, 6) as diff from pairs where a is not null and b is not null),
units as (select origin, fill_target, model_a, model_b, sku_id as c, row_number() over (partition by origin, fill_target, model_a, model_b order by diff, sku_id) - 1 as i from duel),
members as (select origin, fill_target, model_a, model_b, sku_id as c, diff as v from duel),
counted as (select origin, fill_target, model_a, model_b, count(*) filter (where diff < 0) as wins_a, count(*) filter (where diff > 0) as wins_b, quantile_cont(a, 0.5) as median_a, quantile_cont(b, 0.5) as median_b from duel group by all),
walsh as (select x.origin, x.fill_target, x.model_a, x.model_b, quantile_cont((x.diff + y.diff) / 2, 0.5) as hodges_lehmann from duel x join duel y on x.origin = y.origin and x.fill_target = y.fill_target and x.model_a = y.model_a and x.model_b = y.model_b and x.sku_id <= y.sku_id group by all)
"""
_KEYS = "origin, fill_target, model_a, model_b"
_P2 = f"least(1.0, 2 * least({normal_upper_sql('z')}, 1 - ({normal_upper_sql('z')})))"


@query(
    "pairwise_family",
    with_recursive(EV, STATS, LUMPY, ORIGINS, LISTS, _MORE, _LEVELS, _sim(), _TRACE, _SUM, _COSTS, _FAMILY, _wilcoxon_sql("duel", _KEYS, "diff"), _boot_sql(_KEYS, 5000, "k"), f"tested as (select *, {_P2} as p from wilcoxon)", _holm_sql("tested", "p", "held", "origin, fill_target"))
    + f"select {_KEYS}, n_pairs, wins_a, wins_b, round(median_a, 3) as median_a, round(median_b, 3) as median_b, round(median_diff, 4) as median_diff, z, r_rank_biserial, round(p, 9) as p, round(p_holm, 9) as p_holm, round(lo, 3) + 0.0 as lo, round(hi, 3) + 0.0 as hi, round(hodges_lehmann, 4) as hodges_lehmann from held join counted using ({_KEYS}) join boot using ({_KEYS}) join walsh using ({_KEYS})",
)
def pairwise_family(spark, sf):
    """Every two models at every target: wins, tests with Holm over a target's family, interval and shift."""
    equal = _equal(spark, sf, FAMILY).filter("cs = 5").select("sku_id", "model", "origin", "fill_target", "cost_at_target")
    out = stats.pairwise(equal, FAMILY, ("origin", "fill_target"))
    return tidy(out, 6, median_a=3, median_b=3, median_diff=4, p=9, p_holm=9, lo=3, hi=3, hodges_lehmann=4)
