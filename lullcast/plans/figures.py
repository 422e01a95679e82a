"""Queries behind figures and the ledger of the forest's comparison with Croston, from the stored forest's predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, figures, stats
from .base import EV, events, query, tidy, with_, with_recursive
from .forest import _ALL_RF, FOREST, _relative
from .panels import _CAL, _LAGS, _TARGET, _roll
from .policies import _H1_P, _with_p

_MAIN = "cs = 5 and fill_target = 0.95"


@query("figure_paired_costs", with_recursive(*_ALL_RF) + f"select origin, sku_id, round(a, 4) as cost_a, round(b, 4) as cost_b, a < b as cheaper from rel where {_MAIN}")
def figure_paired_costs(spark, sf):
    """The scatter: each series' cost under the forest and under Croston at the middle target."""
    return tidy(figures.paired_costs(_relative(spark, sf).filter(_MAIN)), 4)


_BINS = f"""
limits0 as (select origin, fill_target, min(rel * 100) as lo, max(rel * 100) as hi from rel where cs = 5 group by all),
limits as (select origin, fill_target, case when lo = hi then lo - 0.5 else lo end as lo, case when lo = hi then hi + 0.5 else hi end as hi from limits0),
hits as (select r.origin, r.fill_target, least(24, cast(floor((rel * 100 - lo) / (hi - lo) * 25) as int)) as bin, count(*) as n from rel r join limits e on e.origin = r.origin and e.fill_target = r.fill_target where cs = 5 group by all)
"""


@query("figure_histogram", with_recursive(*_ALL_RF, _BINS) + "select e.origin, e.fill_target, cast(b.bin as bigint) as bin, round(lo + (hi - lo) * b.bin / 25, 4) as lower, round(lo + (hi - lo) * (b.bin + 1) / 25, 4) as upper, coalesce(h.n, 0) as n from limits e cross join (select unnest(range(25)) as bin) b left join hits h on h.origin = e.origin and h.fill_target = e.fill_target and h.bin = b.bin")
def figure_histogram(spark, sf):
    """25 equal bins of the relative cost difference in per cent, for each origin and target."""
    rows = _relative(spark, sf).filter("cs = 5").withColumn("pct", F.col("rel") * 100)
    return tidy(figures.histogram(rows, "pct", ["origin", "fill_target"]), 4)


@query("figure_cost_by_ratio", with_recursive(*_ALL_RF) + "select origin, cs, model, count(*) as n, round(quantile_cont(cost_at_target, 0.5), 3) as cost_median from eq where fill_target = 0.95 and cost_at_target is not null group by all")
def figure_cost_by_ratio(spark, sf):
    """The median cost at the middle target for each ratio of shortage to holding cost."""
    from ..operators import ranks
    from ..sources.shared import keep
    from .forest import _equal

    rows = keep(_equal(spark, sf).filter("fill_target = 0.95 and cost_at_target is not null").select("origin", "cs", "model", "cost_at_target"))
    by = ["origin", "cs", "model"]
    medians = ranks.medians(rows, ["cost_at_target"], by).withColumnRenamed("cost_at_target", "cost_median")
    return tidy(rows.groupBy(*by).agg(F.count("*").alias("n")).join(medians, by), 3, cs=6)


_SUMS, _SHARES = figures.impurity_parts(FOREST, "target")
_IMPORTANCE = f"""
feats as (select sku_id, day, demand, {_LAGS}, {_roll(3, 'avg')} as rolling_mean_3, {_roll(7, 'avg')} as rolling_mean_7, {_roll(7, 'stddev_samp')} as rolling_std_7, {_CAL}, {_TARGET} from panel),
known as (select * from feats where target is not null and {' and '.join(f'{c} is not null' for c in _SHARES)}),
sums as (select {', '.join(f'{text} as {name}' for name, text in _SUMS.items())} from known)
"""


@query("figure_importance", with_(EV, _IMPORTANCE) + " union all ".join(f"select '{f}' as feature, round({text}, 6) as importance from sums" for f, text in _SHARES.items()))
def figure_importance(spark, sf):
    """Impurity importance of the stored forest's features on the whole panel."""
    return tidy(figures.importances(features.matrix(events(spark, sf)), FOREST))


_CLAIMS = {"cheaper_in_most_series": ("pct_cheaper", "pct_cheaper > 50"), "lower_at_the_median": ("median_diff", "median_diff < 0"), "significant_after_holm": ("p_less_holm", "p_less_holm < 0.05")}


@query("claim_ledger", with_recursive(*_ALL_RF, *_H1_P) + " union all ".join(f"select origin, '{name}' as claim, round({c}, 6) as evidence, case when {c} is null then 'cannot be verified' when {holds} then 'match' else 'mismatch' end as status from h1" for name, (c, holds) in _CLAIMS.items()))
def claim_ledger(spark, sf):
    """What is claimed of the forest at the middle target, with its evidence, origin by origin."""
    h1 = stats.wilcoxon(_relative(spark, sf).filter(_MAIN), ["origin"], "rel", least=5).withColumn("pct_cheaper", F.col("n_neg") / F.col("n_pairs") * 100)
    return tidy(figures.ledger(_with_p(h1), ["origin"], {name: (c, F.expr(holds)) for name, (c, holds) in _CLAIMS.items()}))
