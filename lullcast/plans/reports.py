"""Queries on comparisons beside the main tests: curves, pairs, subsets, tails, controls and names of stored artefacts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.dist import normal_upper, normal_upper_sql
from ..operators import claims, classify, forecast, origins, panel, policy, ranks, sampling, stats
from ..sources import artefacts, retail
from ..sources.shared import keep
from .base import EV, LUMPY, STATS, events, query, table, tidy, with_, with_recursive
from .panels import _TUNE, _TUNE_LAG, _TUNE_MSE, LISTS, ORIGINS
from .policies import _ACC, _ALL, _BASE, _REL, _TREND, HORIZON, MODELS, _accuracy, _boot_sql, _equal, _errors, _inputs, _relative, _wilcoxon_sql

_SEED = "order by md5('42' || user_id || event_type), user_id, event_type limit 6"


@query("requested_series", f"""with k as (select user_id, event_type from (select distinct user_id, event_type from events where user_id is not null and event_type is not null) {_SEED})
select cast(e.user_id as varchar) || '__' || e.event_type as sku_id, cast(date_diff('day', date '2024-01-01', cast(ts as date)) + 1 as bigint) as day, cast(sum(cast(round(value * 100) as bigint)) as double) as demand
from events e join k on k.user_id = e.user_id and k.event_type = e.event_type where ts is not null group by 1, 2""")
def requested_series(spark, sf):
    """Six requested series, read with their keys as filters of the scan."""
    known = table(spark, sf, "events").select("user_id", "event_type").dropna().distinct()
    keys = [tuple(r) for r in known.orderBy(F.md5(F.concat(F.lit("42"), F.col("user_id").cast("string"), "event_type")), "user_id", "event_type").limit(6).collect()]
    rows = retail.read_keys(spark, f"{sf}/events.parquet", ("user_id", "event_type"), keys, ["user_id", "event_type", "ts", "value"])
    return tidy(panel.event_rows(rows).groupBy("sku_id", "day").agg(F.sum("demand").alias("demand")))


@query("forecast_pairs", with_(*_BASE) + "select a.sku_id, a.day, round(a.pred_sum, 4) as pred_sum_a, round(b.pred_sum, 4) as pred_sum_b from pred a join pred b on a.sku_id = b.sku_id and a.day = b.day where a.model = 'ma7' and b.model = 'croston_sba'")
def forecast_pairs(spark, sf):
    p = events(spark, sf)
    lumpy = classify.classified(p).filter("lumpy").select("sku_id")
    both = forecast.forecasts(p.join(lumpy, "sku_id", "left_semi"), MODELS, HORIZON).withColumn("pred_sum", F.round("pred_sum", 6))
    return tidy(forecast.side_by_side(*(both.filter(F.col("model") == m) for m in MODELS)), 4)


@query("sample_marker", with_(EV, STATS, LUMPY, "few as (select sku_id from lumpy order by md5('42' || sku_id), sku_id limit 40)") + "select sku_id, sku_id in (select sku_id from few) as sampled from lumpy")
def sample_marker(spark, sf):
    lumpy = classify.classified(events(spark, sf)).filter("lumpy").select("sku_id")
    return sampling.marked(lumpy, sampling.simple(lumpy, 40))


@query("paired_vs_aggregate", with_recursive(*_ALL, _REL) + "select origin, cs, fill_target, count(*) as n, round(quantile_cont(a - b, 0.5), 4) as paired, round(quantile_cont(a, 0.5) - quantile_cont(b, 0.5), 4) as aggregate, round(quantile_cont(a - b, 0.5) - (quantile_cont(a, 0.5) - quantile_cont(b, 0.5)), 4) as gap from rel group by all")
def paired_vs_aggregate(spark, sf):
    return tidy(stats.paired_against_aggregate(_relative(spark, sf), ["origin", "cs", "fill_target"]), 4)


@query("cost_curve", with_recursive(*_ALL) + "select cs, model, origin, fill_target, count(cost_at_target) as n, round(quantile_cont(cost_at_target, 0.5), 3) as cost_median from eq group by cs, model, origin, fill_target")
def cost_curve(spark, sf):
    df = _equal(spark, sf).groupBy("cs", "model", "origin", "fill_target")
    return tidy(df.agg(F.count("cost_at_target").alias("n"), F.percentile("cost_at_target", F.lit(0.5)).alias("cost_median")), 3)


_DELTAS = """
abs3 as (select sku_id, origin, max(diff) filter (where fill_target = 0.9) as t90, max(diff) filter (where fill_target = 0.98) as t98 from rel where cs = 5 group by all),
deltas as (select origin, sku_id, 'relative' as measure, round(t98 - t90, 9) as d from full3 union all select f.origin, f.sku_id, 'absolute', round(a.t98 - a.t90, 4) from full3 f join abs3 a on a.sku_id = f.sku_id and a.origin = f.origin),
members as (select origin, measure, sku_id as c, d as v from deltas),
units as (select origin, measure, sku_id as c, row_number() over (partition by origin, measure order by d, sku_id) - 1 as i from deltas),
mid as (select origin, measure, quantile_cont(d, 0.5) as median_delta from deltas group by all)
"""


@query("h2_absolute_relative", with_recursive(*_ALL, _REL, _TREND, _DELTAS, _boot_sql("origin, measure", 5000, "n"), _wilcoxon_sql("deltas", "origin, measure", "d"), "ups as (select origin, measure, avg(cast(d > 0 as int)) as share_above from deltas group by all)") + f"select origin, measure, b.n, round(median_delta, 4) as median_delta, round(lo, 4) as lo, round(hi, 4) as hi, lo <= 0 and hi >= 0 as contains_zero, round(share_above, 6) as share_above, round({normal_upper_sql('z')}, 9) as p_greater from boot b join mid using (origin, measure) join ups using (origin, measure) join wilcoxon using (origin, measure)")
def h2_absolute_relative(spark, sf):
    """The growth of the cost difference from the lowest to the highest target, relative and absolute: interval, share above 0 and one-sided p."""
    rows = _relative(spark, sf).filter("cs = 5")
    wide = lambda c: rows.groupBy("sku_id", "origin").pivot("fill_target", list(policy.TARGETS)).agg(F.first(c)).toDF("sku_id", "origin", "t90", "t95", "t98").na.drop()
    grown = lambda c, digits, name: wide(c).select("origin", "sku_id", F.lit(name).alias("measure"), F.round(F.col("t98") - F.col("t90"), digits).alias("d"))
    deltas = keep(grown("rel", 9, "relative").unionByName(grown("diff", 4, "absolute")))
    by = ["origin", "measure"]
    test = stats.wilcoxon(deltas, by, "d").select(*by, F.col("median_diff").alias("median_delta"), F.round("z", 6).alias("z"))
    ups = deltas.groupBy(*by).agg(F.avg((F.col("d") > 0).cast("int")).alias("share_above"))
    out = stats.simple_bootstrap(deltas, "d", tuple(by)).join(test, by).join(ups, by)
    rounded = [F.round(c, 6).alias(c) for c in ("lo", "hi")]
    out = out.select(*by, "n", "median_delta", *rounded, "share_above", normal_upper("z").alias("p_greater"))
    return tidy(out.withColumn("contains_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0)), 4, share_above=6, p_greater=9)


_EARLY = """
early as (select origin, sku_id, count(*) as na, count(*) filter (where demand > 0) as nz, sum(demand) filter (where demand > 0) as s, stddev_samp(demand) filter (where demand > 0) as sd from panel join origins on day <= val_end where sell_price is not null group by origin, sku_id),
still as (select origin, sku_id from early where nz >= 2 and na / nz > 1.32 and power(sd / (s / nz), 2) > 0.49),
robust as (select r.* from rel r join still t on t.origin = r.origin and t.sku_id = r.sku_id where cs = 5 and fill_target = 0.95)
"""


@query("robustness_subset", with_recursive(*_ALL, _REL, _EARLY, _wilcoxon_sql("robust", "origin", "rel")) + "select origin, n_pairs, round(median_diff, 6) as median_diff, n, w_pos, w_neg, z, r_rank_biserial from wilcoxon")
def robustness_subset(spark, sf):
    """The relative cost again, of the series that are lumpy on the days before the test alone."""
    windows = origins.rolling_origins(panel.event_rows(table(spark, sf, "events")))
    known = events(spark, sf).join(F.broadcast(windows.select("origin", "val_end")), F.col("day") <= F.col("val_end"))  # one row for each origin
    early = classify.series_stats(panel.active(known), ("origin", "sku_id")).filter("n_nonzero >= 2").filter(classify.lumpy())
    rows = _relative(spark, sf).filter("cs = 5 and fill_target = 0.95").join(early, ["origin", "sku_id"], "left_semi")
    return tidy(stats.wilcoxon(rows, ["origin"], "rel").drop("mean_diff", "n_neg"))


_TAILS = (0.85, 0.9, 0.95)
_TAIL_SQL = """
loss as (select origin, sku_id, model, tau, avg(case when err >= 0 then tau * err else (tau - 1) * err end) as l from errs, (select unnest([0.85::double, 0.9, 0.95]) as tau) group by all),
tails as (select x.origin, x.sku_id, x.tau, round(x.l - y.l, 4) as d from loss x join loss y on x.origin = y.origin and x.sku_id = y.sku_id and x.tau = y.tau where x.model = 'ma7' and y.model = 'croston_sba')
"""


@query("tail_test", with_(*_BASE, _TAIL_SQL, _wilcoxon_sql("tails", "origin, tau", "d")) + "select origin, tau, n_pairs, round(median_diff, 4) as median_diff, n, z, r_rank_biserial from wilcoxon")
def tail_test(spark, sf):
    """Paired test of both models' quantile losses on the upper tail."""
    tau, e = F.col("tau"), F.col("err")
    each = _errors(spark, sf).withColumn("tau", F.explode(F.array(*map(F.lit, _TAILS)))).groupBy("origin", "sku_id", "tau").pivot("model", list(MODELS)).agg(F.avg(F.when(e >= 0, tau * e).otherwise((tau - 1) * e)))
    diffs = each.select("origin", "tau", F.round(F.col(MODELS[0]) - F.col(MODELS[1]), 4).alias("d"))
    return tidy(stats.wilcoxon(diffs, ["origin", "tau"], "d").select("origin", "tau", "n_pairs", "median_diff", "n", "z", "r_rank_biserial"), 6, median_diff=4)


@query("accuracy_test", with_(*_BASE, _ACC, "gap as (select x.origin, x.sku_id, round(x.mae - y.mae, 4) as d from acc x join acc y on x.origin = y.origin and x.sku_id = y.sku_id where x.split = 'test' and y.split = 'test' and x.model = 'ma7' and y.model = 'croston_sba')", _wilcoxon_sql("gap", "origin", "d")) + "select origin, n_pairs, round(median_diff, 4) as median_diff, n, z, r_rank_biserial from wilcoxon")
def accuracy_test(spark, sf):
    rows = _accuracy(spark, sf).filter("split = 'test'").groupBy("origin", "sku_id").pivot("model", list(MODELS)).agg(F.first("mae")).na.drop()
    diffs = rows.select("origin", F.round(F.col(MODELS[0]) - F.col(MODELS[1]), 4).alias("d"))
    return tidy(stats.wilcoxon(diffs, ["origin"], "d").select("origin", "n_pairs", "median_diff", "n", "z", "r_rank_biserial"), 6, median_diff=4)


@query("control_reconciliation", with_(*_BASE, _ACC, "again as (select model, origin, sku_id, avg(abs(err)) as mae, avg(err) as me from errs group by all)", "joined as (select a.mae as m1, g.mae as m2, a.me as e1, g.me as e2, a.sku_id as s1, g.sku_id as s2 from (select * from acc where split = 'val') a full join again g on a.model = g.model and a.origin = g.origin and a.sku_id = g.sku_id)") + """
select x.metric, count(*) filter (where s1 is not null and s2 is not null) as n_common, count(*) filter (where s2 is null) as n_missing, count(*) filter (where s1 is null) as n_extra, round(max(case when x.metric = 'mae' then abs(m1 - m2) else abs(e1 - e2) end), 4) as max_abs_diff
from joined, (values ('mae'), ('me')) x(metric) group by 1""")
def control_reconciliation(spark, sf):
    """The accuracy table against the same metrics made again from the validation errors."""
    stored = _accuracy(spark, sf).filter("split = 'val'").select("model", "origin", "sku_id", "mae", "me")
    again = _errors(spark, sf).groupBy("model", "origin", "sku_id").agg(F.avg(F.abs("err")).alias("mae"), F.avg("err").alias("me"))
    return tidy(claims.reconcile(stored, again, ["model", "origin", "sku_id"], ["mae", "me"]), 4)


_CLASSES = """
edges as (select x.dimension, quantile_cont(x.v, [0.25, 0.5, 0.75]) as q, min(x.v) as lo, max(x.v) as hi from (select 'adi' as dimension, adi as v from lumpy union all select 'cv2', cv2 from lumpy union all select 'volume', sum_pos from lumpy) x group by 1),
placed as (select l.sku_id, e.dimension, (select count(distinct u) from (select unnest(e.q) as u) where u > e.lo and u < e.hi and u < case e.dimension when 'adi' then l.adi when 'cv2' then l.cv2 else l.sum_pos end) as value from lumpy l, edges e),
byq as (select dimension, value, rel from rel join placed using (sku_id) where cs = 5 and fill_target = 0.95)
"""


@query("heterogeneity_quartiles", with_recursive(*_ALL, _REL, _CLASSES, _wilcoxon_sql("byq", "dimension, value", "rel")) + "select dimension, value, n_pairs, round(median_diff, 6) as median_diff, n, w_pos, w_neg, z, r_rank_biserial from wilcoxon")
def heterogeneity_quartiles(spark, sf):
    """The relative cost by quartiles of interval, variability and volume."""
    s = classify.classified(events(spark, sf)).filter("lumpy").select("sku_id", "adi", "cv2", F.col("sum_pos").alias("volume"))
    classes = ranks.value_quartiles(s.unpivot(["sku_id"], ["adi", "cv2", "volume"], "dimension", "v"), "v", ["dimension"], "value").select("sku_id", "dimension", "value")
    rows = _relative(spark, sf).filter("cs = 5 and fill_target = 0.95").join(classes, "sku_id")
    return tidy(stats.wilcoxon(rows, ["dimension", "value"], "rel").drop("mean_diff", "n_neg"))


@query("effect_labels", with_recursive(*_ALL, _REL, _wilcoxon_sql("rel", "origin, cs, fill_target", "diff")) + """
select origin, cs, fill_target, round(r, 6) as r, case when abs(r) < 0.1 then 'negligible' when abs(r) < 0.3 then 'small' when abs(r) < 0.5 then 'medium' when r is not null then 'large' end as label
from (select *, 1 - 2 * w_neg / (n * (n + 1.0)) as r from wilcoxon)""")
def effect_labels(spark, sf):
    """The older effect size of each test, and its label."""
    by = ["origin", "cs", "fill_target"]
    r = stats.effect_size(F.col("w_neg"), F.col("n").cast("double"))
    return tidy(stats.wilcoxon(_relative(spark, sf), by).select(*by, r.alias("r")).withColumn("label", stats.effect_label(F.col("r"))))


@query("debias_factors", with_(EV, LISTS, f"f as (select sku_id, day, demand, {_TUNE} from lists)", f"g as (select *, {_TUNE_LAG} from f)", f"t as (select sku_id, list_min([{_TUNE_MSE}]) as b from g where day between 17 and 23 group by 1)") + "select b.alpha as alpha, 1 - b.alpha / 2 as factor, count(*) as n from t group by 1, 2")
def debias_factors(spark, sf):
    """The bias factor that goes with each series' tuned alpha."""
    tuned = forecast.tuned_ses_alpha(events(spark, sf), 16, 23)
    return tidy(tuned.groupBy("alpha", forecast.debias(F.col("alpha")).alias("factor")).agg(F.count("*").alias("n")))


@query("prediction_names", with_(EV, ORIGINS, "kinds as (select distinct store_id from panel)") + """
select 'pred_' || store_id || h || '_o' || origin || '_s42.csv' || z as file_name, store_id as model, cast(nullif(replace(h, '_h', ''), '') as bigint) as horizon, cast(origin as bigint) as origin, 42::bigint as seed from kinds, origins, (values ('', ''), ('_h3', '.gz')) x(h, z)
union all select 'notes_' || store_id || '.txt', null, null, null, null from kinds""")
def prediction_names(spark, sf):
    """File names made for every kind of series, origin and horizon, parsed back."""
    rows = panel.event_rows(table(spark, sf, "events"))
    kinds, ends = rows.select("event_type").distinct(), F.explode(F.array(F.array(F.lit(""), F.lit("")), F.array(F.lit("_h3"), F.lit(".gz"))))
    made = kinds.join(F.broadcast(origins.rolling_origins(rows).select("origin"))).withColumn("x", ends)  # one row for each origin
    names = made.select(F.concat(F.lit("pred_"), "event_type", F.col("x")[0], F.lit("_o"), F.col("origin").cast("string"), F.lit("_s42.csv"), F.col("x")[1]).alias("file_name"))
    return tidy(artefacts.prediction_keys(names.union(kinds.select(F.concat(F.lit("notes_"), "event_type", F.lit(".txt"))))))


@query("model_names", with_(EV, "m as (select distinct store_id || '#s' || item_id as model, store_id as base from panel)") + "select model, base, min(model) over (partition by base) as resolved from m")
def model_names(spark, sf):
    """Names with a seed, their base names, and the name that each base name stands for."""
    df = panel.event_rows(table(spark, sf, "events")).select(F.concat("event_type", F.lit("#s"), F.col("user_id").cast("string")).alias("model")).distinct().withColumn("base", artefacts.base_model("model"))
    return df.join(df.groupBy("base").agg(F.min("model").alias("resolved")), "base").select("model", "base", "resolved")


@query("manifest_diff", """select path, case when b is null then 'missing' when a is null then 'new' when a = b then 'identical' else 'changed' end as status from (
select cast(doc_id as varchar) as path, case when lang <> 'es' then sha256(coalesce(text, '')) end as a, case when lang = 'de' then sha256(coalesce(text, '') || '.') when lang <> 'fr' then sha256(coalesce(text, '')) end as b from documents) where a is not null or b is not null""")
def manifest_diff(spark, sf):
    """Two manifests of the documents: German ones changed, French ones went, Spanish ones came."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("path"), "lang", F.coalesce("text", F.lit("")).alias("text"))
    digest = lambda t: F.sha2(t.cast("binary"), 256).alias("sha256")
    old = docs.filter("lang <> 'es'").select("path", digest(F.col("text")))
    new = docs.filter("lang <> 'fr'").select("path", digest(F.when(F.col("lang") == "de", F.concat("text", F.lit("."))).otherwise(F.col("text"))))
    return artefacts.manifest_status(old, new)


@query("mann_whitney_variability", with_recursive(*_ALL, """g as (select e.origin, s.cv2 as adi, not e.covered as grp from eq e join stats s using (sku_id) where e.model = 'ma7' and cs = 5 and fill_target = 0.98)""", """
mr as (select origin, grp, rank() over (partition by origin order by adi) + (count(*) over (partition by origin, adi) - 1) / 2.0 as r from g)""") + """
select origin, count(*) filter (where grp) as n1, count(*) filter (where not grp) as n2, cast(sum(r) filter (where grp) - count(*) filter (where grp) * (count(*) filter (where grp) + 1) / 2.0 as double) as u from mr group by 1""")
def mann_whitney_variability(spark, sf):
    """Are series without a cost at the highest target more variable?"""
    s = classify.series_stats(events(spark, sf)).select("sku_id", "cv2")
    rows = _equal(spark, sf).filter("model = 'ma7' and cs = 5 and fill_target = 0.98").select("sku_id", "origin", (~F.col("covered")).alias("grp")).join(s, "sku_id")
    return tidy(stats.mann_whitney(rows, "cv2", "grp", ["origin"]).drop("z"))


@query("core_mae", with_(*_BASE) + "select model, origin, split, count(*) as n, round(avg(abs(demand - pred_sum)), 4) as mae_core, round(avg(abs(actual - pred_sum)), 4) as mae_period from rowz where actual is not null group by all")
def core_mae(spark, sf):
    """The forecast of the whole period against one day's demand, as a smaller study of the same data reports it, and against the period's."""
    rows = _inputs(spark, sf).filter("actual is not null").withColumn("pred_sum", F.round("pred_sum", 6))
    e = lambda c: F.avg(F.abs(F.col(c) - F.col("pred_sum")))
    return tidy(rows.groupBy("model", "origin", "split").agg(F.count("*").alias("n"), e("demand").alias("mae_core"), e("actual").alias("mae_period")), 4)
