"""Boosted trees with Tweedie loss over every origin, beside the same trees grown in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boosting, features, origins
from ..operators.panel import event_rows
from .base import EV, events, query, table, tidy, with_
from .panels import _CAL, _LAGS, _TARGET, ORIGINS, _roll

#: Known from a series' third day on, so that the first origin has days to learn from.
NAMES = ("lag_1", "lag_2", "rolling_mean_3", "dow", "is_weekend", "is_event", "snap")
HORIZON, TREES, DEPTH = 3, 4, 3


def fits(windows):
    """``fit, origin, split, until, first, last``: validation days are predicted from what was known at the end of training, test days from what was known at the end of validation."""
    last_known = F.array(F.struct(F.lit("val").alias("split"), F.col("train_end").alias("known"), F.col("val_end").alias("last")), F.struct(F.lit("test").alias("split"), F.col("val_end").alias("known"), F.col("test_end").alias("last")))
    rows = windows.select("origin", F.explode(last_known).alias("x")).select("origin", "x.*")
    return rows.select(F.concat(F.lit("o"), F.col("origin").cast("string"), F.lit("_"), "split").alias("fit"), "origin", "split", (F.col("known") - HORIZON).alias("until"), (F.col("known") + 1).alias("first"), "last")


def _forecast(spark, sf, **options):
    m = features.matrix(events(spark, sf), HORIZON).select("sku_id", "day", *NAMES, "target")
    windows = F.broadcast(fits(origins.rolling_origins(event_rows(table(spark, sf, "events")))))  # two rows for each origin
    models = boosting.fit(m.join(windows, F.col("day") <= F.col("until")), NAMES, **options)
    return boosting.scored(m.join(windows, F.col("day").between(F.col("first"), F.col("last"))), models).filter("pred_sum is not null")


def _grown_sql(trees: int = TREES, depth: int = DEPTH, rate: float = boosting.RATE, bins: int = boosting.BINS, ridge: float = boosting.RIDGE, least: int = boosting.LEAST) -> str:
    """The trees level by level: sums by leaf, feature and bin, the best cut of each leaf, the next leaves."""
    shares = "[" + ", ".join(repr(i / bins) for i in range(1, bins)) + "]"
    part = lambda g, h: f"power({g}, 2) / ({h} + {ridge})"
    out = [f"""
fits as (select 'o' || origin || '_' || split as fit, origin, split, known - {HORIZON} as until, known + 1 as first, last from (select origin, 'val' as split, train_end as known, val_end as last from origins union all select origin, 'test', val_end, test_end from origins)),
m as (select sku_id, day, {_LAGS}, {_roll(3, 'avg')} as rolling_mean_3, {_CAL}, {_TARGET} from panel),
used as (select row_number() over () as i, fit, m.*, day <= until as known from m join fits on day <= until or day between first and last where {" and ".join(f"{c} is not null" for c in NAMES)} and (day > until or target is not null)),
long as (select fit, i, known, unnest(range({len(NAMES)})) as f, unnest([{", ".join(f"cast({c} as double)" for c in NAMES)}]) as x from used),
cuts as (select fit, f, list_sort(list_distinct(quantile_cont(x, {shares}))) as q from long where known group by all),
bins as (select l.fit, i, known, f, len(list_filter(q, lambda c: c < x)) as b from long l join cuts using (fit, f)),
s0 as (select fit, i, known, target as y, ln(greatest(avg(target) filter (where known) over (partition by fit), 1e-9)) as s, 0 as leaf, 0.0::double as v from used where fit in (select fit from cuts))"""]
    at = "s0"
    for t in range(trees):
        for k in range(depth):
            n = f"{t}_{k}"
            out.append(f"""
g{n} as (select fit, i, leaf, -y * exp(-0.5 * s) + exp(0.5 * s) as g, 0.5 * y * exp(-0.5 * s) + 0.5 * exp(0.5 * s) as h from {at} where known),
h{n} as (select fit, leaf, f, b, sum(g) as g, sum(h) as h, count(*) as n from g{n} join bins using (fit, i) group by all),
c{n} as (select fit, leaf, f, b, sum(g) over w as gl, sum(h) over w as hl, sum(n) over w as nl, sum(g) over a as g, sum(h) over a as h, sum(n) over a as n from h{n} window w as (partition by fit, leaf, f order by b rows unbounded preceding), a as (partition by fit, leaf, f)),
b{n} as (select fit, leaf, max(case when f = 0 then g end) as g, max(case when f = 0 then h end) as h, min({{'m': -gain, 'f': f, 'b': b, 'gl': gl, 'hl': hl}}) filter (where gain > 0) as c from
  (select *, case when nl >= {least} and n - nl >= {least} then round(({part("gl", "hl")} + {part("(g - gl)", "(h - hl)")} - {part("g", "h")}) / h, {boosting.PLACES}) end as gain from c{n}) group by all),
s{n} as (select z.fit, z.i, z.known, y, s, case when c is null then z.leaf when q.b <= c.b then 2 * z.leaf + 1 else 2 * z.leaf + 2 end as leaf,
  case when d.fit is null then v when c is null then -{rate} * d.g / (d.h + {ridge}) when q.b <= c.b then -{rate} * c.gl / (c.hl + {ridge}) else -{rate} * (d.g - c.gl) / (d.h - c.hl + {ridge}) end as v
  from {at} z left join b{n} d on d.fit = z.fit and d.leaf = z.leaf left join bins q on q.fit = z.fit and q.i = z.i and q.f = c.f)""")
            at = f"s{n}"
        out.append(f"t{t} as (select fit, i, known, y, s + v as s, 0 as leaf, 0.0::double as v from {at})")
        at = f"t{t}"
    out.append(f"boosted as (select u.sku_id, u.day, u.fit, f.origin, f.split, u.target, exp(z.s) as pred_sum from {at} z join used u on u.fit = z.fit and u.i = z.i join fits f on f.fit = u.fit where u.day between f.first and f.last)")
    return ",\n".join(x.strip() for x in out)


@query("gbt_tweedie", with_(EV, ORIGINS, _grown_sql()) + "select sku_id, day, origin, split, round(target, 4) as target, round(pred_sum, 4) as pred_sum from boosted")
def gbt_tweedie(spark, sf):
    """Boosted trees with Tweedie 1.5 loss: all series, origins, validation and test days."""
    return tidy(_forecast(spark, sf, trees=TREES, depth=DEPTH).select("sku_id", "day", "origin", "split", "target", "pred_sum"), 4)


@query("gbt_tweedie_errors", with_(EV, ORIGINS, _grown_sql()) + "select origin, split, count(*) as n, round(avg(abs(target - pred_sum)), 3) as mae, round(avg(target - pred_sum), 3) as me, round(avg(2 * (2 * sqrt(pred_sum) + 2 * target / sqrt(pred_sum) - 4 * sqrt(target))), 6) as deviance from boosted where target is not null group by all")
def gbt_tweedie_errors(spark, sf):
    """Their errors by origin: absolute, mean, and Tweedie deviance."""
    rows = _forecast(spark, sf, trees=TREES, depth=DEPTH).filter("target is not null")
    y, p = F.col("target"), F.col("pred_sum")
    out = rows.groupBy("origin", "split").agg(F.count("*").alias("n"), F.avg(F.abs(y - p)).alias("mae"), F.avg(y - p).alias("me"), F.avg(2 * (2 * F.sqrt(p) + 2 * y / F.sqrt(p) - 4 * F.sqrt(y))).alias("deviance"))
    return tidy(out, 6, mae=3, me=3)
