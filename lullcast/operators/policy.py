"""Order-up-to policies: safety stock, simulation, costs, comparison at equal service."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import exact_quantiles

TAUS = (0.50, 0.70, 0.85, 0.95, 0.99)
TARGETS = (0.90, 0.95, 0.98)
SCENARIOS = ((5.0, 1.0), (10.0, 1.0), (20.0, 1.0))
PATH = ("sku_id", "model", "origin", "tau")


def _taus(taus) -> Column:
    return F.array(*(F.lit(float(t)) for t in taus))


def quantiles(errors: DataFrame, by: list[str], taus=TAUS, empty: float | None = None) -> DataFrame:
    """``by, tau, ss``: exact quantiles (linear interpolation) of ``err``, nulls left out."""
    q = errors.groupBy(*by).agg(F.percentile("err", _taus(taus)).alias("q"))
    pairs = F.arrays_zip(_taus(taus).alias("tau"), F.col("q").alias("ss"))
    out = q.select(*by, F.explode(F.transform(pairs, lambda p: F.struct(p["tau"].alias("tau"), p["ss"].alias("ss")))).alias("x")).select(*by, "x.*")
    return out.withColumn("ss", F.coalesce("ss", F.lit(empty))) if empty is not None else out


def pooled_safety_stock(errors: DataFrame, taus=TAUS, min_obs: int = 30) -> DataFrame:
    """A series' own quantile with ``min_obs`` errors or more, else its category's, else the whole table's; with the number of errors and the source."""
    base = ["model", "origin"]
    errors = errors.filter("err is not null")
    own = errors.groupBy(*base, "sku_id").agg(F.count("*").alias("n"), F.min("cat_id").alias("cat_id"))
    mine = quantiles(errors, [*base, "sku_id"], taus).withColumnRenamed("ss", "own")
    # categories and whole tables are large: their quantiles are found by counting
    spread = lambda keys, name: exact_quantiles(errors, "err", keys, tuple(taus)).select(*keys, F.explode(F.arrays_zip(_taus(taus).alias("tau"), F.col("q"))).alias("x")).select(*keys, F.col("x.tau").alias("tau"), F.col("x.q").alias(name))
    cat, whole = spread([*base, "cat_id"], "cat"), spread(base, "whole")
    out = own.join(mine, [*base, "sku_id"]).join(cat, [*base, "cat_id", "tau"], "left").join(whole, [*base, "tau"])
    enough = F.col("n") >= min_obs
    source = F.when(enough, "series").when(F.col("cat").isNotNull(), "category").otherwise("table")
    return out.select(*base, "sku_id", "tau", F.when(enough, F.col("own")).otherwise(F.coalesce("cat", "whole")).alias("ss"), "n", source.alias("source"))


def _rounded(x: Column, rule: str, moq: float) -> Column:
    """Whole units or multiples: rounded to 9 digits first, so that a whole number stays one."""
    if rule == "ceil":
        return F.ceil(F.round(x, 9)).cast("double")
    if rule == "moq" and moq > 0:
        return F.ceil(F.round(x / moq, 9)).cast("double") * moq
    return x


def simulate_net(levels: DataFrame, keys=PATH, review: int = 1, lead: int = 2, rounding: str = "none", moq: float = 0.0, start: str = "level") -> DataFrame:
    """Daily trace of a periodic order-up-to policy with lead time and backorders, as window functions.

    ``levels`` has ``keys, day, demand, level``.  Cumulative orders are a running maximum:
    A_t = max(0, max over review days s <= t of round(S_s + D_s - net_0)), D being cumulative
    demand; net stock is net_0 + A_{t-L} - D_t.  Needs a lead time of one day or more.
    """
    if lead < 1 or review < 1:
        raise ValueError("review and lead must be one day or more")
    w = W.partitionBy(*keys).orderBy("day")
    so_far = w.rowsBetween(W.unboundedPreceding, 0)
    df = levels.withColumns({"_i": F.row_number().over(w) - 1, "_D": F.sum("demand").over(so_far), "net0": F.first("level").over(so_far) if start == "level" else F.lit(0.0)})
    need = F.when(F.col("_i") % review == 0, _rounded(F.col("level") + F.col("_D") - F.col("net0"), rounding, moq))
    df = df.withColumn("_A", F.greatest(F.lit(0.0), F.max(need).over(so_far)))
    lag = lambda c, n, other: F.coalesce(F.lag(c, n).over(w), other)
    zero = F.lit(0.0)
    df = df.withColumns({"_come": lag("_A", lead, zero), "order_qty": F.col("_A") - lag("_A", 1, zero)})
    df = df.withColumns({"net": F.col("net0") + F.col("_come") - F.col("_D"), "received": F.col("_come") - lag("_come", 1, zero)})
    df = df.withColumn("_prev", lag("net", 1, F.col("net0")))
    got = F.greatest("_prev", zero) + F.col("received")
    df = df.withColumn("settled", F.least(got, F.greatest(-F.col("_prev"), zero)))
    df = df.withColumn("unmet", F.col("demand") - F.least(F.greatest(F.col("_prev") + F.col("received"), zero), F.col("demand")))
    return df.select(*levels.columns, (F.col("_i") + 1).alias("step"), "net0", "received", "settled", (F.col("demand") - F.col("unmet")).alias("served"), "unmet", F.greatest("net", zero).alias("on_hand"), F.greatest(-F.col("net"), zero).alias("backlog"), "net", "order_qty", (F.col("net0") + F.col("_A") - F.col("_D")).alias("position_after"))


def summarise(trace: DataFrame, keys=PATH, warmup: int = 1, horizon: int = 3, bounded: bool = True) -> DataFrame:
    """Totals of each path; billed are the days after ``warmup`` up to ``horizon`` days before the path's last."""
    last = F.max("day").over(W.partitionBy(*keys))
    billed = (F.col("step") > warmup) & ((F.col("day") <= last - horizon) if bounded else F.lit(True))
    df = trace.withColumn("_b", billed)
    on = lambda c: F.sum(F.when(F.col("_b"), F.col(c)).otherwise(0.0))
    out = df.groupBy(*keys).agg(
        F.count_if("_b").alias("billed_days"), on("demand").alias("demand"), on("unmet").alias("unmet"), on("backlog").alias("backlog_days"), on("on_hand").alias("on_hand"),
        F.count_if(F.col("order_qty") > 1e-9).alias("order_days"), F.avg((F.col("on_hand") > 1e-12).cast("double")).alias("in_stock_share"), F.count_if(F.col("on_hand") > F.col("level") + 1e-9).alias("days_over_level"), F.sum("demand").alias("demand_all"), F.sum("unmet").alias("unmet_all"), F.sum("settled").alias("settled_all"), F.max_by("backlog", "day").alias("backlog_end"),
    )
    return out.withColumn("fill_rate", 1 - F.col("unmet") / F.nullif("demand", F.lit(0.0)))


def invariants(trace: DataFrame, keys=PATH, tol: float = 1e-6) -> DataFrame:
    """Over all paths: stock balance, backlog balance, non-negative stocks, served plus unmet, and position at or above level."""
    w = W.partitionBy(*keys).orderBy("day")
    prev = F.coalesce(F.lag("net").over(w), F.col("net0"))
    df = trace.withColumns({"_bal": F.abs(F.col("net") - (prev + F.col("received") - F.col("demand"))), "_run": F.abs(F.col("backlog") - (F.greatest(-F.col("net0"), F.lit(0.0)) + F.sum(F.col("unmet") - F.col("settled")).over(w.rowsBetween(W.unboundedPreceding, 0))))})
    return df.agg(
        (F.max("_bal") < tol).alias("stock_balance"), (F.max("_run") < tol).alias("backlog_balance"), (F.min(F.least("on_hand", "backlog", "unmet", "served", "order_qty")) > -tol).alias("non_negative"),
        (F.max(F.abs(F.col("served") + F.col("unmet") - F.col("demand"))) < tol).alias("units_balance"), (F.min(F.col("position_after") - F.col("level")) > -tol).alias("position_reached"),
    )


def simulate_core(levels: DataFrame, keys=PATH, review: int = 1, lead: int = 2, warmup: int = 1, legacy: bool = False) -> DataFrame:
    """The variant that ignores stock on order when it orders: a fold over each path's days.

    Starting stock is the first level rounded up.  Under ``legacy`` arrivals never settle
    the backlog.  ``levels`` has ``keys, day, demand, level``; one path's days are one array.
    """
    series = levels.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("day", "demand", "level"))).alias("days"))
    zero = F.lit(0.0)
    first = F.ceil(F.round(F.greatest(F.col("days")[0]["level"], zero), 9)).cast("double")
    state = F.struct(F.lit(0).alias("i"), first.alias("on_hand"), zero.alias("backlog"), F.array_repeat(zero, lead).alias("pipe"), zero.alias("demand"), zero.alias("unmet"), zero.alias("held"))

    def step(s: Column, x: Column) -> Column:
        have = s["on_hand"] + s["pipe"][0]
        paid = zero if legacy else F.least(have, s["backlog"])
        free = have - paid
        served = F.least(free, x["demand"])
        unmet = x["demand"] - served
        left, owed = free - served, s["backlog"] - paid + unmet
        order = F.when(s["i"] % review == 0, F.greatest(x["level"] - (left - owed), zero)).otherwise(zero)
        bill = F.when(s["i"] >= warmup, 1.0).otherwise(0.0)
        return F.struct((s["i"] + 1).alias("i"), left.alias("on_hand"), owed.alias("backlog"), F.concat(F.slice(s["pipe"], 2, lead), F.array(order)).alias("pipe"), (s["demand"] + bill * x["demand"]).alias("demand"), (s["unmet"] + bill * unmet).alias("unmet"), (s["held"] + bill * left).alias("held"))

    out = series.select(*keys, F.aggregate("days", state, step).alias("s"))
    return out.select(*keys, F.col("s.demand").alias("demand"), F.col("s.unmet").alias("unmet"), F.col("s.held").alias("on_hand"), F.col("s.backlog").alias("backlog_end"), (1 - F.col("s.unmet") / F.nullif(F.col("s.demand"), zero)).alias("fill_rate"))


def with_costs(sweep: DataFrame, scenarios=SCENARIOS, convention: str = "per_unit_once") -> DataFrame:
    """Every path under every (stock-out, holding) unit cost, from its totals: nothing is simulated again."""
    if convention not in ("per_unit_once", "per_unit_day"):
        raise ValueError(convention)
    rows = F.explode(F.array(*(F.struct(F.lit(cs).alias("cs"), F.lit(ch).alias("ch")) for cs, ch in scenarios)))
    df = sweep.withColumn("_s", rows).select(*sweep.columns, "_s.*")
    short = F.col("unmet") if convention == "per_unit_once" else F.col("backlog_days")
    df = df.withColumns({"cost_stockout": short * F.col("cs"), "cost_holding": F.col("on_hand") * F.col("ch")})
    return df.withColumn("cost_total", F.col("cost_stockout") + F.col("cost_holding"))


def at_equal_service(costs: DataFrame, targets=TARGETS, keys=("sku_id", "model", "origin", "cs", "ch")) -> DataFrame:
    """Cost at each target fill rate, by linear interpolation along a curve; null and not covered outside its range.

    A curve without billed demand has no fill rates: it counts as covered with a null cost.
    """
    goals = F.explode(F.array(*(F.lit(t) for t in targets)))
    df = costs.select(*keys, "fill_rate", "cost_total", goals.alias("fill_target"))
    point = F.struct("fill_rate", "cost_total")
    t, f = F.col("fill_target"), F.col("fill_rate")
    out = df.groupBy(*keys, "fill_target").agg(F.max(F.when(f <= t, point)).alias("lo"), F.min(F.when(f > t, point)).alias("hi"), F.min("fill_rate").alias("fill_min"), F.max("fill_rate").alias("fill_max"))
    covered = F.coalesce((F.col("fill_min") <= t) & (t <= F.col("fill_max")), F.lit(True))
    slope = (F.col("hi.cost_total") - F.col("lo.cost_total")) / F.nullif(F.col("hi.fill_rate") - F.col("lo.fill_rate"), F.lit(0.0))
    value = F.when((F.col("lo.fill_rate") == t) | F.col("hi").isNull(), F.col("lo.cost_total")).otherwise(F.col("lo.cost_total") + (t - F.col("lo.fill_rate")) * slope)
    return out.select(*keys, "fill_target", F.when(covered, value).alias("cost_at_target"), covered.alias("covered"), "fill_min", "fill_max")
