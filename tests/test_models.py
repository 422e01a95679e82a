"""Stored and recursive forests against loops, tail probabilities against their definitions, sensitivity runs, stored tables."""

from __future__ import annotations

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from lullcast.functions import dist
from lullcast.operators import features, intermittent, ml, origins, policy, ranks, sensitivity, stats
from lullcast.plans import others
from lullcast.sources import retail, shared


def series(spark, n=3, days=20, seed=1):
    rng = random.Random(seed)
    rows = [(f"s{i}", d, rng.choice([0.0, 0.0, float(rng.randrange(1, 9000))])) for i in range(n) for d in range(1, days + 1)]
    df = spark.createDataFrame(rows, "sku_id string, day int, demand double")
    date = F.expr("date_add(date'2024-01-01', day - 1)")
    return df.withColumns({"date": date, "snap": (F.col("day") % 5 == 0).cast("int"), "event_name_1": F.when(F.col("day") % 7 == 1, "E"), "cat_id": F.lit("c")})


def value(tree, row):
    while isinstance(tree, tuple | list):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


def test_recursion_against_a_loop(spark):
    df = series(spark)
    got = {(r.sku_id, r.day): r.steps for r in ml.recursive(df, others.ONE_DAY, 3).collect()}
    rows = {(r.sku_id, r.day): r for r in df.collect()}
    for s, t in itertools.product(("s0", "s1", "s2"), range(1, 21)):
        if t < 7 or t + 3 > 20:
            assert got[s, t] is None
            continue
        past, steps = [rows[s, d].demand for d in range(1, t + 1)], []
        for k in range(3):
            today, ahead = rows[s, t + k], rows[s, t + k + 1]
            x = past[-7:]
            mean = sum(x) / 7
            f = {"lag_1": past[-1], "lag_2": past[-2], "lag_7": past[-7], "rolling_mean_3": sum(past[-3:]) / 3, "rolling_mean_7": mean, "rolling_std_7": math.sqrt(sum((v - mean) ** 2 for v in x) / 6)}
            f |= {"dow": today.date.weekday(), "is_event": today.event_name_1 is not None, "snap": today.snap, "is_weekend": today.date.weekday() >= 5, "event_h": ahead.event_name_1 is not None, "snap_h": ahead.snap, "weekend_h": ahead.date.weekday() >= 5}
            p = max(0.0, sum(value(tree, f) for tree in others.ONE_DAY) / len(others.ONE_DAY))
            past.append(p)
            steps.append(p)
        assert got[s, t] == pytest.approx(steps)


def test_first_step_is_the_one_day_forecast(spark):
    df = series(spark, seed=2)
    one = ml.frozen(ml.one_step(df), others.ONE_DAY).select("sku_id", "day", "pred_sum").filter("pred_sum is not null")
    both = ml.recursive(df, others.ONE_DAY, 2).filter("steps is not null").select("sku_id", "day", F.col("steps")[0].alias("first")).join(one, ["sku_id", "day"]).collect()
    assert len(both) == 36 and all(r.first == pytest.approx(r.pred_sum) for r in both)


def test_fitted_forest_as_expression(spark):
    m = shared.keep(features.matrix(series(spark, 4, 40)))
    names = ("lag_1", "rolling_mean_3", "dow")
    model = ml.fit(m, 30, "forest", names, (), numTrees=4, maxDepth=3, minInstancesPerNode=2)
    plain = ml.frozen(m, ml.trees(model), "p")
    both = ml.predict(model, m, 10, 37, names).join(plain.select("sku_id", "day", "p"), ["sku_id", "day"]).collect()
    assert len(both) == 4 * 28 and all(r.pred_sum == pytest.approx(r.p, abs=1e-9) for r in both)
    assert plain.filter("day < 3").filter("p is not null").count() == 0
    assert ml.as_sql([2.0, 4.0]) == "greatest(0.0e0, (2e0 + 4e0) / 2e0)"


def test_normal_tail(spark):
    zs = [x / 8 for x in range(-320, 321)] + [7.07106781186547, -7.07106781186547, 37.5, -40.0]
    df = spark.createDataFrame([(z,) for z in zs] + [(None,)], "z double")
    for r in df.select("z", dist.normal_upper("z").alias("p"), F.expr(dist.normal_upper_sql("z")).alias("q")).collect():
        if r.z is None:
            assert r.p is None and r.q is None
            continue
        want = 0.5 * math.erfc(r.z / math.sqrt(2))
        assert r.p == pytest.approx(want, rel=1e-9, abs=1e-15) and r.q == pytest.approx(r.p, rel=1e-12)


def test_exact_signed_ranks(spark):
    rows = [(w / 2, n) for n in (1, 2, 3, 5, 8) for w in range(0, n * (n + 1) + 3)] + [(3.0, 51), (None, 4), (1.0, 0)]
    got = spark.createDataFrame(rows, "w double, n int").select("w", "n", dist.signed_rank_upper("w", "n").alias("p")).collect()
    for r in got:
        if r.w is None or not 1 <= r.n <= dist.EXACT:
            assert r.p is None
            continue
        sums = [sum(i + 1 for i in range(r.n) if mask >> i & 1) for mask in range(1 << r.n)]
        assert r.p == sum(s >= r.w for s in sums) / len(sums)
    whole = spark.createDataFrame([(0.0, 50)], "w double, n int").select(dist.signed_rank_upper("w", "n").alias("p")).first().p
    assert whole == pytest.approx(1.0, abs=1e-12)


def test_medians_and_stored_tables(spark):
    rows = spark.createDataFrame([("a", 1.0, None), ("a", 4.0, 2.0), ("a", 2.0, 2.0), ("b", None, None)], "g string, x double, y double")
    kept = shared.keep(rows)
    assert kept.schema == rows.schema and "kept-" in kept.inputFiles()[0]
    got = {r.g: (r.m_x, r.m_y) for r in ranks.medians(kept, ["x", "y"], ["g"], "m_").collect()}
    assert got["a"] == (2.0, 2.0) and got.get("b", (None, None)) == (None, None)


def test_variants_are_runs_of_their_own(spark):
    df = series(spark, 4, 40, 5)
    windows = origins.rolling_origins(df, 1, 10, 12)
    chosen = (sensitivity.Variant("base"), sensitivity.Variant("L4", lead=4, warmup=0), sensitivity.Variant("R3", review=3, rounding="ceil"), sensitivity.Variant("day", convention="per_unit_day", start="zero", bounded=False))
    rows = sensitivity.runs(df, windows, ("ma7", "naive"), chosen, (0.9,)).collect()
    assert {r.variant for r in rows} == {"base", "L4", "R3", "day"} and len(rows) == 4 * 2 * 4
    demand = {(r.sku_id, r.day): r.demand for r in df.collect()}
    w = windows.first()
    for r in rows:
        v = next(v for v in chosen if v.name == r.variant)
        d = [demand[r.sku_id, t] for t in range(1, 41)]
        width = 7 if r.model == "ma7" else 1
        pred = lambda t: round(sum(d[max(0, t - 1 - width) : t - 1]) / len(d[max(0, t - 1 - width) : t - 1]) * v.horizon, 6)  # noqa: B023, E731
        err = sorted(sum(d[t : t + v.horizon]) - pred(t) for t in range(w.train_end + 1, w.val_end + 1) if t + v.horizon <= 40)
        at = 0.9 * (len(err) - 1)
        ss = err[int(at)] + (err[min(int(at) + 1, len(err) - 1)] - err[int(at)]) * (at - int(at))
        days = list(range(w.val_end + 1, w.test_end + 1))
        level = [max(0.0, pred(t) + ss) for t in days]
        net, pipe, unmet, backlog, held, billed = (level[0] if v.start == "level" else 0.0), [0.0] * v.lead, 0.0, 0.0, 0.0, 0
        for i, t in enumerate(days):
            have = net + pipe[0]
            net, pipe = have - d[t - 1], pipe[1:]
            order = 0.0
            if i % v.review == 0:
                order = max(0.0, level[i] - net - sum(pipe))
                order = math.ceil(round(order, 6)) if v.rounding == "ceil" else order
            pipe.append(order)
            if i + 1 > v.warmup and (not v.bounded or t <= days[-1] - v.horizon):
                billed += 1
                unmet += d[t - 1] - min(max(have, 0.0), d[t - 1])
                backlog += max(-net, 0.0)
                held += max(net, 0.0)
        short = backlog if v.convention == "per_unit_day" else unmet
        assert r.billed_days == billed and r.cost_total == pytest.approx(short * policy.SCENARIOS[0][0] + held, abs=1e-4)


def test_runs_of_an_empty_panel(spark):
    df = series(spark).limit(0)
    windows = origins.rolling_origins(series(spark), 1, 5, 5)
    assert sensitivity.runs(df, windows, ("ma7",), sensitivity.VARIANTS[:2]).count() == 0


def smoothed(x):
    best = []
    for a in intermittent.GRID:
        level, loss = x[0], 0.0
        for v in x[1:]:
            loss += (v - level) ** 2
            level = a * v + (1 - a) * level
        best.append((loss, level))
    return min(best)[1]


def by_bucket(d, width):
    n = len(d) // width
    start = len(d) - n * width
    return smoothed([sum(d[start + i * width : start + (i + 1) * width]) for i in range(n)]) / width if n else 0.0


def test_intermittent_rates_against_loops(spark):
    rng = random.Random(9)
    series_ = {f"s{i}": [float(rng.randrange(1, 9)) if rng.random() < p else 0.0 for _ in range(n)] for i, (p, n) in enumerate([(0.9, 30), (0.5, 31), (0.2, 40), (0.05, 60), (0.0, 10), (1.0, 1), (0.1, 3), (0.4, 2)])}
    series_["only"] = [0.0, 0.0, 5.0]
    df = spark.createDataFrame([(s, t + 1, v) for s, d in series_.items() for t, v in enumerate(d)], "sku_id string, day int, demand double")
    starts = spark.createDataFrame([(1, 1000), (2, 25)], "origin int, start int")
    for r in intermittent.rates(df, starts).collect():
        d = series_[r.sku_id][: 999 if r.origin == 1 else 24]
        at = [i + 1 for i, v in enumerate(d) if v > 0]
        if not at:
            assert r.rate == 0
            continue
        width = max(1, round(at[-1] / len(at)))
        gaps = [float(b - a) for a, b in zip([0, *at], at, strict=False)]
        want = {"adida": by_bucket(d, width), "imapa": sum(by_bucket(d, w) for w in range(1, width + 1)) / width, "croston_optimised": smoothed([v for v in d if v > 0]) / smoothed(gaps)}
        assert r.rate == pytest.approx(want[r.model])


def test_equal_losses_take_the_weight_that_the_sql_takes(spark):
    """Gaps 7, 7, 2: no weight has a loss before the last gap but for rounding, which must be that of decimals."""
    d = [0.0] * 16
    d[6], d[13], d[15] = 21855.0, 6166.0, 383.0
    df = spark.createDataFrame([("a", t + 1, v) for t, v in enumerate(d)], "sku_id string, day int, demand double")
    got = {r.model: r.rate for r in intermittent.rates(df, spark.createDataFrame([(1, 17)], "origin int, start int")).collect()}
    assert got["croston_optimised"] == pytest.approx(1986.6738, abs=1e-4)


def test_last_day_from_footers(spark):
    kept = shared.keep(series(spark, 3, 33).repartition(3))
    last = retail.last_of(spark, kept.lullcast_path)
    plan = last._jdf.queryExecution().executedPlan().toString()
    assert last.first().last_day == 33 and "PushedAggregation: [MAX(day)]" in plan and "max(day)" in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == "false"


def test_pairwise_family_of_few(spark):
    rng = random.Random(11)
    rows = [("o", f"s{i}", m, None if i == 3 and m == "c" else round(rng.gauss(mean, 2), 2)) for i in range(12) for m, mean in (("a", 5), ("b", 9), ("c", 5))]
    df = spark.createDataFrame(rows, "origin string, sku_id string, model string, cost_at_target double")
    got = {(r.model_a, r.model_b): r for r in stats.pairwise(df, ("a", "b", "c"), ("origin",), draws=300).collect()}
    cost = {(s, m): v for _, s, m, v in rows}
    ps = {}
    for (a, b), r in got.items():
        d = [round(cost[f"s{i}", a] - cost[f"s{i}", b], 6) for i in range(12) if None not in (cost[f"s{i}", a], cost[f"s{i}", b])]
        walsh = sorted((x + y) / 2 for i, x in enumerate(d) for y in d[i:])
        mid = len(walsh) // 2
        assert r.n_pairs == len(d) == (12 if "c" not in (a, b) else 11) and (r.wins_a, r.wins_b) == (sum(x < 0 for x in d), sum(x > 0 for x in d))
        assert r.hodges_lehmann == pytest.approx(walsh[mid] if len(walsh) % 2 else (walsh[mid - 1] + walsh[mid]) / 2)
        assert min(d) <= r.lo <= r.median_diff <= r.hi <= max(d)
        assert r.p == pytest.approx(min(1.0, math.erfc(abs(r.z) / math.sqrt(2))), abs=1e-9)
        ps[a, b] = r.p
    so_far = 0.0
    for i, pair in enumerate(sorted(ps, key=ps.get)):
        so_far = max(so_far, min(1.0, (3 - i) * ps[pair]))
        assert got[pair].p_holm == pytest.approx(so_far)


def test_bootstrap_by_places(spark):
    """The same draws, value by value."""
    import hashlib

    for values in ([3.0, 1.0, 2.0, 2.0, 9.0], [4.0, 1.0, 7.0, 7.0], [5.0]):
        df = spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double")
        r = stats.simple_bootstrap(df, "v", ("g",), draws=60).first()
        order, k, found = sorted(values), len(values), []
        for b in range(1, 61):
            x = sorted(order[int(hashlib.md5(f"42:{b}:{j}".encode()).hexdigest()[:12], 16) % k] for j in range(1, k + 1))
            found.append(x[k // 2] if k % 2 else (x[k // 2 - 1] + x[k // 2]) / 2)
        found.sort()
        at = lambda q: found[int(q * 59)] + (found[min(int(q * 59) + 1, 59)] - found[int(q * 59)]) * (q * 59 - int(q * 59))  # noqa: B023, E731
        assert r.n == k and (r.lo, r.hi) == ((None, None) if k < 2 else (pytest.approx(at(0.025)), pytest.approx(at(0.975))))
