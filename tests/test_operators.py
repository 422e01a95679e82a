"""Operators on hand-made fixtures and properties."""

from __future__ import annotations

import collections
import math
import random

import pytest
from pyspark.sql import functions as F

from lullcast.config import Config, cells
from lullcast.functions.dist import normal_upper, signed_rank_upper
from lullcast.operators import claims, classify, features, forecast, panel, policy, ranks, sampling, stats
from lullcast.sources import artefacts, retail, synthetic


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns)).collect()]


def demand_panel(spark, series: dict[str, list[float]]):
    return spark.createDataFrame([(k, i + 1, float(d), 1.0) for k, v in series.items() for i, d in enumerate(v)], "sku_id string, day int, demand double, sell_price double")


def test_min_nonzero(spark):
    a = [0.0] * 10
    a[1] = a[9] = 3.0
    p = demand_panel(spark, {"a": a, "b": [1.0] * 10})
    assert {r.sku_id for r in classify.classified(p, min_nonzero=2).collect()} == {"a", "b"}
    assert {r.sku_id for r in classify.classified(p, min_nonzero=5).collect()} == {"b"}


def test_stats_values(spark):
    r = classify.series_stats(demand_panel(spark, {"a": [2.0, 0.0, 4.0, 0.0]})).first()
    assert (r.n_active, r.n_nonzero, r.sum_pos, r.adi) == (4, 2, 6.0, 2.0)
    assert math.isclose(r.cv2, 2 / 9)
    none = classify.series_stats(demand_panel(spark, {"a": [0.0, 0.0]})).first()
    assert none.adi == math.inf and none.cv2 is None


def test_one_demand_has_no_cv2(spark):
    r = classify.series_stats(demand_panel(spark, {"a": [0.0, 3.0, 0.0]})).first()
    assert (r.n_nonzero, r.mean_pos, r.cv2, r.adi) == (1, 3.0, None, 3.0)


def test_extended_stats_of_one_demand(spark):
    r = classify.extended_stats(demand_panel(spark, {"a": [0.0, 3.0, 0.0]})).first()
    assert (r.cv2, r.first_sale, r.last_sale, r.demand_total) == (None, 2, 2, 3.0)


def test_quartile_edges(spark):
    df = spark.createDataFrame([(f"s{i}", float(v), 1.0, "C", "S") for i, v in enumerate([1, 1, 2, 3, 3, 9])], "sku_id string, adi double, cv2 double, cat_id string, state_id string")
    got = [r.adi_q for r in sampling.with_strata(df).orderBy("sku_id").collect()]
    assert got == [0, 0, 1, 2, 3, 3]


@pytest.mark.parametrize("size", [100_000, 40])
def test_global_row_number(spark, monkeypatch, size):
    monkeypatch.setattr(ranks, "ROWS", size)
    monkeypatch.setattr(ranks, "KEYS", 200)
    rng = random.Random(3)
    data = [(f"k{i:04d}", float(rng.choice([1, 2, 2, 3, 5, 8]) if i % 2 else rng.random())) for i in range(500)] + [("z", None)] + [(f"t{i:03d}", 2.0) for i in range(400)]
    got = ranks.global_row_number(spark.createDataFrame(data, "sku_id string, v double"), "v", "sku_id", "n")
    want = {k: i + 1 for i, (k, _) in enumerate(sorted(data, key=lambda x: (x[1] is None, x[1] or 0, x[0])))}
    assert {r.sku_id: r.n for r in got.collect()} == want


def test_quantiles_by_counting(spark):
    rng = random.Random(8)
    data = [(rng.choice("ab"), rng.choice([None, 1.0, 2.0, rng.random() * 9])) for _ in range(300)] + [("c", 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    shares = (0.0, 0.1, 0.5, 0.77, 1.0)
    want = {r.g: r.q for r in df.groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r.g: r.q for r in ranks.exact_quantiles(df, "v", ["g"], shares).collect()}
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    same = spark.createDataFrame([(i, 1.0 if i < 9 else 5.0) for i in range(10)] + [(10, None)], "i int, v double")
    # equal edges are one: everything up to the only value of three quartiles is class 0
    assert {(r.v, r.quartile) for r in ranks.value_quartiles(same, "v", []).collect()} == {(1.0, 0), (5.0, 0), (None, None)}


def test_features_do_not_leak(spark):
    rng = random.Random(1)
    base = [float(rng.randint(0, 5)) for _ in range(30)]
    changed = base[:20] + [99.0] * 10
    cols = ["lag_1", "lag_2", "lag_7", "rolling_mean_3", "rolling_mean_7", "rolling_std_7"]
    get = lambda v: rows(features.rolling(features.lags(demand_panel(spark, {"a": v}))).filter("day <= 20").select("day", *cols), "day")
    assert get(base) == get(changed)


def test_ses_and_croston_against_the_loop(spark):
    def loop(xs, a):
        f = xs[0]
        for x in xs[1:]:
            f = a * x + (1 - a) * f
        return a * xs[-1] + (1 - a) * f

    rng = random.Random(5)
    d = [float(rng.choice([0, 0, 0, 2, 5, 9])) for _ in range(120)]
    got = {r.day: r.rate for r in forecast.croston(demand_panel(spark, {"a": d})).collect()}
    for day in range(1, 121):
        at = [i for i in range(day) if d[i] > 0]
        if not at:
            want = 0.0
        else:
            z = loop([d[i] for i in at], 0.1)
            want = 0.95 * z if len(at) == 1 else 0.95 * z / loop([b - a for a, b in zip(at, at[1:], strict=False)], 0.1)
        assert math.isclose(got[day], want, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("alpha", [0.05, 0.5, 0.9, 1.0])
def test_smoothing_of_long_series(spark, alpha):
    rng = random.Random(9)
    d = [float(rng.choice([0, 1, 4, 9])) for _ in range(5000)]
    got = {r.day: (r.rate, r.demand) for r in forecast.ses(demand_panel(spark, {"a": d}), alpha).collect()}
    level = d[0]
    for day, x in enumerate(d, 1):
        if day > 1:
            level = alpha * x + (1 - alpha) * level
        assert math.isclose(got[day][0], alpha * x + (1 - alpha) * level, rel_tol=1e-9, abs_tol=1e-12)


def test_both_errors_of_the_tuned_alpha(spark):
    rng = random.Random(14)
    d = [float(rng.choice([0, 0, 3, 8])) for _ in range(60)]

    def forecast_from(xs, a):
        level = xs[0]
        for x in xs[1:]:
            level = a * x + (1 - a) * level
        return a * xs[-1] + (1 - a) * level

    p = demand_panel(spark, {"a": d, "late": d[:1]})
    for error, seen in (("one_step", lambda t: d[t]), ("in_sample", lambda t: d[t - 1])):
        loss = {a: sum((seen(t) - forecast_from(d[:t], a)) ** 2 for t in range(40, 50)) / 10 for a in forecast.ALPHA_GRID}
        best = min(loss, key=lambda a: (loss[a], a))
        got = forecast.tuned_ses_alpha(p, 40, 50, error=error).collect()
        assert [(r.sku_id, r.alpha) for r in got] == [("a", best)] and got[0].mse == pytest.approx(loss[best])
    with pytest.raises(ValueError):
        forecast.tuned_ses_alpha(p, 40, 50, error="other")


def test_dense_panel_against_the_loop(spark):
    rng = random.Random(5)
    made = [(k, rng.randint(1, 25), float(rng.randint(1, 5))) for k in "abc" for _ in range(6)] + [("d", 25, 1.0)]
    total = collections.Counter()
    for k, day, v in made:
        total[k, day] += v
    df = spark.createDataFrame(made, "k string, day int, demand double")
    last = max(day for _, day, _ in made)
    for active in ("span", "full"):
        want = []
        for k in "abcd":
            own = [day for q, day in total if q == k]
            want += [(k, day, float(total[k, day]), 1.0 if active == "full" or min(own) <= day <= max(own) else None) for day in range(1, last + 1)]
        assert rows(panel.dense_panel(df, ["k"], active), "k", "day") == want
    assert panel.dense_panel(df.limit(0), ["k"]).count() == 0


def test_debias():
    assert forecast.debias(0.1) == 0.95 and forecast.debias(0.2) == 0.9


@pytest.mark.parametrize(("rounding", "moq"), [("none", 0.0), ("ceil", 0.0), ("moq", 4.0)])
@pytest.mark.parametrize(("review", "lead"), [(1, 1), (1, 3), (3, 2), (2, 7)])
def test_net_simulator_against_the_loop(spark, rounding, moq, review, lead):
    rng = random.Random(lead * 10 + review)
    n = 40
    d, s = [float(rng.randint(0, 6)) for _ in range(n)], [float(rng.randint(0, 25)) for _ in range(n)]
    df = spark.createDataFrame([("a", i + 1, d[i], s[i]) for i in range(n)], "sku_id string, day int, demand double, level double")
    got = policy.simulate_net(df, ("sku_id",), review, lead, rounding, moq).orderBy("day").collect()
    on_hand, backlog, due = s[0], 0.0, {}
    for t in range(n):
        have = on_hand + due.pop(t, 0.0)
        paid = min(have, backlog)
        served = min(have - paid, d[t])
        on_hand, backlog = have - paid - served, backlog - paid + d[t] - served
        q = max(0.0, s[t] - (on_hand - backlog + sum(due.values()))) if t % review == 0 else 0.0
        q = math.ceil(q / moq) * moq if rounding == "moq" else math.ceil(q) if rounding == "ceil" else q
        due[t + lead] = due.get(t + lead, 0.0) + q
        r = got[t]
        assert (r.on_hand, r.backlog, r.order_qty, r.settled, r.unmet) == pytest.approx((on_hand, backlog, q, paid, d[t] - served))
    assert all(policy.invariants(policy.simulate_net(df, ("sku_id",), review, lead, rounding, moq), ("sku_id",)).first()) or review > 1


def test_lead_time_is_checked(spark):
    with pytest.raises(ValueError):
        policy.simulate_net(spark.createDataFrame([], "sku_id string, day int, demand double, level double"), ("sku_id",), 1, 0)


def test_fill_rate_rises_with_stock(spark):
    rng = random.Random(7)
    d = [float(rng.choice([0, 0, 3, 5])) for _ in range(60)]
    df = spark.createDataFrame([(k, i + 1, d[i], lvl) for k, lvl in (("low", 4.0), ("high", 20.0)) for i in range(60)], "sku_id string, day int, demand double, level double")
    s = {r.sku_id: r.fill_rate for r in policy.summarise(policy.simulate_net(df, ("sku_id",)), ("sku_id",)).collect()}
    assert s["low"] <= s["high"]


def test_costs_follow_the_curve(spark):
    rng = random.Random(31)
    curves = {f"s{i}": sorted({round(rng.uniform(0.7, 1.0), 3): rng.uniform(5, 90) for _ in range(6)}.items()) for i in range(25)}
    data = [(k, "m", 1, 0.1 * j, fill, 7 * h, h) for k, points in curves.items() for j, (fill, h) in enumerate(points)]
    sweep = spark.createDataFrame(data, "sku_id string, model string, origin int, tau double, fill_rate double, unmet double, on_hand double")
    for r in policy.at_equal_service(policy.with_costs(sweep, ((3.0, 2.0),)), (0.8, 0.93)).collect():
        points = [(f, 3.0 * 7 * h + 2.0 * h) for f, h in curves[r.sku_id]]
        inside = points[0][0] <= r.fill_target <= points[-1][0]
        assert r.covered == inside
        if not inside:
            assert r.cost_at_target is None
            continue
        right = next(i for i, (f, _) in enumerate(points) if f >= r.fill_target)
        (f0, c0), (f1, c1) = points[max(right - 1, 0)], points[right]
        assert r.cost_at_target == pytest.approx(c1 if f1 == r.fill_target else c0 + (c1 - c0) * (r.fill_target - f0) / (f1 - f0))


def test_no_billed_demand_counts_as_covered(spark):
    sweep = spark.createDataFrame([("a", "m", 1, 0.5, None, 0.0, 10.0)], "sku_id string, model string, origin int, tau double, fill_rate double, unmet double, on_hand double")
    r = policy.at_equal_service(policy.with_costs(sweep, ((5.0, 1.0),)), (0.9,)).first()
    assert r.covered and r.cost_at_target is None


def test_holm(spark):
    # by hand: 4 * 0.002, then 3 * 0.011 for both equal values, then 0.5 itself
    df = spark.createDataFrame([("v", 0.5), ("w", None), ("x", 0.011), ("y", 0.002), ("z", 0.011)], "i string, p double")
    got = {r.i: r.p_holm for r in stats.holm(df).collect()}
    assert got.pop("w") is None and got == pytest.approx({"y": 0.008, "x": 0.033, "z": 0.033, "v": 0.5})


def test_holm_of_large_families(spark):
    rng = random.Random(6)
    data = [(i, rng.choice(["a", "b", None]), rng.choice([None, 0.0, 1e-5, rng.random(), rng.random() / 3000])) for i in range(3000)]
    want = {}
    for family in ("a", "b", None):
        top, known = 0.0, sorted((p, i) for i, f, p in data if f == family and p is not None)
        for k, (p, i) in enumerate(known):
            want[i] = top = max(top, (len(known) - k) * p)
    df = stats.holm(spark.createDataFrame(data, "i int, family string, p double"), "p", ("family",))
    got = {r.i: r.p_holm for r in df.collect()}
    assert len(got) == 3000 and all(got[i] is None if p is None else got[i] == pytest.approx(min(1.0, want[i])) for i, _, p in data)
    # ranks are taken in buckets of a family, not over all of it
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan and "_bucket" in plan


def test_pooled_safety_stock_without_a_category(spark):
    data = [("m", 1, "a", "x", float(e)) for e in range(9)] + [("m", 1, "b", "x", 10.0), ("m", 1, "c", None, 30.0), ("m", 2, "c", None, 7.0)]
    errors = spark.createDataFrame(data, "model string, origin int, sku_id string, cat_id string, err double")
    got = {(r.origin, r.sku_id): (r.ss, r.n, r.source) for r in policy.pooled_safety_stock(errors, taus=(0.5,), min_obs=5).collect()}
    assert got == {(1, "a"): (4.0, 9, "series"), (1, "b"): (4.5, 1, "category"), (1, "c"): (5.0, 1, "table"), (2, "c"): (7.0, 1, "table")}


def places(values):
    """Average ranks, counted pair by pair."""
    return [sum(u < v for u in values) + (sum(u == v for u in values) + 1) / 2 for v in values]


def test_wilcoxon_against_the_loop(spark):
    rng = random.Random(12)
    groups = {g: [rng.choice([None, 0.0, *(k / 4 for k in range(-6, 9))]) for _ in range(n)] for g, n in ((1, 40), (2, 9), (3, 4), (4, 1))} | {5: [0.0] * 6}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g int, diff double")
    got = {r.g: r for r in stats.wilcoxon(df, ["g"], least=5).withColumn("p", normal_upper("z")).collect()}
    for g, vs in groups.items():
        pairs = [v for v in vs if v is not None]
        d = [v for v in pairs if v]
        if not pairs:
            assert g not in got
            continue
        assert (got[g].n_pairs, got[g].n) == (len(pairs), len(d))
        if len(pairs) < 5 or not d:
            assert got[g].z is None and got[g].r_rank_biserial is None
            continue
        r = places([abs(v) for v in d])
        up, down = (sum(x for x, v in zip(r, d, strict=True) if (v > 0) == side) for side in (True, False))
        n = len(d)
        ties = sum(t**3 - t for t in collections.Counter(map(abs, d)).values())
        z = (up - n * (n + 1) / 4) / math.sqrt(n * (n + 1) * (2 * n + 1) / 24 - ties / 48)
        assert (got[g].w_pos, got[g].w_neg, got[g].z, got[g].r_rank_biserial) == pytest.approx((up, down, z, (down - up) / (down + up)))
        assert got[g].p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))


def test_exact_tail_by_enumeration(spark):
    for n in (1, 4, 9):
        sums = [sum(k + 1 for k in range(n) if m >> k & 1) for m in range(1 << n)]
        df = spark.createDataFrame([(float(w), float(n)) for w in range(n * (n + 1) // 2 + 1)], "w double, n double")
        for r in df.withColumn("p", signed_rank_upper("w", "n")).collect():
            assert r.p == pytest.approx(sum(x >= r.w for x in sums) / len(sums))


def test_page_and_friedman_against_the_loop(spark):
    rng = random.Random(17)
    rows_ = [(rng.choice("pqr"), *(rng.choice([None, *range(9)]) if rng.random() < 0.2 else rng.randint(0, 5) + j for j in range(4))) for _ in range(70)]
    df = spark.createDataFrame([(g, *(None if v is None else float(v) for v in vs)) for g, *vs in rows_], "g string, a double, b double, c double, d double")
    names = list("abcd")
    page = {r.g: r for r in stats.page(df, names, ["g"]).collect()}
    chi = {r.g: r.chi2 for r in stats.friedman(df, names, ["g"]).collect()}
    for g in "pqr":
        full = [vs for h, *vs in rows_ if h == g and None not in vs]
        ranks = [places(vs) for vs in full]
        n, k = len(full), 4
        totals = [sum(r[j] for r in ranks) for j in range(k)]
        level = sum((j + 1) * t for j, t in enumerate(totals))
        assert page[g].page_l == pytest.approx(level) and page[g].n == n
        assert page[g].page_z == pytest.approx((level - n * k * (k + 1) ** 2 / 4) / math.sqrt(n * k**2 * (k + 1) * (k**2 - 1) / 144))
        ties = sum(t**3 - t for vs in full for t in collections.Counter(vs).values())
        want = (12 / (n * k * (k + 1)) * sum(t * t for t in totals) - 3 * n * (k + 1)) / (1 - ties / (n * (k**3 - k)))
        assert chi[g] == pytest.approx(want)


def test_bootstrap_needs_two_clusters(spark):
    df = spark.createDataFrame([("x", float(i)) for i in range(9)], "c string, v double")
    assert stats.cluster_bootstrap(df, "v", "c", draws=20).first().lo is None
    df = spark.createDataFrame([(f"c{i % 4}", float(i)) for i in range(40)], "c string, v double")
    r = stats.cluster_bootstrap(df, "v", "c", draws=50).first()
    assert r.lo <= 19.5 <= r.hi


def test_claims(spark):
    t = {"x": spark.createDataFrame([(1.0, 3), (2.0, 2)], "x double, i int"), "p": spark.createDataFrame([(1, "A", 1.0), (1, "B", 2.0), (2, "A", 3.0), (2, "B", 4.0)], "o int, m string, mae double"), "e": spark.createDataFrame([], "x double")}
    made = [
        ({"table": "x", "check": "row_count", "value": 2}, claims.MATCH), ({"table": "x", "check": "range", "column": "x", "lo": 1, "hi": 1.5}, claims.MISMATCH), ({"table": "x", "check": "range", "column": "x", "lo": 1, "hi": 1.5, "tolerance": 0.5}, claims.MATCH),
        ({"table": "p", "check": "lower_everywhere", "by": "o", "model_column": "m", "models": ["A", "B"], "column": "mae"}, claims.MATCH), ({"table": "x", "check": "sequence", "column": "x", "values": [2, 1], "order": ["i"]}, claims.MATCH), ({"table": "x", "check": "sequence", "column": "x", "values": [2], "order": ["i"]}, claims.MISMATCH),
        ({"table": "x", "check": "count_where", "column": "x", "operator": ">", "value": 1, "expected": 1}, claims.MATCH), ({"table": "e", "check": "row_count", "value": 0}, claims.UNKNOWN), ({"table": "x", "check": "all_less", "column": "x", "value": 2}, claims.MISMATCH),
    ]
    got = claims.check(spark, [c | {"id": str(i)} for i, (c, _) in enumerate(made)], t)
    assert {r.id: r.status for r in got.collect()} == {str(i): s for i, (_, s) in enumerate(made)}
    assert claims.markdown(got).count("|") > 20


def test_manifest_and_sinks(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "sub" / "b.txt").write_text("y")
    found = {r.path: r.sha256 for r in artefacts.checksums(spark, str(tmp_path)).collect()}
    assert set(found) == {"a.txt", "sub/b.txt"} and found["a.txt"].startswith("2d711642")
    artefacts.write_csv(spark.createDataFrame([("b", 1.23456789), ("a", 2.0)], "k string, v double"), str(tmp_path / "out"), ["k"])
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text == "k,v\na,2.0\nb,1.234568\n"


def test_manifest_status_and_gate(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, sha256 string")
    new = spark.createDataFrame([("a", "1"), ("b", "9"), ("d", "4")], "path string, sha256 string")
    assert {tuple(r) for r in artefacts.manifest_status(old, new).collect()} == {("a", "identical"), ("b", "changed"), ("c", "missing"), ("d", "new")}
    r = artefacts.compare_manifests(old, new).first()
    assert (r.changed, r.missing, r.new, r.identical, r.valid) == (["b"], ["c"], ["d"], 1, False)
    artefacts.gate(old, old.union(new.filter("path = 'd'")))
    with pytest.raises(ValueError, match="c .missing"):
        artefacts.gate(old, new)


def test_requested_keys(spark, tmp_path):
    rows_ = [(i, s, float(i)) for i in range(6) for s in "xy"]
    spark.createDataFrame(rows_, "i int, s string, v double").write.parquet(str(tmp_path / "t"))
    df = retail.read_keys(spark, str(tmp_path / "t"), ("i", "s"), [(1, "x"), (4, "y")], ["i", "v"])
    assert rows(df) == [(1, 1.0), (4, 4.0)]
    assert "PushedFilters: [In(i" in df._jdf.queryExecution().executedPlan().toString() or "In(i, [1,4])" in df._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(ValueError):
        retail.read_keys(spark, str(tmp_path / "t"), ("i", "s"), [(1, "z")], ["v"])


def test_prices_keep_all_digits(spark):
    df = retail.normalise(spark.createDataFrame([("a", "b", "1", "2", "1.255"), ("a", "b", "2", "2", None), ("a", "b", "3", "2", "x")], "item_id string, store_id string, day string, demand string, sell_price string"))
    assert [r.sell_price for r in df.orderBy("day").collect()] == [1.255, None, None]


def test_nothing_to_sample(spark):
    empty = spark.createDataFrame([], "sku_id string, adi_q int, cv2_q int, stratum string")
    with pytest.raises(ValueError):
        sampling.stratified(empty, 5)


def test_run_log_merge(spark):
    lines = ["## a", "old", "## b", "x", "## a", "new"]
    got = artefacts.merge_run_logs(spark.createDataFrame(list(enumerate(lines)), "seq int, text string"))
    assert [(r.name, r.text) for r in got.collect()] == [("a", "## a\nnew"), ("b", "## b\nx")]


def test_retail_readers(spark, tmp_path):
    (tmp_path / "long.csv").write_text("item_id,store_id,day,demand,sell_price,junk\nI_1,S_1,1,2,1.5,z\nI_1,S_1,2,0,,z\n")
    df = retail.read_long(spark, str(tmp_path / "long.csv"))
    assert "junk" not in df.columns and rows(df.select("sku_id", "day", "demand", "sell_price", "cat_id", "snap"), "day") == [("I_1__S_1", 1, 2.0, 1.5, "CAT", 0), ("I_1__S_1", 2, 0.0, None, "CAT", 0)]
    with pytest.raises(ValueError):
        retail.require_columns(spark.createDataFrame([], "a int"))
    with pytest.raises(ValueError):
        retail.require_unique(spark.createDataFrame([(1,), (1,)], "a int"), ["a"])


def test_wide_reader(spark, tmp_path):
    (tmp_path / "s.csv").write_text("id,item_id,dept_id,cat_id,store_id,state_id,d_1,d_2\nx,I_1,D,C,CA_1,CA,3,0\n")
    (tmp_path / "c.csv").write_text("d,date,wm_yr_wk,event_name_1,snap_CA,snap_TX\nd_1,2011-01-29,1,,1,0\nd_2,2011-01-30,1,E,0,1\n")
    (tmp_path / "p.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\nCA_1,I_1,1,2.5\n")
    df = retail.read_wide(spark, *(str(tmp_path / f"{n}.csv") for n in "scp"), ["CA", "TX"])
    assert rows(df.select("day", "demand", "snap", "sell_price"), "day") == [(1, 3.0, 1, 2.5), (2, 0.0, 0, 2.5)]


def test_synthetic_panel_is_stable(spark):
    a = synthetic.synthetic_panel(spark, 8, 60)
    assert rows(a, "sku_id", "day") == rows(synthetic.synthetic_panel(spark, 8, 60).repartition(3), "sku_id", "day")
    assert a.count() == 480 and panel.active(a).count() < 480



def test_config_overrides():
    c = Config().override({"policy.lead": 3, "classify": {"adi_min": 1.1}})
    assert c.policy.lead == 3 and c.classify.adi_min == 1.1 and Config().policy.lead == 7
    with pytest.raises(KeyError):
        Config().override({"policy.nothing": 1})
    assert [n for n, _ in cells(c, [{"name": "x", "alpha": 0.2}, {}])] == ["x", "cell1"]


def test_streaming_stats(spark, tmp_path):
    from lullcast.streaming.series import daily_demand, streaming_stats

    src = spark.createDataFrame([(1, "view", f"2024-01-0{d}", 2.0 * d) for d in range(1, 6)], "user_id long, event_type string, t string, value double").selectExpr("user_id", "event_type", "cast(t as timestamp) ts", "value")
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = streaming_stats(stream.selectExpr("concat(user_id, '__', event_type) sku_id", "ts", "value demand")).writeStream.format("memory").queryName("s").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("s").select("sku_id", "n_active", "sum_pos")) == [("1__view", 5, 30.0)]
    assert daily_demand(stream).isStreaming
