"""Boosted trees against the same trees grown row by row in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lullcast.operators import boosting


def table(spark, n=600, seed=1):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        a, b, c = float(rng.integers(0, 12)), float(rng.random()), float(rng.integers(0, 3))
        mean = math.exp(0.2 * a + (1.0 if b > 0.6 else 0.0) - 0.4 * c)
        rows.append((f"m{i % 2}", i, a, b, c, float(rng.poisson(mean) * rng.integers(1, 4)) if rng.random() > 0.3 else 0.0))
    rows += [("m0", n, None, 0.1, 1.0, 3.0), ("m1", n + 1, 1.0, 0.1, 1.0, None)]
    return spark.createDataFrame(rows, "fit string, i int, a double, b double, c double, target double")


def grown(x, y, loss, trees, depth, rate, bins, ridge, least):
    """The same rule over all rows at once, one row, cut and leaf at a time."""
    grad, curv, start = loss
    at = [sorted({float(np.quantile(x[:, f], i / bins)) for i in range(1, bins)}) for f in range(x.shape[1])]
    score = np.full(len(y), start(y.mean()))
    for _ in range(trees):
        leaf, value = np.zeros(len(y), int), np.zeros(len(y))
        g, h = grad(y, score), curv(y, score)
        for _ in range(depth):
            for k in np.unique(leaf):
                inside = leaf == k
                best = None
                for f in range(x.shape[1]):
                    for cut in at[f]:
                        left = inside & (x[:, f] <= cut)
                        right = inside & ~left
                        if left.sum() < least or right.sum() < least:
                            continue
                        part = lambda m: g[m].sum() ** 2 / (h[m].sum() + ridge)  # noqa: B023, E731
                        gain = round((part(left) + part(right) - part(inside)) / h[inside].sum(), boosting.PLACES)
                        if gain > 0 and (best is None or gain > best[0]):
                            best = gain, left, right
                if best is None:
                    value[inside] = -rate * g[inside].sum() / (h[inside].sum() + ridge)
                    continue
                for side, rows in ((1, best[1]), (2, best[2])):
                    leaf[rows] = 2 * k + side
                    value[rows] = -rate * g[rows].sum() / (h[rows].sum() + ridge)
        score = score + value
    return score


@pytest.mark.parametrize("name", ["tweedie", "squared"])
def test_boosting_against_rows(spark, name, monkeypatch):
    monkeypatch.setattr(boosting, "STORED", 2)  # scores are stored on the way
    loss = boosting.LOSSES[name]()
    df = table(spark)
    options = {"trees": 5, "depth": 3, "rate": 0.3, "bins": 8, "ridge": 1.0, "least": 15}
    models = boosting.fit(df, ("a", "b", "c"), loss=loss, **options)
    assert set(models) == {"m0", "m1"}
    got = {(r.fit, r.i): r.p for r in boosting.scored(df, models, loss=loss, name="p").collect()}
    p = 1.5
    numpy_loss = {
        "tweedie": (lambda y, s: -y * np.exp((1 - p) * s) + np.exp((2 - p) * s), lambda y, s: (p - 1) * y * np.exp((1 - p) * s) + (2 - p) * np.exp((2 - p) * s), math.log),
        "squared": (lambda y, s: s - y, lambda y, s: np.ones(len(y)), float),
    }[name]
    for key in models:
        rows = [r for r in df.collect() if r.fit == key and None not in (r.a, r.target)]
        x, y = np.array([[r.a, r.b, r.c] for r in rows]), np.array([r.target for r in rows])
        want = grown(x, y, numpy_loss, **options)
        want = np.exp(want) if name == "tweedie" else want
        assert np.allclose([got[key, r.i] for r in rows], want, rtol=1e-9)
    assert got["m0", 600] is None and got["m1", 601] is not None


def test_tweedie_learns_rates(spark):
    df = table(spark, 1500, 2)
    models = boosting.fit(df, ("a", "b", "c"), trees=12)
    rows = boosting.scored(df, models, name="p").filter("p is not null and target is not null").collect()
    y, p = np.array([r.target for r in rows]), np.array([r.p for r in rows])
    deviance = lambda m: (2 * (y**0.5 / -0.25 * 0 - y * m**-0.5 / -0.5 + m**0.5 / 0.5)).mean()
    assert (p > 0).all() and deviance(p) < 0.9 * deviance(np.full(len(y), y.mean())) and abs(p.mean() / y.mean() - 1) < 0.1


def test_boosting_without_rows(spark):
    df = table(spark).limit(0)
    assert boosting.fit(df, ("a", "b", "c")) == {}
    assert boosting.scored(table(spark, 4), {}, name="p").filter(F.col("p").isNotNull()).count() == 0
    same = spark.createDataFrame([("k", float(i), 2.0) for i in range(50)], "fit string, a double, target double")
    base, trees = boosting.fit(same, ("a",), trees=2)["k"]
    assert base == pytest.approx(math.log(2.0)) and all(not isinstance(t, tuple) or t[0] == "a" for t in trees)
    with pytest.raises(ValueError):
        boosting.tweedie(2.0)
