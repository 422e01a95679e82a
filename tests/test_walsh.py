"""The median of pairwise means against all of them."""

from __future__ import annotations

import random
from itertools import combinations_with_replacement
from statistics import median

import numpy as np
import pytest

from lullcast.operators import stats, walsh


def means(values):
    return median((x + y) / 2 for x, y in combinations_with_replacement(values, 2))


def test_median_of_means_against_all_pairs(spark, monkeypatch):
    """Small blocks, rounds of cuts for the group of most pairs: ties, gaps, an even and an odd number of pairs, one row, nulls."""
    monkeypatch.setattr(walsh, "FEW", 1000)
    monkeypatch.setattr(walsh, "ROWS", 16)
    monkeypatch.setattr(walsh, "CUTS", 64)
    rng = random.Random(5)
    groups = {
        "ties": [float(rng.choice([-1, 0, 0, 0, 2])) for _ in range(40)],
        "wide": [rng.choice([1e-3, 1.0, 1e3]) * rng.gauss(0, 1) for _ in range(61)],
        "two": [-5.0] * 20 + [7.0] * 20,
        "gap": [-1e3] * 12 + [1e-3] * 10 + [2e3] * 12,
        "one": [3.25],
    }
    rows = [(k, v) for k, vs in groups.items() for v in vs] + [("one", None), ("none", None)]
    got = {r.g: r.hodges_lehmann for r in stats.hodges_lehmann(spark.createDataFrame(rows, "g string, diff double"), ["g"]).collect()}
    assert got == {k: pytest.approx(means(v), abs=1e-12) for k, v in groups.items()}


def test_more_rows_than_were_taken_once(spark):
    """4,000 differences were the most; the last ones decide here."""
    rng = np.random.default_rng(7)
    v = np.round(np.concatenate((rng.normal(size=3000), rng.normal(50, 1, size=2500))), 3)
    i, j = np.triu_indices(len(v))
    df = spark.createDataFrame([(1, f"s{n}", float(x)) for n, x in enumerate(v)], "g int, sku_id string, diff double")
    assert stats.hodges_lehmann(df, ["g"]).first().hodges_lehmann == pytest.approx(float(np.median((v[i] + v[j]) / 2)), abs=1e-9)


@pytest.mark.parametrize("own", [True, False])
def test_counts_and_lists_of_two_blocks(own, monkeypatch):
    monkeypatch.setattr(walsh, "SUMS", 7)
    xs, xn = np.array([-2.0, 0.1, 0.3, 4.0]), np.array([2, 1, 3, 1])
    ys, yn = (xs, xn) if own else (np.array([0.1, 0.2, 5.0]), np.array([1, 2, 2]))
    a, b = np.repeat(xs, xn), np.repeat(ys, yn)
    pairs = sorted([x + y for x, y in combinations_with_replacement(a, 2)] if own else [x + y for x in a for y in b])
    for t in (-9.0, *pairs, 99.0):
        assert walsh.counted(xs, xn, ys, yn, own, t) == sum(p <= t for p in pairs)
    lo, hi = pairs[3], pairs[-4]
    got = sorted(s for sums, ns in walsh.listed(xs, xn, ys, yn, own, lo, hi) for s, n in zip(sums, ns, strict=True) for _ in range(n))
    assert got == [p for p in pairs if lo < p <= hi]
