"""Places drawn by hashes against hashlib."""

from __future__ import annotations

import hashlib

import pytest

from lullcast.operators import draws, stats


def places(b, k):
    return sorted(int(hashlib.md5(f"42:{b}:{j}".encode()).hexdigest()[:12], 16) % k for j in range(1, k + 1))


@pytest.mark.parametrize(("prefix", "first", "last"), [(b"42:7:", 1, 9), (b"42:123:", 10, 99), (b"1234567:99999:", 1000, 1500), (b"42:5:", 99_999, 99_999)])
def test_hashes(prefix, first, last):
    want = [int(hashlib.md5(prefix + str(j).encode()).hexdigest()[:12], 16) for j in range(first, last + 1)]
    assert draws.hashed(prefix, first, last).tolist() == want


@pytest.mark.parametrize("wide", [draws.WIDE, 0.0])
def test_middles(wide, monkeypatch):
    monkeypatch.setattr(draws, "BLOCK", 64)
    sizes = [1, 2, 3, 10, 977, 2000]
    want = [(places(3, k)[(k - 1) // 2], places(3, k)[k // 2]) for k in sizes]
    assert draws.middles(b"42:3:", sizes, wide) == want


def test_a_draw_is_dealt_over_tasks_and_not_held(spark):
    """Draws of a group lie in several tasks, whatever the number of shuffle partitions; a task keeps a window of each."""
    found = draws.middle_places(spark.createDataFrame([(5,), (40,), (5,)], "_k long"), 120, 42)
    assert found.rdd.getNumPartitions() == 3
    got = {(r["_b"], r["_k"]): (r["_lo"], r["_hi"]) for r in found.collect()}
    assert got == {(b, k): (places(b, k)[(k - 1) // 2], places(b, k)[k // 2]) for b in range(1, 121) for k in (5, 40)}


def test_groups_share_the_hashes_of_a_draw(monkeypatch):
    """As in the measures and origins of ``h2_absolute_relative``: the largest group's hashes are all that are made."""
    made, hashed = [], draws.hashed
    monkeypatch.setattr(draws, "hashed", lambda prefix, first, last: made.append(last - first + 1) or hashed(prefix, first, last))
    sizes = [300, 450, 451, 900]
    assert draws.middles(b"42:9:", sizes) == [(places(9, k)[(k - 1) // 2], places(9, k)[k // 2]) for k in sizes]
    assert sum(made) == 900


def test_bootstrap_of_nothing(spark):
    df = spark.createDataFrame([("g", None)], "g string, v double")
    assert stats.simple_bootstrap(df, "v", ("g",), draws=10).count() == 0
