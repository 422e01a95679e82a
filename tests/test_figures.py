"""Tables behind figures against numpy and loops, file checksums by blocks, the gate before a run."""

from __future__ import annotations

import gzip
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lullcast.__main__ import main
from lullcast.operators import figures, ranks
from lullcast.sources import artefacts, retail, shared

FOREST = [("x", 3.0, ("y", 0.5, 1.0, 2.0), ("x", 7.0, 3.0, 4.0)), ("y", 0.5, 1.0, ("x", 5.0, 2.0, 6.0))]


def test_histogram_against_numpy(spark):
    rng = random.Random(4)
    values = {"a": [rng.uniform(-3, 9) for _ in range(500)], "b": [2.0] * 7, "c": [0.0, 1.0, 1.0, 25.0]}
    rows = [(g, v) for g, vs in values.items() for v in vs] + [("a", None), ("d", None)]
    got = figures.histogram(spark.createDataFrame(rows, "g string, v double"), "v", ["g"], 25).collect()
    assert {r.g for r in got} == set(values) and len(got) == 75
    for g, vs in values.items():
        n, edges = np.histogram(vs, bins=25)
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.bin)
        assert [r.n for r in mine] == n.tolist()
        assert np.allclose([r.lower for r in mine], edges[:-1]) and np.allclose([r.upper for r in mine], edges[1:])


def test_histogram_of_an_empty_table(spark):
    assert figures.histogram(spark.createDataFrame([], "g string, v double"), "v", ["g"]).count() == 0


def importance(rows, forest):
    """A loop: each node gets the rows that reach it."""
    total = {}
    for tree in forest:
        found = {}

        def gain(node, reached, found=found):
            y = np.array([r[2] for r in reached])
            spread = float(((y - y.mean()) ** 2).sum()) if len(y) else 0.0
            if isinstance(node, tuple):
                at = "xy".index(node[0])
                left, right = ([r for r in reached if (r[at] <= node[1]) == side] for side in (True, False))
                below = gain(node[2], left) + gain(node[3], right)
                found[node[0]] = found.get(node[0], 0) + spread - below
            return spread

        gain(tree, rows)
        for f, g in found.items():
            total[f] = total.get(f, 0) + g / sum(found.values()) / len(forest)
    return total


def test_importances_against_a_loop(spark):
    rng = random.Random(7)
    rows = [(float(rng.randrange(10)), float(rng.randrange(2)), float(rng.randrange(50))) for _ in range(200)]
    df = spark.createDataFrame([*rows, (None, 1.0, 9.0), (1.0, 1.0, None)], "x double, y double, target double")
    got = {r.feature: r.importance for r in figures.importances(df, FOREST).collect()}
    want = importance(rows, FOREST)
    assert set(got) == set(want) and all(abs(got[f] - want[f]) < 1e-9 for f in want) and abs(sum(got.values()) - 1) < 1e-9


def test_importances_without_spread_or_rows(spark):
    flat = spark.createDataFrame([(1.0, 0.0, 5.0)] * 3, "x double, y double, target double")
    for df in (flat, flat.filter("x > 9")):
        assert {r.feature: r.importance or 0.0 for r in figures.importances(df, FOREST).collect()} == {"x": 0.0, "y": 0.0}


def test_ledger_and_markdown(spark):
    df = spark.createDataFrame([(1, 60.0, 0.2), (2, 40.0, None)], "origin int, share double, p double")
    out = figures.ledger(df, ["origin"], {"most": ("share", F.col("share") > 50), "sure": ("p", F.col("p") < 0.05)})
    assert {(r.origin, r.claim): r.status for r in out.collect()} == {(1, "most"): "match", (1, "sure"): "mismatch", (2, "most"): "mismatch", (2, "sure"): "cannot be verified"}
    text = artefacts.markdown(spark.createDataFrame([("b|c", None), ("a", 2)], "k string, v int"), ["k"], "T")
    assert text.splitlines() == ["# T", "", "| k | v |", "|---|---|", "| a | 2 |", "| b\\|c |  |"]


def test_checksums_by_blocks(spark, tmp_path):
    """Long files in small blocks: the last block is short, full or missing; compressed files are hashed as stored."""
    folder = tmp_path / "my data"
    (folder / "sub").mkdir(parents=True)
    files = {"empty.bin": b"", "short.bin": b"abc", "even.bin": bytes(range(256)) * 4, "odd.bin": b"z" * 1025, "sub/x.csv.gz": gzip.compress(random.Random(1).randbytes(3000))}
    for name, content in files.items():
        (folder / name).write_bytes(content)
    (folder / "manifest.sha256.json").write_text("{}")
    want = {name: hashlib.sha256(content).hexdigest() for name, content in files.items()}
    for whole, block in ((64 << 20, 1 << 20), (100, 256), (0, 7)):
        assert {r.path: r.sha256 for r in artefacts.checksums(spark, str(folder), whole=whole, block=block).collect()} == want
    one = artefacts.checksums(spark, str(folder / "odd.bin"), whole=10).collect()
    assert [(r.path, r.sha256) for r in one] == [("odd.bin", want["odd.bin"])]


def test_run_stops_before_changed_inputs(spark, tmp_path):
    data = tmp_path / "panel.csv"
    data.write_text("item_id,store_id,day,demand,sell_price\na,b,1,2,3\n")
    expected = tmp_path / "expected.json"
    expected.write_text(json.dumps({"panel.csv": "0" * 64}))
    assert main(["regenerate", "--data", str(data), "--out", str(tmp_path / "out"), "--expect", str(expected)]) == 1
    assert not (tmp_path / "out").exists()
    expected.write_text(json.dumps({"panel.csv": hashlib.sha256(data.read_bytes()).hexdigest()}))
    artefacts.gate(artefacts.stored_checksums(spark, str(expected)), artefacts.checksums(spark, str(data)))


def test_kept_tables_are_in_folders_of_their_own(spark):
    a, b = shared.place(spark), shared.place(spark)
    assert a != b and not artefacts.exists(spark, a)
    kept = shared.keep(spark.range(3))
    assert kept.count() == 3 and artefacts.exists(spark, kept.lullcast_path)


def test_one_per_key_takes_the_first(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, None)], "k string, at int, v string")
    assert sorted(tuple(r) for r in retail.one_per_key(df, ["k"], "at").collect()) == [("a", 1, "y"), ("b", 5, None)]
    with pytest.raises(ValueError):
        retail.require_unique(df, ["k"])


def test_more_buckets_of_values_give_the_same_places(spark, monkeypatch):
    """Buckets grow with the rows; ties, a large group and one with a single value keep their places."""
    rng = random.Random(3)
    rows = [("a", float(rng.randrange(40_000))) for _ in range(6_000)] + [("b", 7.0)] * 50 + [("c", float(v)) for v in range(5)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {}
    for g in "abc":
        vs = sorted(v for k, v in rows if k == g)
        want |= {(g, v): (vs.index(v), len(vs)) for v in set(vs)}
    for least, most in ((100_000, 64), (10, 300), (1, 1024)):
        monkeypatch.setattr(ranks, "ROWS", least)
        placed = ranks.counted_below(ranks.value_counts(df, "v", ["g"]), "v", ["g"]).collect()
        assert {(r.g, r.v): (r._below, r._m) for r in placed} == want
        assert most / 3 < len({r._bucket for r in placed}) <= 1024
