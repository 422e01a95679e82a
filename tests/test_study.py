"""A whole run on a small generated panel: forest against Croston, artefacts, verification, command line."""

from __future__ import annotations

import json

import pytest

from lullcast import __main__ as cli
from lullcast.config import Config
from lullcast.plans import study
from lullcast.sources import artefacts, synthetic

CFG = Config().override({"sample.size": 5, "origins": {"count": 1, "val_days": 20, "test_days": 20}, "policy": {"lead": 2, "warmup": 2, "taus": (0.5, 0.8, 0.95, 0.99), "targets": (0.8, 0.9, 0.95)}, "classify.cv2_min": 0.2})


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("panel") / "p")
    synthetic.synthetic_panel(spark, 24, 100).write.parquet(at)
    return spark.read.parquet(at)


def test_run_and_verification(spark, panel, tmp_path):
    first = study.regenerate(spark, panel, CFG, str(tmp_path / "a"))
    assert set(first) == {"series_stats", "sample", "forecasts", "accuracy", "costs", "equalised", "h1", "h2"}
    assert study.verify(spark, panel, CFG, str(tmp_path / "a"), str(tmp_path / "b")) == {"changed": [], "missing": [], "new": []}
    assert json.loads(artefacts.read_text(spark, str(tmp_path / "a" / "manifest.json"))) == first
    summary = json.loads(artefacts.read_text(spark, str(tmp_path / "a" / "summary.json")))
    assert summary["models"] == ["rf", "croston_sba"] and {"h1_supported", "h2_supported"} <= set(summary)
    rows = spark.read.parquet(str(tmp_path / "a" / "forecasts"))
    counts = {(r.model, r.split): r["count"] for r in rows.groupBy("model", "split").count().collect()}
    assert set(counts) == {(m, s) for m in study.MODELS for s in ("val", "test")}
    # a forest has no forecast on days without complete features
    assert all(0 < counts["rf", s] <= counts["croston_sba", s] for s in ("val", "test"))
    assert rows.groupBy("sku_id", "day", "model", "origin").count().filter("count > 1").isEmpty()
    mae = {r.model for r in spark.read.parquet(str(tmp_path / "a" / "accuracy")).filter("mae is not null and mae_core is not null").collect()}
    assert mae == set(study.MODELS)


def test_a_stopped_run_goes_on(spark, panel, tmp_path, monkeypatch):
    out = str(tmp_path / "run")
    with monkeypatch.context() as m:
        m.setattr(study, "tests", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            study.regenerate(spark, panel, CFG, out)
    assert not artefacts.exists(spark, f"{out}/manifest.json") and artefacts.exists(spark, f"{out}/forecasts.done")
    with monkeypatch.context() as m:
        m.setattr(study, "forecasts", lambda *a: (_ for _ in ()).throw(RuntimeError("fitted again")))
        found = study.regenerate(spark, panel, CFG, out, resume=True)
        assert study.regenerate(spark, panel, CFG, out, resume=True) == found
        # other settings are another run
        with pytest.raises(RuntimeError):
            study.regenerate(spark, panel, CFG.override({"sample.seed": 7}), out, resume=True)
    assert set(found) == {"series_stats", "sample", "forecasts", "accuracy", "costs", "equalised", "h1", "h2"}
    assert study.verify(spark, panel, CFG, out, str(tmp_path / "again"))["missing"] == []


def test_sweep_fits_once_for_each_forecast(spark, panel, monkeypatch):
    fits = []
    plain = study.forecasts
    monkeypatch.setattr(study, "forecasts", lambda *a: (fits.append(1), plain(*a, models=("naive", "croston_sba")))[1].replace("naive", "rf", ["model"]))
    rows = study.sweep(spark, panel, [("base", CFG), ("ceil", CFG.override({"policy.rounding": "ceil"})), ("late", CFG.override({"policy.lead": 3}))]).collect()
    assert sorted(r.cell for r in rows) == ["base", "ceil", "late"] and len(fits) == 2
    assert all(r.min_p_holm is None or 0 <= r.min_p_holm <= 1 for r in rows)


def test_exit_codes(spark, panel, tmp_path, monkeypatch):
    at = str(tmp_path / "data")
    panel.write.parquet(at)
    said = {"changed": [], "missing": [], "new": ["x"]}
    monkeypatch.setattr(cli, "session", lambda master: spark)
    monkeypatch.setattr(study, "verify", lambda *a: said)
    monkeypatch.setattr(study, "regenerate", lambda *a, **k: said.update(resumed=k["resume"]))
    assert cli.main(["regenerate", "--data", at, "--out", "o", "--resume"]) == 0 and said["resumed"]
    assert cli.main(["verify", "--data", at, "--out", "o"]) == 0
    said["changed"] = ["costs"]
    assert cli.main(["verify", "--data", at, "--out", "o"]) == 1


def test_command_line_needs_data():
    with pytest.raises(SystemExit):
        cli.main(["regenerate"])
