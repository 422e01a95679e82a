"""A whole run: panel to tests, written as artefacts with a manifest; and its verification and sweeps."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions.dist import normal_upper
from ..operators import accuracy, classify, features, forecast, ml, origins, policy, ranks, sampling, stats
from ..operators.panel import active
from ..sources import artefacts
from ..sources.shared import keep

#: The forest over all series against a rate for each series.
MODELS = ("rf", "croston_sba")


def population(panel: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Classes of all series, and the stratified sample of the lumpy ones."""
    stat = classify.classified(active(panel), cfg.classify.adi_min, cfg.classify.cv2_min, cfg.classify.min_nonzero)
    meta = panel.groupBy("sku_id").agg(F.min("cat_id").alias("cat_id"), F.min("state_id").alias("state_id"))
    lumpy = stat.filter("lumpy").join(meta, "sku_id")
    return stat, sampling.stratified(sampling.with_strata(lumpy), cfg.sample.size, cfg.sample.rule, cfg.sample.seed)


def forecasts(panel: DataFrame, sample: DataFrame, cfg: Config, models: tuple[str, ...] = MODELS) -> DataFrame:
    """``sku_id, day, model, origin, split, demand, actual, pred_sum`` on validation and test days.

    A forest is fitted twice for each origin: for validation days on what was known at the
    end of training, for test days on what was known at the end of validation.  Days whose
    target reaches beyond that are left out of a fit.
    """
    horizon = cfg.policy.review + cfg.policy.lead
    rows = panel.join(F.broadcast(sample.select("sku_id")), "sku_id", "left_semi").withColumn("actual", features.ahead(F.col("demand"), horizon))  # sample.size keys
    windows = origins.rolling_origins(panel, cfg.origins.count, cfg.origins.val_days, cfg.origins.test_days)
    columns = ["sku_id", "day", "model", "origin", "split", "demand", "actual", "pred_sum"]
    rates = tuple(m for m in models if m != "rf")
    parts = [origins.split_days(forecast.forecasts(rows, rates, horizon), windows).select(*columns)] if rates else []
    if "rf" in models:
        matrix = keep(features.matrix(rows, horizon))  # every fit and prediction reads it
        for o in windows.collect():  # a row for each origin
            for split, until, last in (("val", o.train_end, o.val_end), ("test", o.val_end, o.test_end)):
                found = ml.predict(ml.fit(matrix, until - horizon), matrix, until + 1, last).select("sku_id", "day", "pred_sum")
                parts.append(found.join(rows.select("sku_id", "day", "demand", "actual"), ["sku_id", "day"]).withColumns({"model": F.lit("rf"), "origin": F.lit(o.origin), "split": F.lit(split)}).select(*columns))
    return reduce(DataFrame.unionByName, parts)


def results(panel: DataFrame, stored: DataFrame, cfg: Config, models: tuple[str, str] = MODELS) -> dict[str, DataFrame]:
    """Accuracy, costs, costs at equal service and both tests, from stored forecasts."""
    horizon = cfg.policy.review + cfg.policy.lead
    windows = origins.rolling_origins(panel, cfg.origins.count, cfg.origins.val_days, cfg.origins.test_days)
    known = stored.select("sku_id").distinct()
    scale = accuracy.naive_scale(panel.join(known, "sku_id", "left_semi"), windows, horizon)
    err = stored.filter("split = 'val' and actual is not null").withColumn("err", F.col("actual") - F.col("pred_sum"))
    ss = policy.quantiles(err, ["model", "origin", "sku_id"], cfg.policy.taus)
    levels = stored.filter("split = 'test'").join(ss, ["sku_id", "model", "origin"]).select("sku_id", "model", "origin", "tau", "day", "demand", F.greatest(F.col("pred_sum") + F.col("ss"), F.lit(0.0)).alias("level"))
    trace = policy.simulate_net(levels, review=cfg.policy.review, lead=cfg.policy.lead, rounding=cfg.policy.rounding, moq=cfg.policy.moq, start=cfg.policy.start)
    costs = policy.with_costs(policy.summarise(trace, warmup=cfg.policy.warmup, horizon=horizon), cfg.policy.scenarios)
    return {"accuracy": accuracy.metrics(stored, scale, daily=True), "costs": costs, "equalised": policy.at_equal_service(costs, cfg.policy.targets)}


def tests(equal: DataFrame, cfg: Config, models: tuple[str, str] = MODELS) -> dict[str, DataFrame]:
    """H1: is the first model cheaper at the middle target; H2: does the relative difference rise with the target."""
    a, b = models
    paired = equal.groupBy("sku_id", "origin", "cs", "fill_target").pivot("model", [a, b]).agg(F.first("cost_at_target")).na.drop().filter(F.col(b) != 0)
    relative = paired.withColumn("rel", (F.col(a) - F.col(b)) / F.col(b)).filter(F.col("cs") == cfg.policy.scenarios[0][0])
    targets = list(cfg.policy.targets)
    h1 = stats.wilcoxon(relative.filter(F.col("fill_target") == targets[min(1, len(targets) - 1)]), ["origin"], "rel", least=5)
    h1 = stats.holm(artefacts.here(h1.withColumn("p", normal_upper(-F.col("z"))))).withColumn("supported", F.coalesce(F.col("p_holm") < 0.05, F.lit(False)))
    names = [f"t{i}" for i in range(len(targets))]
    trend = relative.groupBy("sku_id", "origin").pivot("fill_target", targets).agg(F.first("rel")).toDF("sku_id", "origin", *names).na.drop()
    trend = keep(trend)
    medians = ranks.medians(trend, names, ["origin"], "median_")
    rising = reduce(lambda x, y: x & y, [F.col(f"median_{u}") < F.col(f"median_{v}") for u, v in zip(names, names[1:], strict=False)], F.lit(True))
    contrast = stats.wilcoxon(trend.withColumn("delta", F.col(names[-1]) - F.col(names[0])), ["origin"], "delta", least=5).select("origin", F.col("median_diff").alias("median_delta"), normal_upper("z").alias("p_contrast"))
    h2 = stats.page(trend, names, ["origin"]).withColumn("p_page", normal_upper("page_z")).join(contrast, "origin").join(medians, "origin").withColumn("rising", rising)
    h2 = stats.holm(artefacts.here(stats.holm(artefacts.here(h2), "p_page", name="p_page_holm")), "p_contrast", name="p_contrast_holm")
    return {"h1": h1, "h2": h2.withColumn("supported", F.coalesce((F.col("p_page_holm") < 0.05) & F.col("rising"), F.lit(False)))}


def _digest(df: DataFrame) -> str:
    """Number of rows and an order-free digest: sums of the four quarters of the rows' SHA-256."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns))), 256)
    quarters = [F.sum(F.conv(F.substring(row, 1 + 16 * k, 15), 16, 10).cast("decimal(38,0)")).alias(f"q{k}") for k in range(4)]
    d = df.agg(F.count("*").alias("n"), *quarters).first()
    return ":".join(str(x) for x in d)


def regenerate(spark: SparkSession, panel: DataFrame, cfg: Config, out: str, models: tuple[str, str] = MODELS, resume: bool = False) -> dict[str, str]:
    """Writes every table, the summary and the manifest of the rows' digests; equal inputs and settings give an equal manifest.

    Each table is made from the stored ones before it, so nothing is simulated or fitted twice.
    A table is committed by a marker with its digest and the key of the run's inputs and
    settings; under ``resume`` committed tables of the same key are read instead of made.
    """
    found: dict[str, str] = {}
    key = hashlib.sha256(json.dumps([_digest(panel), repr(cfg), list(models)]).encode()).hexdigest()

    def keep(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        marker = f"{out}/{name}.done"
        done = json.loads(artefacts.read_text(spark, marker)) if resume and artefacts.exists(spark, marker) else {}
        if done.get("key") != key:
            artefacts.remove(spark, marker)  # a table that is being replaced is not committed
            artefacts.rounded(make(), cfg.round_digits).write.mode("overwrite").parquet(f"{out}/{name}")
            done = {"key": key, "digest": _digest(spark.read.parquet(f"{out}/{name}"))}
            artefacts.write_text(spark, marker, json.dumps(done, sort_keys=True))
        found[name] = done["digest"]
        return spark.read.parquet(f"{out}/{name}")

    keep("series_stats", lambda: population(panel, cfg)[0])
    sample = keep("sample", lambda: population(panel, cfg)[1])
    stored = keep("forecasts", lambda: forecasts(panel, sample, cfg, models))
    keep("accuracy", lambda: results(panel, stored, cfg, models)["accuracy"])
    costs = keep("costs", lambda: results(panel, stored, cfg, models)["costs"])
    equal = keep("equalised", lambda: policy.at_equal_service(costs, cfg.policy.targets))
    made: dict[str, DataFrame] = {}

    def test(name: str) -> DataFrame:
        if not made:
            made.update(tests(equal, cfg, models))
        return made[name]

    shown = {name: [r.asDict() for r in artefacts.few(keep(name, lambda n=name: test(n)).orderBy("origin"))] for name in ("h1", "h2")}
    least = {name: bool(rows) and all(r["supported"] for r in rows) for name, rows in shown.items()}
    artefacts.write_text(spark, f"{out}/summary.json", json.dumps({"models": list(models), **shown, "h1_supported": least["h1"], "h2_supported": least["h2"]}, sort_keys=True, default=str, indent=2))
    artefacts.write_text(spark, f"{out}/manifest.json", json.dumps(found, sort_keys=True, indent=2))
    return found


def verify(spark: SparkSession, panel: DataFrame, cfg: Config, stored: str, scratch: str, models: tuple[str, str] = MODELS) -> dict[str, list[str]]:
    """Runs again and compares with the stored manifest."""
    old = json.loads(artefacts.read_text(spark, f"{stored}/manifest.json"))
    new = regenerate(spark, panel, cfg, scratch, models)
    return {"changed": sorted(k for k in old if k in new and old[k] != new[k]), "missing": sorted(set(old) - set(new)), "new": sorted(set(new) - set(old))}


def sweep(spark: SparkSession, panel: DataFrame, cells: list[tuple[str, Config]]) -> DataFrame:
    """One row for each cell: smallest adjusted p, and the mean over origins of the median effects.

    Cells that differ in the policy alone share one table of forecasts.
    """
    out = None
    fitted: dict[tuple, DataFrame] = {}
    for name, cfg in cells:
        same = (cfg.classify, cfg.sample, cfg.origins, cfg.policy.review + cfg.policy.lead)
        if same not in fitted:
            fitted[same] = keep(forecasts(panel, population(panel, cfg)[1], cfg))
        equal = results(panel, fitted[same], cfg)["equalised"]
        row = tests(equal, cfg)["h1"].agg(F.min("p_holm").alias("min_p_holm"), F.avg("median_diff").alias("mean_of_medians"), F.max((F.col("p_holm") < 0.05).cast("int")).alias("supported")).withColumn("cell", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
