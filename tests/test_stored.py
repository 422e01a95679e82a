"""Queries over written files."""

from __future__ import annotations

from datetime import datetime

from lullcast.plans import QUERIES


def test_sinks_of_one_demand(spark, tmp_path):
    data = [(1, "view", datetime(2024, 1, d), v) for d, v in ((1, 2.0), (3, 4.0))] + [(2, "view", datetime(2024, 1, 2), 3.0)]
    spark.createDataFrame(data, "user_id long, event_type string, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.sku_id: r for r in QUERIES["statistics_sinks"](spark, str(tmp_path)).collect()}
    assert got["2__view"].cv2 is None and got["2__view"].same
    assert got["1__view"].cv2 == 0.222222
