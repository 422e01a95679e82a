"""Session settings for panel queries."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str | None = None, shuffle_partitions: int | None = None, **more: str) -> SparkSession:
    """A session; on a cluster the master and the number of shuffle partitions come from the submit command."""
    builder = SparkSession.builder.appName("lullcast")
    if master:
        builder = builder.master(master)
    settings = SETTINGS | ({"spark.sql.shuffle.partitions": str(shuffle_partitions)} if shuffle_partitions else {}) | more
    return builder.config(map=settings).getOrCreate()
