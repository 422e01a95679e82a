"""Intermediate tables in the folder that all executors share, and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset (tests) a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="lullcast-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of few rows and bytes, so that a Python worker never holds many long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


class Work:
    """Tables under one new folder, which goes when the session ends."""

    def __init__(self, spark: SparkSession):
        small_batches(spark)
        self.spark = spark
        self.at = f"{shared_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
        self.fs = self._path(self.at).getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(self._path(self.at))
        self.n = 0

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(name)

    def save(self, df: DataFrame) -> DataFrame:
        """The same rows, read from a table: nothing of what made them runs again."""
        self.n += 1
        where = f"{self.at}/{self.n}"
        df.write.parquet(where)
        out = self.spark.read.schema(df.schema).parquet(where)
        out.lullcast_path = where
        return out

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            self.fs.delete(self._path(t.lullcast_path), True)


def components(edges: DataFrame, work: Work) -> DataFrame:
    """``node, component`` for every node of ``edges (a, b)``: the smallest node that it is connected with.

    Each round hooks every node to its smallest neighbour, follows the pointers
    once, and contracts the edges; the number of nodes at least halves in a round.
    """
    edges = work.save(edges.select("a", "b").filter("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("up"))
        hook = work.save(hook)
        top = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
        hook2 = work.save(hook.join(top, "up", "left").select("node", F.coalesce("top", "up").alias("up")))
        work.drop(hook)
        left = edges.join(hook2.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(hook2.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        less = work.save(left.select(F.col("x").alias("a"), F.col("y").alias("b")).filter("a <> b").distinct())
        work.drop(edges)
        edges = less
        if labels is None:
            labels = hook2
        else:
            step = hook2.select(F.col("node").alias("up"), F.col("up").alias("next"))
            new = work.save(labels.join(step, "up", "left").select("node", F.coalesce("next", "up").alias("up")))
            work.drop(labels, hook2)
            labels = new
    work.drop(edges)
    if labels is None:
        return work.spark.createDataFrame([], "node bigint, component bigint")
    return labels.withColumnRenamed("up", "component")
