"""Tables between the steps of a query, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where it is unset, as in tests, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return found or "file://" + tempfile.mkdtemp(prefix="lullcast-")


def place(spark: SparkSession, kind: str = "kept") -> str:
    """A new path in that folder; what is written there goes when the session ends."""
    where = f"{folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)  # only of what exists
    return f"{where}/rows"


def keep(df: DataFrame) -> DataFrame:
    """The same rows, read from a written table, which goes when the session ends: nothing of what made them runs again, a lost executor included."""
    spark = df.sparkSession
    where = place(spark)
    df.write.parquet(where)
    out = spark.read.schema(df.schema).parquet(where)
    out.lullcast_path = where
    return out
