"""Sinks with fixed rounding and order, checksums, manifests, prediction files and artefact audits."""

from __future__ import annotations

import hashlib
import json
from urllib.parse import quote, unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6
#: Rows at most of what becomes one text on the driver.
MOST = 100_000
#: Bytes of a file that is hashed as one value at most, and of a block of longer ones.
WHOLE, BLOCK = 64 << 20, 1 << 20


def few(df: DataFrame) -> list:
    """The rows of a report; a table too long for one is an error, not a full driver."""
    rows = df.limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rows for one text")
    return rows


def here(df: DataFrame) -> DataFrame:
    """A report's rows as a table of their own: corrections over it read it several times."""
    return df.sparkSession.createDataFrame(few(df), df.schema)


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in df.dtypes))


def write_csv(df: DataFrame, path: str, order: list[str], digits: int = DIGITS, compress: bool = False) -> None:
    """Files whose names and rows are in a fixed order; small tables are one file."""
    rounded(df, digits).orderBy(*order).write.mode("overwrite").option("header", True).option("compression", "gzip" if compress else "none").csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def summary_json(df: DataFrame, keys: list[str]) -> str:
    """A small result table as JSON with sorted keys."""
    return json.dumps([r.asDict(True) for r in few(df.orderBy(*keys))], sort_keys=True, default=str, indent=2)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, on whatever file system the path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def remove(spark: SparkSession, path: str) -> None:
    """One file, if it is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, False)


def read_text(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]


def _open(path: str):
    """A stream of a file's stored bytes, in a task, on the file system that the path names."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem().open_input_stream("/" + path.removeprefix("file:").lstrip("/"), compression=None)
    system, inner = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return system.open_input_stream(inner, compression=None)


def _by_blocks(block: int):
    """Digests of files that are read block by block: a task holds one block."""

    def run(batches):
        for batch in batches:
            found = []
            for path in batch["path"]:
                digest = hashlib.sha256()
                with _open(path) as stream:
                    while piece := stream.read(block):
                        digest.update(piece)
                found.append(digest.hexdigest())
            yield batch[["path"]].assign(sha256=found)

    return run


def _plain(path: str) -> Column:
    return F.regexp_replace(path, "^file:/+", "/").alias("path")


def checksums(spark: SparkSession, folder: str, skip: tuple[str, ...] = ("manifest.sha256.json",), whole: int = WHOLE, block: int = BLOCK) -> DataFrame:
    """``path, sha256`` of every file below ``folder`` (or of one file), without those named in ``skip``.

    Files of at most ``whole`` bytes are hashed as one value.  Longer ones, of any length, are
    read in blocks of ``block`` bytes by tasks, each file by one, through Arrow's file systems.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    short = files.filter(F.col("length") <= whole).select("path", F.sha2("content", 256).alias("sha256"))
    long = files.filter(F.col("length") > whole).select("path").repartition("path").mapInPandas(_by_blocks(block), "path string, sha256 string")
    # the scan passes over empty files, so paths come from Spark's own listing
    listed = spark.createDataFrame([(unquote(p),) for p in files.inputFiles()], "path string").select(_plain("path"))
    if skip:
        listed = listed.filter(~F.element_at(F.split("path", "/"), -1).isin(*skip))
    found = listed.join(short.unionByName(long).select(_plain("path"), "sha256"), "path", "left")
    base = "/" + folder.rstrip("/").removeprefix("file:").lstrip("/") if folder.startswith(("file:", "/")) else folder.rstrip("/")
    path = F.col("path")
    inside = F.when(F.startswith(path, F.lit(base + "/")), F.substring(path, F.lit(len(base) + 2), F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))
    return found.select(inside.alias("path"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("sha256"))


def manifest(spark: SparkSession, folder: str) -> str:
    """The checksums of an artefact folder as JSON; it has one row for each artefact."""
    return json.dumps({r.path: r.sha256 for r in few(checksums(spark, folder))}, sort_keys=True, indent=2)


def compare_manifests(stored: DataFrame, found: DataFrame) -> DataFrame:
    """One row: lists of changed, missing and new paths, how many are equal, and whether all stored ones are (new ones don't matter)."""
    both = stored.withColumnRenamed("sha256", "a").join(found.withColumnRenamed("sha256", "b"), "path", "full")
    pick = lambda cond: F.sort_array(F.collect_list(F.when(F.expr(cond), F.col("path"))))
    out = both.agg(pick("a <> b").alias("changed"), pick("b is null").alias("missing"), pick("a is null").alias("new"), F.count_if(F.expr("a = b")).alias("identical"))
    return out.withColumn("valid", (F.size("changed") == 0) & (F.size("missing") == 0))


def manifest_status(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``path, status`` for every path of either manifest: identical, changed, missing or new."""
    both = stored.withColumnRenamed("sha256", "a").join(found.withColumnRenamed("sha256", "b"), "path", "full")
    return both.select("path", F.expr("case when b is null then 'missing' when a is null then 'new' when a = b then 'identical' else 'changed' end").alias("status"))


def stored_checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256`` of a manifest that ``manifest`` made."""
    found = json.loads(read_text(spark, path))
    return spark.createDataFrame(sorted(found.items()), "path string, sha256 string")


class Changed(ValueError):
    """Stored checksums that are not found again."""


def gate(stored: DataFrame, found: DataFrame) -> None:
    """Raises unless every stored checksum is found again."""
    bad = manifest_status(stored, found).filter("status in ('missing', 'changed')").orderBy("path").limit(20).collect()
    if bad:
        raise Changed("inputs differ: " + ", ".join(f"{r.path} ({r.status})" for r in bad))


#: File names of stored forecasts; the model's own name may hold "_o".
PREDICTION_NAME = r"^pred_(.+?)(?:_h(\d+))?_o(\d+)_s(\d+)\.csv(?:\.gz)?$"


def prediction_keys(files: DataFrame, column: str = "file_name") -> DataFrame:
    """Adds ``model, horizon, origin, seed`` parsed from a file name; null where it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(column, PREDICTION_NAME, i), F.lit(""))
    return files.withColumns({"model": part(1), "horizon": part(2).cast("int"), "origin": part(3).cast("int"), "seed": part(4).cast("int")})


def read_predictions(spark: SparkSession, glob: str, models: tuple[str, ...] = ()) -> DataFrame:
    """All stored forecasts that a glob finds; a model outside ``models`` is an error when its rows are read."""
    df = spark.read.option("header", True).schema("sku_id string, day int, split string, pred_sum double").csv(glob).withColumn("file_name", F.col("_metadata.file_name"))
    df = prediction_keys(df)
    if models:
        df = df.filter(F.when(F.col("model").isin(*models), True).otherwise(F.raise_error(F.concat(F.lit("unknown model: "), F.coalesce("model", "file_name")))))
    return df


def markdown(df: DataFrame, order: list[str], title: str) -> str:
    """A bounded report table; a value's bars and line ends don't break it."""
    shown = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(map(shown, row))} |" for row in few(df.orderBy(*order))]
    return "\n".join([f"# {title}", "", f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns), *lines]) + "\n"


def base_model(name: str) -> Column:
    """``rf#s42`` -> ``rf``."""
    return F.substring_index(name, "#", 1)


def resolve_model(df: DataFrame, wanted: str, column: str = "model") -> DataFrame:
    """The first full model name for a base name: one row."""
    return df.filter(base_model(column) == wanted).agg(F.min(column).alias("model"))


def audit(spark: SparkSession, required: dict[str, tuple[int, tuple[str, ...]]], tables: dict[str, DataFrame]) -> DataFrame:
    """For each required artefact: is it there, does it have enough rows, and which columns are missing."""
    rows = []
    for name, (least, columns) in required.items():
        df = tables.get(name)
        n = None if df is None else df.count()
        missing = [c for c in columns if df is None or c not in df.columns]
        rows.append((name, df is not None, n, missing, df is not None and n >= least and not missing))
    kind = T.StructType([T.StructField("artefact", T.StringType()), T.StructField("present", T.BooleanType()), T.StructField("n_rows", T.LongType()), T.StructField("missing_columns", T.ArrayType(T.StringType())), T.StructField("ok", T.BooleanType())])
    return spark.createDataFrame(rows, kind)


def merge_run_logs(lines: DataFrame) -> DataFrame:
    """Blocks of log text by name: the last writer's text, in the order in which the names first came.

    ``lines`` has ``seq`` and ``text``; a block starts with ``## name``.
    """
    from pyspark.sql import Window as W

    name = F.nullif(F.regexp_extract("text", r"^## (.+)$", 1), F.lit(""))
    # one log is one ordered sequence of lines
    marked = lines.withColumn("name", F.last(name, True).over(W.orderBy("seq"))).filter("name is not null").withColumn("start", F.max(F.when(name.isNotNull(), F.col("seq"))).over(W.orderBy("seq")))
    blocks = marked.groupBy("name", "start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return blocks.groupBy("name").agg(F.min("start").alias("first_seen"), F.max_by("text", "start").alias("text")).orderBy("first_seen")
