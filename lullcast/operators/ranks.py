"""Ranks and exact quantiles over large groups without one task that holds a group."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Buckets of values at least.
BUCKETS = 64
#: Rows of a bucket, about, and buckets at most.
ROWS, MOST = 100_000, 1024
#: Cuts of a block of them: a value is held against each block's last cut, then against one block.
BLOCK = 32
#: Keys that are read on the driver to cut the buckets, about.
KEYS = 8_192


def _same(left: str, right: str, columns: list[str]) -> Column:
    return reduce(and_, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def value_counts(rows: DataFrame, value: str, by: list[str], *conditions: Column) -> DataFrame:
    """The distinct values of each group with ``_n``, an array of how many rows meet each condition (without any: how many rows).

    Everything below starts from such a table and uses all of its columns, so that Spark
    makes it once and shares the exchange.
    """
    return rows.groupBy(*by, value).agg(F.array(*(F.count_if(c) for c in conditions or (F.lit(True),))).alias("_n"))


def size() -> Column:
    return F.aggregate("_n", F.lit(0).cast("long"), lambda a, n: a + n)


def _cuts(values: DataFrame, value: str) -> DataFrame:
    """One row: the distinct cuts in order, and every block's last one."""
    known = F.when(size() > 0, F.col(value))
    found = values.agg(F.count(known).alias("_rows"), F.percentile_approx(known, [i / MOST for i in range(1, MOST)], 4 * MOST).alias("_all"))
    wanted = F.least(F.greatest(F.ceil(F.col("_rows") / ROWS), F.lit(BUCKETS)), F.lit(MOST))
    step = F.floor(MOST / wanted).cast("int")
    picked = found.select(F.array_distinct(F.filter("_all", lambda c, i: (i + 1) % step == 0)).alias("_cuts"))
    return picked.withColumn("_last", F.filter("_cuts", lambda c, i: i % BLOCK == BLOCK - 1))


def _bucket(value: Column) -> Column:
    """How many cuts are smaller."""
    whole = F.size(F.filter("_last", lambda c: c < value)) * BLOCK
    return whole + F.size(F.filter(F.slice("_cuts", whole + 1, BLOCK), lambda c: c < value))


def counted_below(values: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """Adds ``_below`` and ``_m`` to ``value_counts``: how many rows of the group are smaller, and all of them.

    Values are bucketed between approximate quantiles, which are part of the plan; a value's
    number is its number in its bucket plus the sizes of the group's buckets before.  Buckets
    grow in number with the rows of ``values``, up to ``MOST``.  ``_bucket`` stays, in the order of values.
    """
    cuts = F.broadcast(_cuts(values, value))  # one row
    marked = values.crossJoin(cuts).withColumn("_bucket", _bucket(F.col(value))).drop("_cuts", "_last")
    across = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    inside = W.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    sizes = marked.groupBy(*keys, "_bucket").agg(F.sum(size()).alias("_size"))
    sizes = sizes.withColumns({"_before": F.coalesce(F.sum("_size").over(across), F.lit(0)), "_m": F.sum("_size").over(W.partitionBy(*keys))})
    placed = marked.withColumn("_own", F.coalesce(F.sum(size()).over(inside), F.lit(0)))
    joined = placed.alias("l").join(sizes.alias("r"), _same("l", "r", [*keys, "_bucket"])).select("l.*", "r._before", "r._m")
    return joined.withColumn("_below", F.col("_before") + F.col("_own")).drop("_before", "_own")


def average_rank() -> Column:
    """The rank of a value of ``counted_below``, ties at the mean of their places."""
    return F.col("_below") + (size() + 1) / 2.0


def quantiles_of(placed: DataFrame, value: str, by: list[str], shares: tuple[float, ...], name: str = "q") -> DataFrame:
    """``by``, and the array of quantiles with linear interpolation, from ``counted_below``."""
    columns, parts = [], []
    for i, share in enumerate(shares):
        at = F.lit(float(share)) * (F.col("_m") - 1)
        for side, place in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            columns.append(F.max(F.when(F.col("_below") <= place, F.col(value))).alias(f"_{side}{i}"))
        columns.append(F.max(at - F.floor(at)).alias(f"_w{i}"))
        parts.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_w{i}"))
    return placed.groupBy(*by).agg(*columns).select(*by, F.array(*parts).alias(name))


def exact_quantiles(rows: DataFrame, value: str, by: list[str], shares: tuple[float, ...], name: str = "q") -> DataFrame:
    """Quantiles with nulls left out; equal to an exact percentile, but no task holds a group's values."""
    counts = value_counts(rows.filter(F.col(value).isNotNull()), value, by)
    return quantiles_of(counted_below(counts, value, by), value, by, shares, name)


def medians(rows: DataFrame, columns: list[str], by: list[str], prefix: str = "") -> DataFrame:
    """``by`` and each column's median, nulls left out; all columns go through one count, and no task holds a group's values."""
    long = rows.unpivot(by, columns, "_column", "_value")
    found = exact_quantiles(long, "_value", [*by, "_column"], (0.5,))
    return found.groupBy(*by).pivot("_column", columns).agg(F.first(F.col("q")[0])).select(*by, *(F.col(c).alias(prefix + c) for c in columns))


def global_row_number(df: DataFrame, value: str, tie: str, name: str) -> DataFrame:
    """1-based position in the order of (value, tie), nulls last.

    Rows are bucketed between keys (value, tie) of a bounded sample in hash order, so that
    equal values don't share a task either; a row's number is its number in its bucket plus
    the sizes of the buckets before.  Buckets grow in number with the table, up to ``MOST``.
    """
    key = F.struct(F.col(value).isNull().cast("int").alias("a"), F.coalesce(F.col(value), F.lit(0).cast(df.schema[value].dataType)).alias("b"), F.col(tie).alias("c"))
    total = df.count()
    buckets = min(MOST, -(-total // ROWS))
    if buckets <= 1:
        return df.withColumn(name, F.row_number().over(W.orderBy(F.col(value).asc_nulls_last(), tie)).cast("long"))  # at most ROWS rows
    seen = df.select(key.alias("k")).filter(F.pmod(F.xxhash64("k"), F.lit(max(1, total // KEYS))) == 0).limit(4 * KEYS).orderBy("k").collect()
    picked = [seen[len(seen) * i // buckets].k for i in range(1, buckets)] if seen else []
    kinds = key_types(df, value, tie)
    cuts = F.array(*(F.struct(F.lit(k.a).alias("a"), F.lit(k.b).cast(kinds[0]).alias("b"), F.lit(k.c).cast(kinds[1]).alias("c")) for k in sorted(set(picked), key=lambda k: (k.a, k.b, k.c))))
    marked = df.withColumn("_bucket", F.size(F.filter(cuts, lambda c: c < key)) if picked else F.lit(0))
    sizes = sorted((r["_bucket"], r["count"]) for r in marked.groupBy("_bucket").count().collect())
    before, so_far = [], 0
    for b, n in sizes:
        before.append((b, so_far))
        so_far += n
    offsets = F.broadcast(df.sparkSession.createDataFrame(before, "_bucket int, _offset long"))  # a row for each bucket
    own = F.row_number().over(W.partitionBy("_bucket").orderBy(F.col(value).asc_nulls_last(), tie))
    return marked.withColumn("_own", own).join(offsets, "_bucket").withColumn(name, F.col("_own") + F.col("_offset")).drop("_bucket", "_own", "_offset")


def key_types(df: DataFrame, *columns: str) -> list[str]:
    return [df.schema[c].dataType.simpleString() for c in columns]


def quartile(position: Column, n: Column) -> Column:
    """Quartile 0..3 of a 1-based position among n, with edges at 1+(n-1)k/4, right-closed."""
    edge = lambda k: 1 + (n - 1) * k / 4.0
    return F.when(position <= edge(1), 0).when(position <= edge(2), 1).when(position <= edge(3), 2).otherwise(3)


def value_quartiles(df: DataFrame, value: str, by: list[str], name: str = "quartile") -> DataFrame:
    """Adds the quartile of ``value`` between its group's exact quartile values, right-closed; equal edges are one, so there may be fewer classes.  Null values have none."""
    edges = exact_quantiles(df, value, by, (0.0, 0.25, 0.5, 0.75, 1.0), "_q")
    both = df.alias("l").join(edges.alias("r"), _same("l", "r", by), "left").select("l.*", "r._q") if by else df.join(F.broadcast(edges), how="left")  # one row
    inner = F.filter(F.array_distinct("_q"), lambda q: (q > F.col("_q")[0]) & (q < F.col("_q")[4]) & (q < F.col(value)))
    return both.withColumn(name, F.when(F.col(value).isNotNull(), F.size(inner))).drop("_q")
