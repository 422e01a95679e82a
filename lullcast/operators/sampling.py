"""Stratified samples: exact quartiles, two allocation rules, picks in hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import global_row_number, quartile

SEED = 42


def hash_order(seed: int = SEED, key: str = "sku_id") -> Column:
    return F.md5(F.concat(F.lit(str(seed)), F.col(key)))


def with_strata(population: DataFrame) -> DataFrame:
    """Adds ``adi_q``, ``cv2_q`` (quartiles by rank, ties by key) and ``stratum``."""
    total = F.broadcast(population.agg(F.count("*").alias("_n")))  # one row
    df = global_row_number(population, "adi", "sku_id", "adi_rank")
    df = global_row_number(df, "cv2", "sku_id", "cv2_rank").crossJoin(total)
    df = df.withColumns({"adi_q": quartile(F.col("adi_rank"), F.col("_n")), "cv2_q": quartile(F.col("cv2_rank"), F.col("_n"))})
    return df.withColumn("stratum", F.concat_ws("-", "adi_q", "cv2_q", "cat_id", "state_id")).drop("_n", "adi_rank", "cv2_rank")


def allocate(strata: DataFrame, n: int, rule: str = "minimum") -> DataFrame:
    """``stratum, available, take``.

    ``minimum``: half-even rounded share, one at least.  ``remainder``: floors, then one
    more for the largest remainders (ties by name) until n are given.
    """
    sizes = strata.groupBy("stratum").agg(F.count("*").alias("available"))
    whole = F.broadcast(sizes.agg(F.sum("available").alias("_all")))  # one row
    df = sizes.crossJoin(whole).withColumn("share", F.lit(float(n)) * F.col("available") / F.col("_all"))
    if rule == "minimum":
        take = F.least("available", F.greatest(F.lit(1), F.bround("share", 0).cast("long")))
        return df.select("stratum", "available", take.alias("take"))
    part = F.floor("share")
    df = df.withColumns({"low": part, "frac": F.col("share") - part})
    # strata are few: four by four quartiles times categories and states
    df = df.withColumns({"place": F.row_number().over(W.orderBy(F.desc("frac"), "stratum")), "rest": F.lit(n) - F.sum("low").over(W.partitionBy())})
    take = F.least("available", F.col("low") + F.when(F.col("place") <= F.col("rest"), 1).otherwise(0))
    return df.select("stratum", "available", take.cast("long").alias("take"))


def stratified(strata: DataFrame, n: int, rule: str = "minimum", seed: int = SEED) -> DataFrame:
    """The allocated number of each stratum in hash order; under ``minimum`` cut to n by (adi_q, cv2_q, key).  An empty population is an error."""
    if strata.isEmpty():
        raise ValueError("nothing to sample from")
    # the allocation has one row for each stratum
    placed = strata.withColumn("_place", F.row_number().over(W.partitionBy("stratum").orderBy(hash_order(seed), "sku_id")))
    picked = placed.join(F.broadcast(allocate(strata, n, rule)), "stratum").filter("_place <= take").drop("_place", "available", "take")
    return picked.orderBy("adi_q", "cv2_q", "sku_id").limit(n) if rule == "minimum" else picked


def simple(population: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    return population.orderBy(hash_order(seed), "sku_id").limit(n)


def marked(df: DataFrame, members: DataFrame, key: str = "sku_id", name: str = "sampled") -> DataFrame:
    """Adds whether the row's key is among ``members``."""
    return df.join(members.select(key).distinct().withColumn(name, F.lit(True)), key, "left").withColumn(name, F.coalesce(name, F.lit(False)))
