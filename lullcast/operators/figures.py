"""Tables behind figures: histograms, paired costs, importances of a stored forest, a ledger of claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .claims import MATCH, MISMATCH, UNKNOWN
from .ml import number

#: Parts into which a group's rows are dealt to meet its extremes, so that one large group is no task.
PARTS = 32


def histogram(rows: DataFrame, value: str, by: list[str], bins: int = 25) -> DataFrame:
    """``by, bin, lower, upper, n``: counts in equal bins between each group's extremes, empty bins included.

    Bins hold their lower edge, the last one both.  A group with one distinct value has bins
    from 0.5 below to 0.5 above it; null values are left out, and so are groups without others.
    ``by`` has no nulls.
    """
    known = rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    ends = known.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.select(*by, F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")).alias("_lo"), F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi")).alias("_hi"))
    dealt = ends.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    width = F.col("_hi") - F.col("_lo")
    own = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / width * bins).cast("int"))
    placed = known.withColumn("_part", F.pmod(F.xxhash64("_v"), F.lit(PARTS)).cast("int")).join(dealt, [*by, "_part"])
    counts = placed.groupBy(*by, own.alias("bin")).agg(F.count("*").alias("n"))
    all_bins = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    edge = lambda k: F.col("_lo") + width * k / bins
    return all_bins.join(counts, [*by, "bin"], "left").select(*by, "bin", edge(F.col("bin")).alias("lower"), edge(F.col("bin") + 1).alias("upper"), F.coalesce("n", F.lit(0)).alias("n"))


def paired_costs(relative: DataFrame) -> DataFrame:
    """The points of a scatter: both models' costs of a series (``a``, ``b``), and whether the first is cheaper."""
    return relative.select("origin", "sku_id", F.col("a").alias("cost_a"), F.col("b").alias("cost_b"), (F.col("a") < F.col("b")).alias("cheaper"))


def impurity_parts(forest: list, target: str) -> tuple[dict[str, str], dict[str, str]]:
    """For a stored forest: the sums that each node needs, and each feature's importance over those sums, in the SQL of both engines.

    A split's gain is what it takes off the squared deviations of the rows that reach it; a
    tree's gains are shares of their sum, a feature's importance the mean of its shares over
    the trees.  A tree without any gain counts as nothing.
    """
    sums: dict[str, str] = {}
    gains: list[dict[str, list[str]]] = []

    def visit(node, reached: list[str], found: dict[str, list[str]]) -> str:
        i = len(sums) // 3
        on = " AND ".join(reached) or "TRUE"
        for name, what in (("n", "1.0e0"), ("s", f"{target}"), ("q", f"{target} * {target}")):
            sums[f"{name}{i}"] = f"sum(CASE WHEN {on} THEN {what} ELSE 0.0e0 END)"
        spread = f"(CASE WHEN n{i} > 0 THEN q{i} - s{i} * s{i} / n{i} ELSE 0.0e0 END)"
        if isinstance(node, tuple | list):
            feature, cut, left, right = node
            sides = [visit(side, [*reached, f"{feature} {sign} {number(cut)}"], found) for side, sign in ((left, "<="), (right, ">"))]
            found.setdefault(feature, []).append(f"({spread} - {sides[0]} - {sides[1]})")
        return spread

    for tree in forest:
        gains.append({})
        visit(tree, [], gains[-1])
    shares: dict[str, list[str]] = {}
    for found in gains:
        whole = " + ".join(g for each in found.values() for g in each)
        for feature, each in found.items():
            shares.setdefault(feature, []).append(f"coalesce(({' + '.join(each)}) / nullif({whole}, 0.0e0), 0.0e0)")
    return sums, {f: f"({' + '.join(each)}) / {number(len(forest))}" for f, each in sorted(shares.items())}


def importances(matrix: DataFrame, forest: list, target: str = "target") -> DataFrame:
    """``feature, importance`` of a stored forest on a table, from one aggregation; rows with a null feature or target are left out."""
    sums, shares = impurity_parts(forest, target)
    known = matrix.na.drop(subset=[target, *shares])
    once = known.agg(*(F.expr(text).alias(name) for name, text in sums.items()))
    return once.select(*(F.expr(text).alias(f) for f, text in shares.items())).unpivot([], list(shares), "feature", "importance")


def ledger(rows: DataFrame, keys: list[str], claims: dict[str, tuple[str, Column]]) -> DataFrame:
    """``keys, claim, evidence, status``: each claim's evidence column and whether its condition holds; null evidence can't be verified."""
    each = [F.struct(F.lit(name).alias("claim"), F.col(column).cast("double").alias("evidence"), F.when(F.col(column).isNull(), UNKNOWN).when(holds, MATCH).otherwise(MISMATCH).alias("status")) for name, (column, holds) in claims.items()]
    return rows.withColumn("_c", F.explode(F.array(*each))).select(*keys, "_c.*")
