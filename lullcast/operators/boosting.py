"""Gradient-boosted trees for any twice differentiable loss, by histograms of gradients.

A level of the trees is one aggregation: sums of gradients and second derivatives for every
leaf, feature and bin, combined within tasks before they are exchanged.  Several models
(one for each value of ``by``) grow together, so their number adds no pass.  Rows never leave the
executors; the driver sees bins' sums, whose number follows from leaves, features and bins.

A model is plain values, ``(base, trees)``, with trees as in ``ml.trees``; scoring is an expression.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import keep
from .ranks import exact_quantiles

BINS, TREES, DEPTH, RATE, RIDGE, LEAST = 16, 6, 3, 0.3, 1.0, 20
#: Places to which gains (as a share of the root's second derivatives) are compared; equal ones go to the first feature and bin.
PLACES = 9
#: Trees after which the scores so far are stored instead of made again.
STORED = 8
#: Bins' sums on the driver at most.
MOST = 2_000_000


@dataclass(frozen=True)
class Loss:
    """The starting score of a mean target, gradient and second derivative at a score, and the prediction of a score."""

    start: Callable[[Column], Column]
    gradient: Callable[[Column, Column], Column]
    curvature: Callable[[Column, Column], Column]
    value: Callable[[Column], Column]


def tweedie(power: float = 1.5) -> Loss:
    """Deviance of a Tweedie target (many zeros, positive sizes) with a log link, 1 < power < 2."""
    if not 1 < power < 2:
        raise ValueError("power must lie between 1 and 2")
    a, b = 1 - power, 2 - power
    return Loss(
        lambda m: F.log(F.greatest(m, F.lit(1e-9))),
        lambda y, s: -y * F.exp(a * s) + F.exp(b * s),
        lambda y, s: -a * y * F.exp(a * s) + b * F.exp(b * s),
        F.exp,
    )


def squared() -> Loss:
    return Loss(lambda m: m, lambda y, s: s - y, lambda y, s: F.lit(1.0), lambda s: s)


LOSSES = {"tweedie": tweedie, "squared": squared}


def cuts(rows: DataFrame, features: tuple[str, ...], by: str, bins: int = BINS) -> dict:
    """``{key: {feature: cut points}}``: each feature's distinct quantiles, exact, by counting."""
    long = rows.select(by, *(F.col(f).cast("double").alias(f) for f in features)).unpivot([by], list(features), "_f", "_x")
    found = exact_quantiles(long, "_x", [by, "_f"], tuple(i / bins for i in range(1, bins)))
    out: dict = {}
    for r in found.limit(MOST).collect():  # a row for each model and feature
        out.setdefault(r[by], {})[r["_f"]] = sorted(set(r["q"]))
    return out


def _by_key(by: str, values: dict, made: Callable) -> Column:
    """The expression that ``made`` gives for each key's value."""
    out = None
    for key, v in values.items():
        out = F.when(F.col(by) == key, made(v)) if out is None else out.when(F.col(by) == key, made(v))
    return out


def _tree_of(tree, feature: Callable[[str], Column]) -> Column:
    if not isinstance(tree, tuple | list):
        return F.lit(float(tree))
    return F.when(feature(tree[0]) <= tree[1], _tree_of(tree[2], feature)).otherwise(_tree_of(tree[3], feature))


def fit(rows: DataFrame, features: tuple[str, ...], target: str = "target", by: str = "fit", loss: Loss | None = None, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, bins: int = BINS, ridge: float = RIDGE, least: int = LEAST) -> dict:
    """``{key: (base, trees)}`` for each value of ``by``, from its rows with complete features and a target.

    A leaf is cut where the loss falls most and both sides have ``least`` rows; its
    value is ``rate`` times the Newton step with ``ridge``.
    """
    loss = loss or tweedie()
    known = keep(rows.na.drop(subset=[by, *features, target]).select(by, *(F.col(f).cast("double").alias(f) for f in features), F.col(target).cast("double").alias("_y")))
    at = cuts(known, features, by, bins)
    bases = {r[by]: r["b"] for r in known.groupBy(by).agg(loss.start(F.avg("_y")).alias("b")).limit(MOST).collect()}
    if not bases:
        return {}
    # bins, so that every pass reads one small whole number a feature
    place = F.array(*(_by_key(by, at, lambda c, f=f: F.size(F.filter(F.array(*map(F.lit, c[f])) if c.get(f) else F.array().cast("array<double>"), lambda x: x < F.col(f)))).cast("byte") for f in features))
    state = keep(known.select(by, "_y", place.alias("_b"), _by_key(by, bases, F.lit).alias("_s")))
    made: dict = {key: [] for key in bases}
    fresh: dict = {key: [] for key in bases}
    number = {f: i for i, f in enumerate(features)}
    binned = lambda f: F.col("_b")[number[f]]

    def score() -> Column:
        return F.col("_s") + _by_key(by, fresh, lambda ts: sum((_tree_of(t, binned) for t in ts), F.lit(0.0)))

    for n in range(trees):
        grown: dict = {key: {0: None} for key in bases}  # leaf -> (feature, bin) once it is cut
        values: dict = {}
        for level in range(depth):
            for r in _best(state, by, score(), _leaf(by, grown, binned), len(features), loss, ridge, least):
                if r.leaf not in grown[r[by]]:
                    continue
                node, step = grown[r[by]], lambda g, h: -rate * g / (h + ridge)
                if r.feature is None:
                    values[r[by], r.leaf] = step(r.g, r.h)
                    continue
                node[r.leaf] = (features[r.feature], r.bin)
                for side, g, h in ((1, r.gl, r.hl), (2, r.g - r.gl, r.h - r.hl)):
                    node[2 * r.leaf + side] = None
                    values[r[by], 2 * r.leaf + side] = step(g, h)

        def plain(key, leaf=0):
            cut = grown[key][leaf]
            if cut is None:
                return values.get((key, leaf), 0.0)
            return cut[0], cut[1], plain(key, 2 * leaf + 1), plain(key, 2 * leaf + 2)

        for key in bases:
            fresh[key].append(plain(key))
        if (n + 1) % STORED == 0 and n + 1 < trees:
            state = keep(state.withColumn("_s", score()))
            for key in bases:
                made[key] += fresh[key]
                fresh[key] = []

    def lifted(key, tree):
        return tree if not isinstance(tree, tuple) else (tree[0], at[key][tree[0]][tree[1]], lifted(key, tree[2]), lifted(key, tree[3]))

    return {key: (bases[key], [lifted(key, t) for t in made[key] + fresh[key]]) for key in bases}


def _leaf(by: str, grown: dict, binned: Callable[[str], Column]) -> Column:
    """The number of the open leaf that a row lies in: 0 is the root, 2n+1 and 2n+2 lie below n."""

    def of(nodes: dict, leaf: int = 0) -> Column:
        cut = nodes[leaf]
        if cut is None:
            return F.lit(leaf)
        return F.when(binned(cut[0]) <= cut[1], of(nodes, 2 * leaf + 1)).otherwise(of(nodes, 2 * leaf + 2))

    return _by_key(by, grown, of)


def _best(state: DataFrame, by: str, score: Column, leaf: Column, n_features: int, loss: Loss, ridge: float, least: int) -> list:
    """For each open leaf its sums and its best cut (null where none helps): one pass over the rows."""
    rows = state.select(by, "_y", "_b", score.alias("_s"), leaf.alias("leaf"))
    rows = rows.select(by, "leaf", "_b", loss.gradient(F.col("_y"), F.col("_s")).alias("_g"), loss.curvature(F.col("_y"), F.col("_s")).alias("_h"))
    each = rows.select(by, "leaf", "_g", "_h", F.posexplode("_b").alias("feature", "bin"))
    sums = each.groupBy(by, "leaf", "feature", "bin").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count("*").alias("n"))
    so_far = W.partitionBy(by, "leaf", "feature").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy(by, "leaf", "feature")
    df = sums.select(by, "leaf", "feature", "bin", *(F.sum(c).over(so_far).alias(f"{c}l") for c in "ghn"), *(F.sum(c).over(whole).alias(c) for c in "ghn"))
    part = lambda g, h: g * g / (h + ridge)
    gain = (part(F.col("gl"), F.col("hl")) + part(F.col("g") - F.col("gl"), F.col("h") - F.col("hl")) - part(F.col("g"), F.col("h"))) / F.col("h")
    fits = (F.col("nl") >= least) & (F.col("n") - F.col("nl") >= least)
    df = df.withColumn("gain", F.when(fits, F.round(gain, PLACES)))
    cut = F.struct((-F.col("gain")).alias("minus"), F.col("feature"), F.col("bin"), F.col("gl"), F.col("hl"))
    # a leaf's sums are those of its first feature, whose bins all rows share out between them
    own = lambda c: F.max(F.when(F.col("feature") == 0, F.col(c))).alias(c)
    best = df.groupBy(by, "leaf").agg(F.min(F.when(F.col("gain") > 0, cut)).alias("c"), own("g"), own("h"))
    return best.select(by, "leaf", "g", "h", "c.feature", "c.bin", "c.gl", "c.hl").limit(MOST).collect()  # a row for each leaf


def scored(df: DataFrame, models: dict, by: str = "fit", loss: Loss | None = None, name: str = "pred_sum") -> DataFrame:
    """Adds the prediction of the row's model; null where it has none or a feature is null."""
    loss = loss or tweedie()
    if not models:
        return df.withColumn(name, F.lit(None).cast("double"))

    def used(t) -> set[str]:
        return set() if not isinstance(t, tuple | list) else {t[0]} | used(t[2]) | used(t[3])

    def one(model) -> Column:
        base, trees = model
        known = F.lit(True)
        for f in sorted(set().union(*map(used, trees))):
            known = known & F.col(f).isNotNull()
        return F.when(known, loss.value(sum((_tree_of(t, F.col) for t in trees), F.lit(base))))

    return df.withColumn(name, _by_key(by, models, one))
