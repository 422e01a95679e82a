"""The exact median of all pairwise means, from blocks of ordered values: no pair is left out, few are made."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import keep
from .ranks import _same, counted_below, size, value_counts

#: Rows of a block at least, and blocks of a group at most, about.
ROWS, BLOCKS = 1024, 2048
#: Cuts of a round; pairs of a group that may be listed.
CUTS, FEW = 128, 200_000
#: Sums that a task makes at once.
SUMS = 1 << 20


def _places(xs: np.ndarray, ys: np.ndarray, t: float) -> np.ndarray:
    """For each x how many of the ordered ys have x + y <= t, by the rounded sum itself."""
    at = np.searchsorted(ys, t - xs, "right")
    while True:
        up = (at < len(ys)) & (xs + ys[np.minimum(at, len(ys) - 1)] <= t)
        down = (at > 0) & (xs + ys[np.maximum(at, 1) - 1] > t)
        if not (up.any() or down.any()):
            return at
        at = at + up - down


def counted(xs: np.ndarray, xn: np.ndarray, ys: np.ndarray, yn: np.ndarray, own: bool, t: float) -> int:
    """Pairs of a row of x and one of y (``own``: of two rows of the same block, or one twice) whose sum is t at most."""
    if xs[0] + ys[0] > t:
        return 0
    if xs[-1] + ys[-1] <= t:
        rows = int(xn.sum())
        return rows * (rows + 1) // 2 if own else rows * int(yn.sum())
    so_far = np.concatenate(([0], np.cumsum(yn)))
    pairs = int((xn * so_far[_places(xs, ys, t)]).sum())
    return (pairs + int(xn[xs + xs <= t].sum())) // 2 if own else pairs


def listed(xs: np.ndarray, xn: np.ndarray, ys: np.ndarray, yn: np.ndarray, own: bool, lo: float, hi: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Different sums in (lo, hi] and their numbers of pairs."""
    first, last = _places(xs, ys, lo), _places(xs, ys, hi)
    if own:
        first = np.maximum(first, np.arange(len(xs)))
    many = np.maximum(last - first, 0)
    ends = np.cumsum(many)
    start = 0
    while start < len(xs):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + SUMS, "right")))
        n = many[start:stop]
        x = np.repeat(np.arange(start, stop), n)
        if len(x):
            y = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[start:stop], n)
            pairs = xn[x] * yn[y]
            if own:
                pairs = np.where(x == y, xn[x] * (xn[x] + 1) // 2, pairs)
            sums = xs[x] + ys[y]
            order = np.argsort(sums, kind="stable")
            sums, pairs = sums[order], pairs[order]
            heads = np.flatnonzero(np.concatenate(([True], sums[1:] != sums[:-1])))
            yield sums[heads], np.add.reduceat(pairs, heads)
        start = stop


def _array(column: pa.Array, i: int) -> np.ndarray:
    return column[i].values.to_numpy(zero_copy_only=False)


def _each(batches: Iterator[pa.RecordBatch], work) -> Iterator[pa.RecordBatch]:
    """``_g`` and what ``work`` yields of each pair of blocks and the group's bounds: doubles and whole numbers."""
    for batch in batches:
        c = {n: batch.column(n) for n in batch.schema.names}
        for i in range(batch.num_rows):
            xs, xn, ys, yn, cuts = (_array(c[n], i) for n in ("_xs", "_xn", "_ys", "_yn", "_cuts"))
            for sums, pairs in work(xs, xn, ys, yn, c["_own"][i].as_py(), cuts):
                yield pa.RecordBatch.from_arrays([pa.array([c["_g"][i].as_py()] * len(sums), pa.int64()), pa.array(sums, pa.float64()), pa.array(pairs, pa.int64())], ["_g", "_s", "_n"])


def _counts(batches):
    def work(xs, xn, ys, yn, own, cuts):
        below = np.array([counted(xs, xn, ys, yn, own, t) for t in cuts])
        yield cuts[1:], below[1:] - below[0]

    yield from _each(batches, work)


def _lists(batches):
    yield from _each(batches, lambda xs, xn, ys, yn, own, cuts: listed(xs, xn, ys, yn, own, cuts[0], cuts[-1]))


def _pairs(blocks: DataFrame, bounds: DataFrame, todo) -> DataFrame:
    """``todo`` of every two blocks of a group that have a sum between the first and last of its ``bounds (_g, _cuts)``."""
    spark = blocks.sparkSession
    edges = blocks.select("_g", "_at", "_min", "_max").join(bounds, "_g")
    a, b = edges.alias("a"), edges.select("_g", "_at", "_min", "_max").alias("b")
    near = (F.col("a._at") <= F.col("b._at")) & (F.col("a._min") + F.col("b._min") <= F.element_at("a._cuts", -1)) & (F.col("a._max") + F.col("b._max") > F.col("a._cuts")[0])
    both = a.join(b, (F.col("a._g") == F.col("b._g")) & near).select("a._g", F.col("a._at").alias("_i"), F.col("b._at").alias("_j"), "a._cuts")
    left = blocks.select("_g", F.col("_at").alias("_i"), F.col("_xs"), F.col("_xn"))
    right = blocks.select("_g", F.col("_at").alias("_j"), F.col("_xs").alias("_ys"), F.col("_xn").alias("_yn"))
    whole = both.join(left, ["_g", "_i"]).join(right, ["_g", "_j"]).withColumn("_own", F.col("_i") == F.col("_j"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return whole.repartition(tasks, "_g", "_i", "_j").mapInArrow(todo, "_g long, _s double, _n long")


def median_of_means(rows: DataFrame, value: str, by: list[str], name: str) -> DataFrame:
    """``by`` and the median of (x + y) / 2 over every two rows of a group, a row with itself included; nulls are left out.

    Ordered values lie in blocks.  In each round the pairs up to a cut are counted from the blocks whose
    sums the cut may part, until few sums can be the middle ones; those are listed with their numbers of pairs.
    Only groups' bounds come to the driver, of groups of more than ``FEW`` pairs.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")  # a row has two blocks
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    counts = value_counts(rows.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_d")), "_d", by)
    placed = counted_below(counts, "_d", by)
    block = F.floor(F.col("_below") / F.greatest(F.lit(ROWS), F.ceil(F.col("_m") / BLOCKS)))
    cells = F.array_sort(F.collect_list(F.struct(F.col("_d").alias("d"), size().alias("n"))))
    made = placed.groupBy(*by, block.alias("_at")).agg(cells.alias("_c"), F.min("_d").alias("_min"), F.max("_d").alias("_max"), F.max("_m").alias("_m"))
    key = F.xxhash64(F.lit(42), *by) if by else F.lit(0).cast("long")
    blocks = keep(made.select(*by, key.alias("_g"), "_at", "_min", "_max", "_m", F.col("_c.d").alias("_xs"), F.col("_c.n").alias("_xn")))
    groups = keep(blocks.groupBy(*by, "_g").agg(F.max("_m").alias("_m"), F.min("_min").alias("_min"), F.max("_max").alias("_max")))
    if groups.groupBy("_g").count().filter("count > 1").limit(1).collect():
        raise ValueError("two groups with one hash")
    blocks = blocks.drop(*by, "_m")
    total = (F.col("_m") * (F.col("_m") + 1)) / 2
    state = {}  # group: first and last bound, pairs up to the first, pairs up to the last, places of the middle ones
    for r in groups.filter(total > FEW).collect():
        pairs = r["_m"] * (r["_m"] + 1) // 2
        state[r["_g"]] = (math.nextafter(2 * r["_min"], -math.inf), 2 * r["_max"], 0, pairs, (pairs - 1) // 2, pairs // 2)
    open_ = set(state)
    while open_:
        cuts = {}
        for g in open_:
            lo, hi = state[g][:2]
            cuts[g] = [lo, *sorted({c for c in (lo + (hi - lo) * (j / CUTS) for j in range(1, CUTS)) if lo < c < hi}), hi]
        found = _pairs(blocks, F.broadcast(spark.createDataFrame(list(cuts.items()), "_g long, _cuts array<double>")), _counts)  # a row for each large group
        below = {(r["_g"], r["_s"]): r["_all"] for r in found.groupBy("_g", "_s").agg(F.sum("_n").alias("_all")).collect()}
        for g in list(open_):
            lo, hi, before, upto, first, last = state[g]
            steps = [(lo, before), *((c, before + below.get((g, c), 0)) for c in cuts[g][1:])]
            new_lo = max(s for s in steps if s[1] <= first)
            new_hi = min(s for s in steps if s[1] > last)
            if (new_lo[0], new_hi[0]) == (lo, hi) or new_hi[1] - new_lo[1] <= FEW:
                open_.remove(g)
            state[g] = (new_lo[0], new_hi[0], new_lo[1], new_hi[1], first, last)
    known = spark.createDataFrame([(g, s[0], s[1], s[2]) for g, s in state.items()], "_g long, _lo double, _hi double, _before long")
    bounds = groups.join(F.broadcast(known), "_g", "left")  # a row for each large group
    bounds = bounds.select(*by, "_g", F.array(F.coalesce("_lo", F.lit(-math.inf)), F.coalesce("_hi", F.lit(math.inf))).alias("_cuts"), F.coalesce("_before", F.lit(0)).alias("_before"), F.expr("_m * (_m + 1) div 2").alias("_pairs"))
    sums = _pairs(blocks, bounds.select("_g", "_cuts"), _lists).groupBy("_g", "_s").agg(F.array(F.sum("_n")).alias("_n"))
    ordered = counted_below(sums, "_s", ["_g"]).alias("l").join(bounds.alias("r"), _same("l", "r", ["_g"])).select("l.*", *(F.col(f"r.{c}") for c in (*by, "_before", "_pairs")))
    at = lambda place: F.max(F.when(F.col("_below") <= F.expr(place) - F.col("_before"), F.col("_s")))
    ends = ordered.groupBy("_g", *by).agg(at("(_pairs - 1) div 2").alias("_a"), at("_pairs div 2").alias("_b"))
    return ends.select(*by, (F.col("_a") / 2 + (F.col("_b") / 2 - F.col("_a") / 2) * 0.5).alias(name))
