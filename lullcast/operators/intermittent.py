"""Rate models that need a whole series at once: temporal aggregation and a tuned Croston rate, as folds over one array a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Smoothing weights that are tried: from 0.10 to 0.30.
GRID = tuple(i / 100 for i in range(10, 31))
MODELS = ("adida", "imapa", "croston_optimised")


def _let(name: str, value: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is made once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def best_smooth(values: str) -> str:
    """SQL: the array's level after smoothing with the weight of the least squared one-step error (equal ones: the least level); 0 of none."""
    # both weights are the doubles next to their decimals: 1 - a in doubles may be another one, which decides between equal losses
    grid = "array(" + ", ".join(f"named_struct('a', {a!r}e0, 'b', {round(1 - a, 2)!r}e0)" for a in GRID) + ")"
    start = f"transform({grid}, w -> named_struct('loss', 0e0, 'level', x[0], 'a', w.a, 'b', w.b))"
    step = "(s, v) -> transform(s, t -> named_struct('loss', t.loss + (v - t.level) * (v - t.level), 'level', t.a * v + t.b * t.level, 'a', t.a, 'b', t.b))"
    fold = f"aggregate(slice(x, 2, size(x)), {start}, {step}, s -> array_min(transform(s, t -> named_struct('loss', t.loss, 'level', t.level))).level)"
    return _let("x", values, f"CASE size(x) WHEN 0 THEN 0e0 WHEN 1 THEN x[0] ELSE {fold} END")


def bucketed(width: str) -> str:
    """SQL: the smoothed sums of ``d`` over buckets of ``width`` days, counted back from its end, as a rate a day."""
    sums = "transform(sequence(1, n), i -> aggregate(slice(d, size(d) - n * w + (i - 1) * w + 1, w), 0e0, (a, v) -> a + v))"
    return _let("w", width, _let("n", "CAST(size(d) DIV w AS INT)", f"CASE WHEN n = 0 THEN 0e0 ELSE {best_smooth(sums)} / w END"))


#: Sizes of the demands, days between them (the first from the start), and the mean of those days, whole and 1 at least.
SIZES = "filter(d, v -> v > 0)"
PLACES = "filter(transform(sequence(1, size(d)), i -> CASE WHEN d[i - 1] > 0 THEN i END), p -> p IS NOT NULL)"
GAPS = _let("p", PLACES, "transform(p, (q, i) -> CAST(q - CASE WHEN i = 0 THEN 0 ELSE p[i - 1] END AS DOUBLE))")
WIDTH = _let("p", PLACES, "CAST(greatest(1, bround(p[size(p) - 1] / size(p))) AS INT)")
RATES = {
    # sums over buckets of the mean interval, dealt back to days
    "adida": bucketed(WIDTH),
    # the mean of such rates over all widths up to the mean interval
    "imapa": _let("m", WIDTH, f"aggregate(transform(sequence(1, m), b -> {bucketed('b')}), 0e0, (a, v) -> a + v) / m"),
    "croston_optimised": f"{best_smooth(SIZES)} / {best_smooth(GAPS)}",
}


def rates(panel: DataFrame, starts: DataFrame) -> DataFrame:
    """``sku_id, origin, model, rate`` from each series' days before each of ``starts (origin, start)``, a few rows; 0 without demand."""
    rows = panel.join(F.broadcast(starts), F.col("day") < F.col("start"))  # a row for each origin
    series = rows.groupBy("sku_id", "origin").agg(F.transform(F.array_sort(F.collect_list(F.struct("day", "demand"))), lambda x: x["demand"]).alias("d"))
    cells = F.array(*(F.struct(F.lit(m).alias("model"), F.expr(f"CASE WHEN exists(d, v -> v > 0) THEN {RATES[m]} ELSE 0e0 END").alias("rate")) for m in MODELS))
    return series.select("sku_id", "origin", F.explode(cells).alias("x")).select("sku_id", "origin", "x.*")
