"""Global tree and linear forecasters on the feature matrix, with ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import matrix as feature_matrix

FEATURES = ("lag_1", "lag_2", "lag_7", "rolling_mean_3", "rolling_mean_7", "rolling_std_7", "dow", "is_weekend", "is_event", "snap", "event_h", "snap_h", "weekend_h")


def _model(kind: str, seed: int, **params):
    common = {"featuresCol": "features", "labelCol": "target", "predictionCol": "prediction"}
    if kind == "forest":
        return RandomForestRegressor(**common, seed=seed, **({"numTrees": 20, "maxDepth": 6, "minInstancesPerNode": 5} | params))
    if kind == "boosted":
        return GBTRegressor(**common, seed=seed, **({"maxIter": 10, "maxDepth": 4} | params))
    if kind == "tweedie":
        return GeneralizedLinearRegression(**common, family="tweedie", variancePower=1.5, linkPower=0.0, **({"regParam": 0.1, "maxIter": 10} | params))
    raise ValueError(kind)


def fit(matrix: DataFrame, until: int, kind: str = "forest", features=FEATURES, categories=("cat_id", "store_id"), seed: int = 42, **params) -> PipelineModel:
    """One model over all series from the complete rows up to day ``until``; categories are coded in alphabetical order, unknown ones are an error."""
    rows = matrix.filter(F.col("day") <= until).na.drop(subset=[*features, "target"])
    codes = [StringIndexer(inputCol=c, outputCol=f"{c}_code", stringOrderType="alphabetAsc", handleInvalid="error") for c in categories]
    first = []
    if kind == "tweedie":  # a log link wants sizes on a log scale
        sized = [f for f in features if f.startswith(("lag_", "rolling_"))]
        first = [SQLTransformer(statement="SELECT *, " + ", ".join(f"ln(1 + {f}) AS {f}_log" for f in sized) + " FROM __THIS__")]
        features = tuple(f"{f}_log" if f in sized else f for f in features)
    assembler = VectorAssembler(inputCols=[*features, *(f"{c}_code" for c in categories)], outputCol="raw")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True)  # trees don't mind, the linear model needs it
    return Pipeline(stages=[*first, *codes, assembler, scaler, _model(kind, seed, **params)]).fit(rows)


def predict(model: PipelineModel, matrix: DataFrame, first: int, last: int, features=FEATURES) -> DataFrame:
    """``sku_id, day, pred_sum, target`` on days ``first`` to ``last`` with complete features."""
    rows = matrix.filter(F.col("day").between(first, last)).na.drop(subset=list(features))
    return model.transform(rows).select("sku_id", "day", F.greatest("prediction", F.lit(0.0)).alias("pred_sum"), "target")


def importances(spark, model: PipelineModel) -> DataFrame:
    names = model.stages[-3].getInputCols()
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, model.stages[-1].featureImportances.toArray(), strict=True)], "feature string, importance double")


def trees(model: PipelineModel) -> list:
    """A fitted ensemble as plain values: each tree is its leaf's value or ``(feature, threshold, at most, above)``, thresholds on the features' own scale."""
    names, scaler, ensemble = model.stages[-3].getInputCols(), model.stages[-2], model.stages[-1]
    mean, std = scaler.mean.toArray(), scaler.std.toArray()

    def plain(node):
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        i = node.split().featureIndex()
        return names[i], float(node.split().threshold() * std[i] + mean[i]), plain(node.leftChild()), plain(node.rightChild())

    return [plain(t._call_java("rootNode")) for t in ensemble.trees]


def number(x) -> str:
    """A double in every dialect."""
    return f"{float(x):.17g}" + ("" if "e" in f"{float(x):.17g}" else "e0")


def as_sql(forest: list, before: str = "") -> str:
    """The mean of the trees' values as one SQL expression over the features' columns (``before``: what their names follow), not below 0; rows with a null feature have null."""

    def case(t) -> str:
        return number(t) if not isinstance(t, tuple | list) else f"CASE WHEN {before}{t[0]} <= {number(t[1])} THEN {case(t[2])} ELSE {case(t[3])} END"

    def used(t) -> set[str]:
        return set() if not isinstance(t, tuple | list) else {t[0]} | used(t[2]) | used(t[3])

    known = " AND ".join(f"{before}{c} IS NOT NULL" for c in sorted(set().union(*map(used, forest))))
    value = f"greatest(0.0e0, ({' + '.join(map(case, forest))}) / {number(len(forest))})"
    return f"CASE WHEN {known} THEN {value} END" if known else value


def frozen(matrix: DataFrame, forest: list, name: str = "pred_sum") -> DataFrame:
    """Adds a stored forest's prediction as an expression: no model object, no other pass than the scan's."""
    return matrix.withColumn(name, F.expr(as_sql(forest)))


def grid(matrix: DataFrame, train_end: int, val_end: int, options: list[dict], kind: str = "forest") -> DataFrame:
    """Pooled validation error of each parameter set, one fit each; the best is first (ties to the smaller settings)."""
    out = None
    for i, o in enumerate(options):
        p = predict(fit(matrix, train_end, kind, **o), matrix, train_end + 1, val_end).filter("target is not null")
        row = p.agg(F.avg(F.abs(F.col("target") - F.col("pred_sum"))).alias("mae"), F.count("*").alias("n")).withColumns({"option": F.lit(i), "settings": F.lit(str(sorted(o.items())))})
        out = row if out is None else out.unionByName(row)
    return out.orderBy("mae", "option")


#: Days that the state of a recursion holds: what the longest lag and rolling feature reach back to.
DEPTH = 7


def one_step(panel: DataFrame) -> DataFrame:
    """The feature matrix whose target is the next day's demand alone."""
    return feature_matrix(panel, 1)


def recursive(panel: DataFrame, forest: list, horizon: int) -> DataFrame:
    """Adds ``steps`` and ``pred_sum``: a one-day forest applied ``horizon`` times on its own predictions, from every day of every series.

    A day's state is one array, its series' last ``DEPTH`` days.  A step makes lags and rolling
    features from the array, whose end the predictions become; the calendar of the days ahead is
    known.  The steps are a fold within the row, so all starts take them in one pass.  A start whose
    state or calendar is not whole has null.
    """
    w = W.partitionBy("sku_id").orderBy("day")
    flag = {"is_event": F.col("event_name_1").isNotNull().cast("double"), "snap": F.col("snap").cast("double"), "is_weekend": (F.weekday("date") >= 5).cast("double")}
    # each flag of today and of the days ahead
    known = {f"_{n}": F.array(c, *(F.lead(c, k).over(w) for k in range(1, horizon + 1))) for n, c in flag.items()}
    days = F.collect_list("demand").over(w.rowsBetween(1 - DEPTH, 0))
    state = panel.withColumns({"_h": days, **known}).withColumn("_h", F.when(F.size("_h") == DEPTH, F.col("_h")))
    total = lambda n, f="x": f"aggregate(slice(s.h, {DEPTH - n + 1}, {n}), 0e0, (a, x) -> a + {f})"
    made = {
        "lag_1": "s.h[6]", "lag_2": "s.h[5]", "lag_7": "s.h[0]", "rolling_mean_3": f"{total(3)} / 3e0", "rolling_mean_7": f"{total(7)} / 7e0",
        "rolling_std_7": f"sqrt(greatest(7 * {total(7, 'x * x')} - power({total(7)}, 2), 0e0) / 42e0)",
        "dow": "weekday(date_add(date, k))", "is_weekend": "_is_weekend[k]", "is_event": "_is_event[k]", "snap": "_snap[k]",
        "event_h": "_is_event[k + 1]", "snap_h": "_snap[k + 1]", "weekend_h": "_is_weekend[k + 1]",
    }
    row = "named_struct(" + ", ".join(f"'{n}', {v}" for n, v in made.items()) + ")"
    # an array of one binds the features, then the prediction, to a name
    step = f"transform(transform(array({row}), f -> {as_sql(forest, 'f.')}), p -> named_struct('h', concat(slice(s.h, 2, {DEPTH - 1}), array(p)), 'steps', concat(s.steps, array(p))))[0]"
    fold = f"aggregate(sequence(0, {horizon - 1}), named_struct('h', _h, 'steps', cast(array() as array<double>)), (s, k) -> {step}, s -> s.steps)"
    steps = F.when(F.col("_h").isNotNull(), F.expr(fold))
    out = state.withColumn("steps", steps).withColumn("steps", F.when(~F.exists("steps", lambda x: x.isNull()), F.col("steps")))
    return out.select(*panel.columns, "steps", F.aggregate("steps", F.lit(0.0), lambda a, x: a + x).alias("pred_sum"))
