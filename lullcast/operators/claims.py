"""Declarative checks of result tables: each claim becomes one row with a status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.artefacts import few

MATCH, MISMATCH, UNKNOWN = "match", "mismatch", "cannot be verified"
KINDS = ("row_count", "lower_everywhere", "all_true", "range", "all_greater", "all_less", "count_where", "sequence")
_OPERATORS = {"<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "==": lambda c, v: c == v}


def _holds(df: DataFrame, claim: dict) -> tuple[bool | None, str]:
    kind, tol = claim["check"], float(claim.get("tolerance", 0))
    if kind == "row_count":
        n = df.count()
        return abs(n - claim["value"]) <= tol, str(n)
    if kind == "lower_everywhere":
        low, high = claim["models"]
        wide = df.groupBy(claim["by"]).pivot(claim["model_column"], [low, high]).agg(F.first(F.expr(f"try_cast(`{claim['column']}` as double)"))).na.drop()
        r = wide.agg(F.count("*").alias("n"), F.bool_and(F.col(low) < F.col(high)).alias("ok")).first()
        return (None if not r.n else r.ok), f"{r.n} points"
    name = claim["column"]
    if kind == "all_true":
        as_text = F.lower(F.col(name).cast("string"))
        r = df.agg(F.count(name).alias("n"), F.bool_and(~as_text.isin("false", "0", "0.0", "")).alias("ok")).first()
        return (None if not r.n else r.ok), f"{r.n} rows"
    value = F.round(F.expr(f"try_cast(`{name}` as double)"), 10)
    rows = df.select("*", value.alias("_v")).filter("_v is not null")
    if kind == "range":
        r = rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi")).first()
        return (None if r.lo is None else r.lo >= claim["lo"] - tol and r.hi <= claim["hi"] + tol), f"{r.lo} to {r.hi}"
    if kind in ("all_greater", "all_less"):
        strict = (F.col("_v") > claim["value"]) if kind == "all_greater" else (F.col("_v") < claim["value"])
        near = (F.abs(F.col("_v") - claim["value"]) <= tol) if tol else F.lit(False)
        r = rows.agg(F.count("*").alias("n"), F.bool_and(strict | near).alias("ok")).first()
        return (None if not r.n else r.ok), f"{r.n} rows"
    if kind == "count_where":
        near = (F.abs(F.col("_v") - claim["value"]) <= tol) if tol else F.lit(False)
        n = rows.filter(_OPERATORS[claim["operator"]](F.col("_v"), F.lit(claim["value"])) | near).count()
        return n == claim["expected"], str(n)
    if kind == "sequence":
        spark = df.sparkSession
        want = spark.createDataFrame([(i + 1, float(v)) for i, v in enumerate(claim["values"])], "i int, w double")
        # the rows of a claim's table are few
        got = rows.withColumn("i", F.row_number().over(W.orderBy(*claim["order"]))).select("i", "_v")
        r = want.join(got, "i", "full").agg(F.bool_and(F.col("w").isNotNull() & F.col("_v").isNotNull()).alias("same"), F.max(F.abs(F.col("w") - F.col("_v"))).alias("far")).first()
        return bool(r.same) and r.far <= tol, f"largest difference {r.far}"
    return None, f"unknown check {kind}"


def check(spark: SparkSession, claims: list[dict], tables: dict[str, DataFrame], mode: str = "full") -> DataFrame:
    """``id, status, detail`` for each claim; a table or column that isn't there, no rows, or a claim of another mode can't be verified."""
    out = []
    for claim in claims:
        df = tables.get(claim["table"])
        needed = [c for c in (claim.get("column"), claim.get("by"), claim.get("model_column"), *claim.get("order", ()), *claim.get("filter", {})) if c]
        if claim.get("mode", mode) != mode:
            status, detail = UNKNOWN, f"only in mode {claim['mode']}"
        elif df is None:
            status, detail = UNKNOWN, "no such table"
        elif missing := [c for c in needed if c not in df.columns]:
            status, detail = UNKNOWN, "no column " + ", ".join(missing)
        else:
            for c, v in claim.get("filter", {}).items():
                df = df.filter(F.col(c) == F.lit(v))
            if df.isEmpty():
                status, detail = UNKNOWN, "no rows"
            else:
                ok, detail = _holds(df, claim)
                status = UNKNOWN if ok is None else MATCH if ok else MISMATCH
        out.append((str(claim["id"]), status, detail))
    return spark.createDataFrame(out, "id string, status string, detail string")


def summary(checked: DataFrame) -> DataFrame:
    return checked.groupBy("status").agg(F.count("*").alias("n"))


def markdown(checked: DataFrame, title: str = "Claims") -> str:
    rows = few(checked.orderBy("id"))
    return "\n".join([f"# {title}", "", "| claim | status | detail |", "|---|---|---|", *(f"| {r.id} | {r.status} | {r.detail} |" for r in rows)]) + "\n"


def reconcile(stored: DataFrame, found: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """For each column: keys in both tables, only stored, only found, and the largest absolute difference."""
    a = stored.select(*keys, *(F.col(c).alias(f"_a_{c}") for c in columns), F.lit(True).alias("_a"))
    b = found.select(*keys, *(F.col(c).alias(f"_b_{c}") for c in columns), F.lit(True).alias("_b"))
    both = a.join(b, keys, "full")
    row = both.agg(F.count_if(F.col("_a") & F.col("_b")).alias("n_common"), F.count_if(F.col("_b").isNull()).alias("n_missing"), F.count_if(F.col("_a").isNull()).alias("n_extra"), *(F.max(F.abs(F.col(f"_a_{c}") - F.col(f"_b_{c}"))).alias(c) for c in columns))
    return row.unpivot(["n_common", "n_missing", "n_extra"], columns, "metric", "max_abs_diff")
