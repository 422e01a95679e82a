"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``.  All but the last return the
columns of ``documents``.  Null and empty texts pass every stage (they are clean,
like no other document, and have no ids); an empty table stays empty; further
columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lullcast.llm import decontaminate, minhash, pii, toxicity, transducer
from lullcast.llm.work import Work

#: Ids at most that are broadcast to drop their documents; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_anti").select(*docs.columns)


def _aside(docs: DataFrame) -> DataFrame:
    """The same columns under names that no operator adds."""
    return docs.select(*(F.col(c).alias(f"in_{c}") for c in docs.columns))


def _back(df: DataFrame, docs: DataFrame) -> DataFrame:
    return df.select(*(F.col(f"in_{c}").alias(c) for c in docs.columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose highest window is likelier toxic than not go."""
    net = toxicity.fit(docs, _table(spark, sf_dir, "labels"), usable=toxicity.LEARNABLE)
    return _back(toxicity.with_toxicity(_aside(docs), net, "in_text").filter("score < 0.5"), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five words, similarity 0.8) the document with the smallest id stays.

    Rows that share an id are documents of their own, and grouped by their texts; of a group's
    rows with the smallest id the one whose digest is smallest stays.  Rows
    with a null id stay.
    """
    work = Work(spark)
    if docs.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").isEmpty():
        groups = minhash.near_duplicates(docs)
        return _without(docs, work.save(groups.filter("not kept").select("doc_id").distinct()))
    names = docs.columns
    row = F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())
    rows = work.save(docs.select(row.alias("row"), F.struct(*names).alias("it")))
    groups = minhash.near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col("it.text").alias("text"))).select(F.col("doc_id").alias("row"), "component_id")
    order = F.struct(F.col("it.doc_id").alias("id"), F.sha2(F.to_json("it"), 256).alias("digest"), "row")
    first = groups.filter("row is not null").join(rows.select("row", order.alias("order")), "row").groupBy("component_id").agg(F.min("order").alias("first"))
    kept = rows.join(first.select(F.col("first.row").alias("row")), "row", "left_semi").unionByName(rows.filter("row is null"))
    return kept.select("it.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within its edit budget, go."""
    work = Work(spark)
    found = work.save(decontaminate.edit_matches(docs, _table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return _without(docs, found)


def redact_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes a mark of its kind; ``n_chars`` follows."""
    out = pii.with_pii(_aside(docs), "in_text").withColumn("in_text", F.col("redacted"))
    if "n_chars" in docs.columns:
        out = out.withColumn("in_n_chars", F.when(F.col("spans") == "", F.col("in_n_chars")).otherwise(F.char_length("in_text").cast(docs.schema["n_chars"].dataType)))
    return _back(out, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's piece ids, and whether they decode to its text."""
    coded = transducer.round_trip(docs.select("doc_id", "text"))
    same = F.coalesce("decoded", F.lit("")) == F.translate(F.coalesce("text", F.lit("")), "▁", " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii_redaction", redact_pii),
    ("sentencepiece", encode),
]
#: Trained networks, verified sets and shortest paths have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark)
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = work.save(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
