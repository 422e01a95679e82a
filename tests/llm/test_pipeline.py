"""The five stages on a small corpus: what each must drop, change and keep."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

import corpus_pipeline


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice(("th", "er", "on", "an", "re", "st")) for _ in range(rng.randint(2, 4)))
    text = lambda n=40: " ".join(word() for _ in range(n))
    item = text(30)
    rows, labels = [], []
    for i in range(240):
        bad = i % 4 == 0
        rows.append((i, text() + (" grumpel " + text(5) if bad else "")))
        labels.append((i, 1, int(bad)))
    copy = rows[1][1]
    rows += [(900, copy), (901, copy + " " + word()), (902, text(10) + " " + item + " " + text(4)), (903, "reach me at a.b@c.example.com now"), (904, None), (905, ""), (906, "x"), (906, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit(9.0), "base": F.lit("b")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii_redaction", "sentencepiece"]
    now, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns
        now.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = sorted(r.doc_id for r in now.collect())
    toxic = {i for i, _, y in labels if y}
    lost = set(i for i, _ in rows) - set(kept["toxicity"])
    assert len(lost ^ toxic) <= 4 and {900, 904, 905} <= set(kept["toxicity"])
    assert {900, 901} & set(kept["minhash_near_dedup"]) == set() and kept["minhash_near_dedup"].count(906) == 1
    assert set(kept["minhash_near_dedup"]) - set(kept["benchmark_decontamination"]) == {902}
    changed = {r.doc_id: r for r in now.collect()}
    assert changed[903].text == "reach me at <EMAIL> now" and changed[903].n_chars == len(changed[903].text) and changed[903].base == "b" and changed[1].text == copy and changed[904].text is None
    last = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == kept["pii_redaction"] and all(r.round_trip for r in last)
    none = f"{tmp_path}/none"
    docs.limit(0).write.parquet(f"{none}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").limit(0).write.parquet(f"{none}/{t}.parquet")
    assert corpus_pipeline.run(spark, none).count() == 0
