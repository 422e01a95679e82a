"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, gif, hdlang, langmodel, merkle, minhash, pii, spelling, substrings, tokencount, toxicity, transducer, urls


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.gif_features(gif.with_gif(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"), usable=toxicity.LEARNABLE)
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))
    scored = toxicity.with_toxicity(docs, net)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.with_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.coalesce(F.regexp_count("base", F.lit(f"{kind}:")), F.lit(0)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), "spans")


def op4_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return langmodel.score(docs, langmodel.fit(docs, table(spark, sf_dir, "labels")))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict", "score")


def op6_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents")).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.edit_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = transducer.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    same = F.coalesce("decoded", F.lit("")) == F.translate(F.coalesce("text", F.lit("")), "\u2581", " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), F.xxhash64("ids").alias("ids_hash"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), same.alias("round_trip"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    held_out = F.coalesce(remainder == 2, F.lit(False))
    found = hdlang.with_language(docs.select("doc_id", "text"), hdlang.fit(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    n_chars = F.when(changed, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = merkle.manifest(table(spark, sf_dir, "documents").select(*merkle.FIELDS), tampered={"n_chars": n_chars})
    return found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("steps")).alias("proof_sha256"), "folded_root", "verified")


QUERIES = {
    "op1_gif_media": op1_gif_media,
    "op2_toxicity": op2_toxicity,
    "op3_pii_spans": op3_pii_spans,
    "op4_cross_entropy_difference": op4_cross_entropy_difference,
    "op5_url_filter": op5_url_filter,
    "op6_repeat_removal": op6_repeat_removal,
    "op7_token_counts": op7_token_counts,
    "op8_benchmark_decontamination": op8_benchmark_decontamination,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_language_id": op12_language_id,
    "op13_merkle_manifest": op13_merkle_manifest,
}
#: Operator 6: every string of 200 bytes, from the texts' hexadecimal bytes.
REPEATS_SQL = """
with d as (select row_number() over () as k, doc_id, hex(coalesce(text, '')) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
c as (select k, n, j, substring(h, 1024 * j + 1, 1422) as h from (select k, n, h, unnest(range(0, (n + 511) // 512)) as j from d)),
p as (select k, 512 * j + o as i, case when 512 * j + o <= n - 200 then md5_number(substring(h, 2 * o + 1, 400)) end as w, substring(h, 2 * o + 1, 2) as b from (select *, unnest(range(0, least(512, n - 512 * j))) as o from c)),
r as (select k, i, b, max(case when again then i end) over (partition by k order by i) > i - 200 as gone from (select *, w is not null and count(*) over (partition by w) > 1 as again from p)),
e as (select *, coalesce(gone, false) as g, coalesce(gone, false) and not coalesce(lag(gone) over (partition by k order by i), false) as first from r),
t as (select k, count(*) filter (where g) as n_removed, count(*) filter (where first) as n_spans, coalesce(string_agg(b, '' order by i) filter (where not g), '') as kept from e group by k)
select doc_id, n as n_bytes, coalesce(n_removed, 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, ''))) as kept_sha256 from d left join t using (k)
"""
#: Operator 9: all pairs of documents that share a shingle.
NEAR_SQL = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as x from documents),
s as (select distinct doc_id, md5_number(g) as g from (select doc_id, unnest(case when len(x) = 0 then [] when len(x) < 3 then [array_to_string(x, ' ')] else list_transform(range(1, len(x) - 1), lambda i: x[i] || ' ' || x[i + 1] || ' ' || x[i + 2]) end) as g from w)),
n as (select doc_id, count(*) as n from s group by 1),
c as (select a.doc_id as a, b.doc_id as b, count(*) as shared from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from c join n x on x.doc_id = a join n y on y.doc_id = b where 100 * shared >= 85 * (x.n + y.n - shared)),
l as (select a, b from e union select b, a from e),
r as (select a, b from l union select r.a, l.b from r join l on l.a = r.b),
m as (select a as doc_id, min(b) as least from r group by 1)
select doc_id, coalesce(n.n, 0) as n_shingles, least(doc_id, coalesce(m.least, doc_id)) as component_id, doc_id <= coalesce(m.least, doc_id) as kept from w left join n using (doc_id) left join m using (doc_id)
"""


def _crc32(x: str) -> str:
    """SQL for the unsigned CRC-32 of a string's UTF-8 bytes."""
    octets = f"list_transform(range(cast(strlen({x}) as bigint)), lambda i: cast('0x' || substring(hex({x}), 2 * i + 1, 2) as bigint))"
    step = "list_reduce(list_prepend(xor(c, b), range(8)), lambda e, j: case when e & 1 = 1 then xor(e >> 1, 3988292384) else e >> 1 end)"
    return f"xor(list_reduce(list_prepend(4294967295, {octets}), lambda c, b: {step}), 4294967295)"


#: Operator 11: words without one code point, joined.
SPELLING_SQL = f"""
with recursive r as (select coalesce(cast(doc_id as varchar), '') || ':' || w as x, w, count(*) as n from (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as w from documents) group by all),
h as (select w, n, {_crc32("x")} as h from r),
v as (select word, cast(sum(n) as bigint) as n from (select n, case when h % 31 = 0 then substring(w, 1, h % length(w)) || substring(w, h % length(w) + 2) else w end as word from h) where length(word) >= 7 group by 1 having sum(n) >= 2),
less as (select word, n, i, substring(word, 1, i) || substring(word, i + 2) as d from (select *, unnest(range(length(word))) as i from v)),
near as (select a.word, b.word as near, b.n as near_n from less a join less b on a.i = b.i and a.d = b.d and a.word <> b.word
  union select a.word, b.word, b.n from less a join v b on a.d = b.word union select b.word, a.word, a.n from less a join v b on a.d = b.word),
best as (select word, count(*) as n_near, min({{'m': -near_n, 'w': near}}) as b from near group by 1),
f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when -b.m >= 10 * v.n then b.w end as form, case when -b.m >= 10 * v.n then -b.m end as form_n from v left join best using (word)),
chain as (select word, word as root, n from f union all select c.word, f.form, f.form_n from chain c join f on f.word = c.root where f.form is not null)
select word, form, root, n, n_near, form_n from f join (select word, max({{'n': n, 'r': root}}).r as root from chain group by 1) using (word)
"""


def _field(c: str) -> str:
    return f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')"


#: Operator 13: the trees level by level, then every leaf's way up.
MERKLE_SQL = f"""
with recursive d as (select doc_id, coalesce('1' || lang, '0') as name, sha256({" || ".join(map(_field, merkle.FIELDS))}) as leaf,
  sha256({" || ".join(_field(f"(n_chars + case when {_crc32('cast(doc_id as varchar)')} % 7 = 0 then 1 else 0 end)" if c == "n_chars" else c) for c in merkle.FIELDS)}) as changed from documents),
l as (select *, row_number() over (partition by name order by doc_id nulls first, leaf, changed) - 1 as p, count(*) over (partition by name) as n from d),
t(name, k, p, n, h) as (select name, 0, p, n, leaf from l union all select name, k + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' order by p)) from t where n > 1 group by name, k, n, p // 2),
s as (select name, h as subroot, row_number() over (order by name) - 1 as p, count(*) over () as n from t where n = 1),
u(name, k, p, n, h) as (select '', 0, p, n, subroot from s union all select name, k + 1, p // 2, (n + 1) // 2, sha256(string_agg(h, '' order by p)) from u where n > 1 group by name, k, n, p // 2),
way(name, id, k, p, n, folded, proof) as (select name, p, 0, p, n, changed, '' from l union all
  select w.name, id, w.k + 1, w.p // 2, (w.n + 1) // 2, case when b.h is null then sha256(folded) when w.p % 2 = 1 then sha256(b.h || folded) else sha256(folded || b.h) end, proof || coalesce(b.h, '')
  from way w left join t b on b.name = w.name and b.k = w.k and b.p = xor(w.p, 1) where w.n > 1),
top(name, id, k, p, n, folded, proof) as (select w.name, id, 0, s.p, s.n, folded, proof from way w join s on s.name = w.name where w.n = 1 union all
  select w.name, id, w.k + 1, w.p // 2, (w.n + 1) // 2, case when b.h is null then sha256(folded) when w.p % 2 = 1 then sha256(b.h || folded) else sha256(folded || b.h) end, proof || coalesce(b.h, '')
  from top w left join u b on b.k = w.k and b.p = xor(w.p, 1) where w.n > 1)
select doc_id, leaf, subroot, u.h as root, sha256(proof) as proof_sha256, folded as folded_root, folded = u.h as verified
from top join l on l.name = top.name and l.p = top.id join s on s.name = top.name cross join (select h from u where n = 1) u where top.n = 1
"""
#: What SQL can say about whole tables; models, codecs and tokenisers have none.
ORACLE_SQL: dict[str, str] = {"op6_repeat_removal": REPEATS_SQL, "op9_minhash_near_dedup": NEAR_SQL, "op11_spelling_variants": SPELLING_SQL, "op13_merkle_manifest": MERKLE_SQL}
