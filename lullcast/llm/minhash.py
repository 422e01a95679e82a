"""MinHash near-duplicates with sequential Bayesian verification.

Documents with equal shingle sets are one class from the start.  Of each other
class the representative's signature is cut into bands; documents that share a
band are candidates.  A bucket's members are first held against its most central one.
Candidates' signatures are compared batch by batch, and a pair is dropped once the
posterior probability that its similarity reaches the threshold (uniform prior)
falls below ``MISS``.  What survives is verified on the full shingle sets.  Then
the documents of buckets whose members are still in different components, and only
those, are clustered by their rarest shingles (``_rare_first``, an exact filter), and
a cluster's documents take the same two tests, block by block.  So no link between a bucket's members is
lost, and a group of copies never makes all its pairs.

Words: A-Z lower-cased, maximal runs of other bytes than space and \\x09-\\x0D.  A
document's set has its distinct ``k``-word shingles; with fewer words the whole
sequence is the one shingle; null texts and texts without words have an empty set
and are linked with nothing.  Rows with a null id are their own (null) component.
Rows are linked by their texts alone: rows that share an id but no similar text may lie in
different components, each with the smallest id that its row reaches, and equal rows get
equal results.  Empty tables and other columns are allowed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import textvec as tv
from .work import Work, components

#: Words of a shingle and least similarity, in hundredths, where no contract says otherwise.
WORDS, PERCENT = 5, 80
ROWS = 5
#: The chance that bands, and that the posterior bound, miss a pair at the threshold.
MISS = 1e-7
BATCH = 20
#: Signature values that tell how central a bucket's member is.
CENTRAL = 16
#: Ids at most that are broadcast.
BROADCAST_ROWS = 1_000_000
#: Documents of one block; two blocks meet in a task.
BLOCK = 1024
_IS_WORD = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
_STEP = np.random.Generator(np.random.PCG64(5)).integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bands_for(percent: int, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands at which a pair at the threshold is missed with probability ``miss`` at most."""
    return math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text."""
    buf, offs = tv.utf8(texts)
    for i, j in tv.chunks(offs):
        part = tv.lower_ascii(buf[offs[i] : offs[j]])
        start, end, bound = tv.word_spans(part, offs[i : j + 1] - offs[i], _IS_WORD)
        words = tv.span_hash(tv.prefix_hash(part), start, end)
        shingles = np.zeros(max(0, len(words) - k + 1), np.uint64)
        for s in range(k):
            shingles += words[s : len(words) - k + 1 + s] * _STEP[s] if len(shingles) else 0
        shingles = tv.mix(shingles)
        for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(shingles[a : b - k + 1])
            elif b > a:
                yield tv.mix(np.array([int((words[a:b] * _STEP[: b - a]).sum()) + 1 + b - a & (1 << 64) - 1], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def signature(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    out = np.full(len(factors), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        np.minimum(out, ((factors[:, None] * part[None, :]) >> np.uint64(32)).astype(np.uint32).min(axis=1), out=out)
    return out


def factors(n: int, seed: int = 11) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_matches(n: int, percent: int, miss: float = MISS) -> int:
    """The fewest matches among ``n`` hashes at which P(similarity >= threshold | matches), under a uniform prior, is at least ``miss``."""
    # Beta(m+1, n-m+1) survival at t is P(Binomial(n+1, t) <= m)
    t, total = percent / 100, 0.0
    for m in range(n + 1):
        total += math.comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if total >= miss:
            return m
    return n


def signatures(df: DataFrame, k: int, n_hashes: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n, h1, h2, sig``: set size, set digest and signature (32-bit values) of every row."""
    f = factors(n_hashes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, h1, h2, sig = [], [], [], []
            for s in shingle_sets(b.column(1), k):
                n.append(len(s))
                h1.append(s.sum(dtype=np.uint64).view(np.int64))
                h2.append(tv.mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64).view(np.int64))
                sig.append(signature(s, f).tobytes() if len(s) else b"")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n", "h1", "h2", "sig"])

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, "doc_id bigint, n bigint, h1 bigint, h2 bigint, sig binary")


def _likely(pairs: DataFrame, reps: DataFrame, percent: int, n_hashes: int) -> DataFrame:
    """Of ``pairs (a, b)`` those that the posterior bound keeps."""
    stops = [(n, least_matches(n, percent)) for n in range(BATCH, n_hashes + 1, BATCH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint32).reshape(b.num_rows, n_hashes) for c in (2, 3))
            live, matches, done = np.arange(b.num_rows), np.zeros(b.num_rows, np.int64), 0
            for n, least in stops:
                matches = matches + (x[live, done:n] == y[live, done:n]).sum(axis=1)
                live, matches, done = live[matches >= least], matches[matches >= least], n
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(live)), b.column(1).take(pa.array(live))], names=["a", "b"])

    left = reps.select(F.col("doc_id").alias("a"), F.col("sig").alias("x"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("sig").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a bigint, b bigint")


def _chosen(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The listed documents; a list of at most ``BROADCAST_ROWS`` ids is broadcast, a longer one joined by a shuffle."""
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(ids) if small else ids, "doc_id", "left_semi")


def _rare_first(open_: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int, n_hashes: int, work: Work) -> DataFrame:
    """Links ``a, b`` between open documents (``doc_id, n, c``) of different components.

    With shingles in one order, the rarest among the open documents first, two sets that
    reach it share one of their first n - ceil(percent * n / 100) + 1 shingles.  What only
    one document has takes a place there but links nothing, and bounds what a pair can have
    in common, so copies that each differ from all others too much make no pair.
    """

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 200):
                part = b.slice(at, 200)
                found = list(shingle_sets(part.column(1), k))
                rows = np.repeat(np.arange(part.num_rows), [len(s) for s in found])
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64))], names=["doc_id", "s"])

    rows = work.save(_chosen(docs, open_.select("doc_id")).mapInArrow(sets, "doc_id bigint, s bigint").distinct())
    often = rows.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    shared = rows.join(often, "s")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy("f", "s"))
    alone = F.col("n") - F.count("*").over(W.partitionBy("doc_id"))
    length = F.col("n") - F.ceil(F.col("n") * percent / 100.0 - 1e-9) + 1
    heads = shared.withColumn("place", place).join(open_, "doc_id").withColumn("alone", alone).filter(F.col("place") + F.col("alone") <= length)
    heads = work.save(heads.select("s", "doc_id", "n", "c", (F.col("n") - F.col("alone")).alias("m")))
    mixed = heads.groupBy("s").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("s")
    heads = heads.join(mixed, "s", "left_semi")
    # all pairs to try lie within a cluster of documents that share such shingles
    near = work.save(heads.join(heads.groupBy("s").agg(F.min("doc_id").alias("hub")), "s").select(F.col("hub").alias("a"), F.col("doc_id").alias("b")).distinct())
    cluster = components(near, work).withColumnRenamed("node", "doc_id").withColumnRenamed("component", "k")
    blocks = cluster.groupBy("k").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    blk = F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int")
    dealt = cluster.join(blocks, "k").withColumn("blk", blk).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select("doc_id", "k", "blk", F.least("blk", "o").alias("bi"), F.greatest("blk", "o").alias("bj"))
    facts = heads.select("doc_id", "n", "c", "m").distinct().join(reps.select("doc_id", "sig"), "doc_id")
    full = _chosen(docs, cluster.select("doc_id")).mapInArrow(_packed(k), "doc_id bigint, s binary")
    out = work.save(dealt.join(work.save(facts.join(full, "doc_id")), "doc_id").groupBy("k", "bi", "bj").applyInArrow(_block_links(percent, n_hashes), "a bigint, b bigint").distinct())
    work.drop(rows, near)
    return out


def _packed(k: int):
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), k)], pa.binary())], names=["doc_id", "s"])

    return sets


def _block_links(percent: int, n_hashes: int):
    """Links between two blocks of a cluster: bounds, then the sequential test, then full sets; only links leave it."""
    stops = [(n, least_matches(n, percent)) for n in range(BATCH, n_hashes + 1, BATCH)]

    def run(t: pa.Table) -> pa.Table:
        col = lambda c: t.column(c).combine_chunks()
        ids, n, c, m, blk, bi, bj = (np.asarray(col(x)) for x in ("doc_id", "n", "c", "m", "blk", "bi", "bj"))
        sig = np.frombuffer(b"".join(col("sig").to_pylist()), np.uint32).reshape(len(ids), n_hashes)
        packed = col("s")
        sets: dict[int, np.ndarray] = {}
        of = lambda i: sets.setdefault(i, np.frombuffer(packed[i].as_py(), np.uint64))
        left, right = np.flatnonzero(blk == bi), np.flatnonzero(blk == bj)
        same = bi[0] == bj[0]
        out: list[tuple[int, int]] = []
        for at, i in enumerate(left.tolist()):
            other = right[at + 1 :] if same else right
            most = np.minimum(m[i], m[other])
            live = other[(c[other] != c[i]) & (most * 100 >= percent * (n[i] + n[other] - most))]
            matches, done = np.zeros(len(live), np.int64), 0
            for stop, least in stops:
                if not len(live):
                    break
                matches = matches + (sig[live, done:stop] == sig[i, done:stop]).sum(axis=1)
                live, matches, done = live[matches >= least], matches[matches >= least], stop
            for j in live.tolist():
                both = len(np.intersect1d(of(i), of(j), assume_unique=True))
                if 100 * both >= percent * (n[i] + n[j] - both):
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j])))
        a, b = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, work: Work) -> DataFrame:
    """Of ``pairs (a, b)`` those whose full sets reach the threshold, with exact counts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both) and both > 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    full = work.save(_chosen(docs, wanted).mapInArrow(_packed(k), "doc_id bigint, s binary"))
    left = full.select(F.col("doc_id").alias("a"), F.col("s").alias("x"))
    right = full.select(F.col("doc_id").alias("b"), F.col("s").alias("y"))
    out = work.save(pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(compare, "a bigint, b bigint").distinct())
    work.drop(full)
    return out


def near_duplicates(df: DataFrame, k: int = WORDS, percent: int = PERCENT, doc_id: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``df``."""
    work = Work(df.sparkSession)
    n_hashes = bands_for(percent, rows) * rows
    docs = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sigs = work.save(signatures(docs, k, n_hashes))
    one = F.struct("h1", "h2", "n")
    ambiguous = sigs.filter("doc_id is not null").groupBy("doc_id").agg(F.min(one).alias("lo"), F.max(one).alias("hi")).filter("lo <> hi")
    if ambiguous.isEmpty():
        return _grouped(docs, sigs, k, percent, rows, work)
    # an id with several texts is no node: number the rows, and name each component by its smallest id
    work.drop(sigs)
    numbered = work.save(docs.withColumn("row", F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())))
    by_row = numbered.select(F.col("row").alias("doc_id"), "text")
    found = work.save(_grouped(by_row, work.save(signatures(by_row, k, n_hashes)), k, percent, rows, work).drop("kept"))
    ids = numbered.filter("row is not null").select(F.col("row").alias("at"), F.col("doc_id").alias("id"))
    rest = found.filter("doc_id is not null").join(ids, F.col("doc_id") == F.col("at")).select("id", "n_shingles", "component_id")
    least = rest.groupBy("component_id").agg(F.min("id").alias("least"))
    known = rest.join(least, "component_id").select(F.col("id").alias("doc_id"), "n_shingles", F.col("least").alias("component_id"), (F.col("id") == F.col("least")).alias("kept"))
    return known.unionByName(found.filter("doc_id is null").withColumn("kept", F.lit(True)))


def _grouped(docs: DataFrame, sigs: DataFrame, k: int, percent: int, rows: int, work: Work) -> DataFrame:
    """The same where rows with equal ids have equal texts."""
    bands = bands_for(percent, rows)
    n_hashes = bands * rows
    linkable = sigs.filter("doc_id is not null and n > 0")
    classes = linkable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"))
    reps = work.save(linkable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc_id"), F.first("sig").alias("sig")).select("doc_id", "n", "sig"))

    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(F.substring(F.col("sig"), i * (4 * rows) + 1, F.lit(4 * rows)), i))
    banded = reps.select(F.col("doc_id").alias("rep"), "n", F.explode(keys).alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = work.save(banded.join(shared, "key", "left_semi").select("key", "rep", "n"))
    # the bucket's member whose hashes most documents share: edited copies lie around it
    values = F.transform(F.sequence(F.lit(0), F.lit(CENTRAL - 1)), lambda i: F.xxhash64(F.substring(F.col("sig"), i * 4 + 1, F.lit(4)), i))
    grouped = members.select("rep").distinct()
    some = work.save(reps.join(grouped.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").select(F.col("doc_id").alias("rep"), F.explode(values).alias("v")))
    central = some.join(some.groupBy("v").agg(F.count("*").alias("f")), "v").groupBy("rep").agg(F.sum(F.log2("f")).alias("mass"))
    placed = members.join(central.withColumn("mass", F.round("mass", 3)), "rep")
    hubs = placed.groupBy("key").agg(F.max(F.struct("mass", (-F.col("rep")).alias("minus"), "n")).alias("h")).select("key", (-F.col("h.minus")).alias("hub"), F.col("h.n").alias("hub_n"))
    fits = lambda m, n: (m * 100 >= n * percent) & (n * 100 >= m * percent)
    first = members.join(hubs, "key").filter((F.col("rep") != F.col("hub")) & fits(F.col("n"), F.col("hub_n"))).select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
    likely = work.save(_likely(first, reps, percent, n_hashes))
    links = _verified(likely, docs, k, percent, work)
    found = components(links, work)

    inside = work.save(members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("c")))
    mixed = inside.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("key")
    open_ = work.save(inside.join(mixed, "key", "left_semi").select(F.col("rep").alias("doc_id"), "n", "c").distinct())
    more = _rare_first(open_, docs, reps, k, percent, n_hashes, work)
    work.drop(members, some, inside, open_, likely, reps)
    final = components(links.unionByName(more), work)

    whole = sigs.select("doc_id", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left").join(final.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("component", "rep", "doc_id")
    return whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
