"""Cross-entropy difference between matched n-gram models.

A target model (documents with a chosen label) and a background model (all
documents) share one vocabulary, every word of the corpus, and one word for what is
in none of its texts.  Both are interpolated bigram models with the same smoothing,
and the background's counts are scaled to the target's number of tokens.  Nothing is
cut, and no count is kept on the driver or broadcast: documents are dealt to chunks
of about ``CHUNK`` bytes, a chunk sends its distinct words and bigrams with their
counts to buckets of the key space, each bucket sums them and sends back to the chunks
that asked what the others add to their counts, and a chunk then scores its documents.  Chunks and buckets
grow in number with the corpus, not in size, and a common key has one entry a chunk.
A document's score is the mean over its words of target loss minus background loss,
in nats: the lower, the closer to the target.

Words and bigrams are known by 64-bit hashes: among 3 billion distinct ones 0.3
pairs are expected to share a count.

Cases: a null or empty text has no words and null losses; without target rows the
target model is uniform over the vocabulary; equal texts get equal scores; texts of
any length are read whole; tables may be empty and may have other columns.  Rows
that share an id share their label.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .work import small_batches

#: Bytes of text in a chunk, about.
CHUNK = 8 << 20
PRIOR = 20.0
#: Labels at most that are broadcast; more of them are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
#: Distinct words at most that a task holds before it passes its counts on.
HELD = 500_000
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])
#: The history at the start of a text.
_START = np.uint64(0x5BD1E995A7C3F1D5)


def word_hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = tv.lower_latin(buf)
    start, end, bound = tv.word_spans(low, offs, _IS_WORD)
    return tv.span_hash(tv.prefix_hash(low), start, end), bound


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order that sorts the keys, where each distinct one starts in it, and each key's place among the distinct ones."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return order, np.flatnonzero(new), back


def _sums(x: np.ndarray, order: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x[order], at, dtype=np.int64) if len(at) else np.zeros(0, np.int64)


def _keys(words: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Keys of the bigrams, one for each word, and then those of the words."""
    before = np.empty_like(words)
    before[1:], before[:1] = words[:-1], _START
    before[bound[:-1][bound[:-1] < len(words)]] = _START
    return np.concatenate([tv.mix(tv.mix(before + np.uint64(1)) + words), words])


def _texts(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    words, bounds, n = [], [np.zeros(1, np.int64)], 0
    buf, offs = tv.utf8(table.column("text"))
    for i, j in tv.chunks(offs):
        w, bound = word_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        words.append(w)
        bounds.append(bound[1:] + n)
        n += len(w)
    return np.concatenate([np.zeros(0, np.uint64), *words]), np.concatenate(bounds)


def _flag(table: pa.Table, name: str) -> np.ndarray:
    return np.asarray(table.column(name).to_numpy(), bool)


def _pack(x: np.ndarray) -> bytes:
    """Numbers, most of them small, in few bytes: all lowest bytes first, then all of the next, compressed."""
    return zstandard.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes(), 1)


def _unpack(data: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(raw.T).view(kind).ravel()


def _read(table: pa.Table, name: str, kind: str) -> list[np.ndarray]:
    return [_unpack(x, kind) for x in table.column(name).to_pylist()]


def _own(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's words and where its texts begin, its distinct keys, how often each is in the target's and in all counted texts, and which of them each word and bigram is."""
    words, bound = _texts(table)
    keys = _keys(words, bound)
    order, at, back = _distinct(keys)
    each = np.diff(bound)
    t, b = (_sums(np.tile(np.repeat(_flag(table, name), each), 2), order, at) for name in ("hit", "counted"))
    return words, bound, keys[order][at], t, b, back


def _ask(buckets: int):
    """The chunk's distinct keys (as differences) with their counts in it, one row for each bucket."""

    def run(table: pa.Table) -> pa.Table:
        _, _, keys, t, b, _ = _own(table)
        bucket = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        cut = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(cut))
        pack = lambda x, step: pa.array([_pack(step(x[cut[k] : cut[k + 1]])) for k in some], pa.binary())
        chunk = table.column("chunk")[0].as_py()
        counts = lambda x: x.astype("<i4")
        return pa.table({"chunk": pa.array([chunk] * len(some), pa.int64()), "bucket": pa.array(some, pa.int64()), "keys": pack(keys, lambda x: np.diff(x, prepend=np.uint64(0))), "t": pack(t, counts), "b": pack(b, counts)})

    return run


def _answer(table: pa.Table) -> pa.Table:
    """The bucket's keys summed over all chunks; each chunk gets, in the order of its keys, what the others add to its own counts."""
    keys = [np.cumsum(x, dtype=np.uint64) for x in _read(table, "keys", "<u8")]
    order, at, back = _distinct(np.concatenate([*keys, np.zeros(0, np.uint64)]))
    cut = np.cumsum([0, *map(len, keys)])
    out = []
    for name in ("t", "b"):
        own = np.concatenate([*_read(table, name, "<i4"), np.zeros(0, np.int32)])
        more = (_sums(own, order, at)[back] - own).astype("<i8") if len(own) else own
        out.append(pa.array([_pack(more[i:j]) for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()))
    return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "t": out[0], "b": out[1]})


def _share(words: np.ndarray, total: float, n: int) -> np.ndarray:
    return (words + 0.5) / (total + 0.5 * n)


class Pair:
    """Target (first) and background (second) models of the corpus ``rows``, which has ``doc_id, text, hit``."""

    def __init__(self, docs: DataFrame, rows: DataFrame, names: tuple[str, str]):
        self.docs, self.rows, self.names = docs, rows, names
        self.words = rows.select("text", "hit").mapInArrow(_count_words, "w bigint, t bigint, b bigint, size bigint").groupBy("w").agg(*(F.sum(c).alias(c) for c in ("t", "b", "size")))
        one = self.words.agg(F.count("w").alias("n"), F.sum("t").alias("t"), F.sum("b").alias("b"), F.sum("size").alias("size"), F.sum(F.when(F.col("w").isNull(), F.col("t"))).alias("t0"), F.sum(F.when(F.col("w").isNull(), F.col("b"))).alias("b0")).first()
        # with the unknown word and the start of a text, which is a history too
        self.n, self.size = one.n + 2, one.size or 0
        total = np.array([one.t or 0, one.b or 0], float)
        self.scale = np.array([1.0, total[0] / total[1] if total[0] and total[1] else 1.0])
        self.total, self.starts = total * self.scale, np.array([one.t0 or 0, one.b0 or 0]) * self.scale

    @property
    def uni(self) -> np.ndarray:
        """Shares of the start, the unknown word and all words; collects the vocabulary, so for small corpora."""
        rows = self.words.filter("w is not null").orderBy("w").select("t", "b").toArrow()
        return np.array([_share(np.concatenate([[self.starts[m], 0.0], rows.column(c).to_numpy() * self.scale[m]]), self.total[m], self.n) for m, c in ((0, "t"), (1, "b"))])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts; the row without a word has the texts that have words, and all texts' bytes."""
    words, counts = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64)
    starts, size = np.zeros(2, np.int64), 0
    names = ["w", "t", "b", "size"]
    out = lambda: pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts[0]), pa.array(counts[1]), pa.array(np.zeros(len(words), np.int64))], names=names)
    for batch in batches:
        buf, offs = tv.utf8(batch.column(0))
        hit = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), bool)
        size += len(buf)
        for i, j in tv.chunks(offs, 4 << 20):
            h, bound = word_hashes(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            each = np.diff(bound)
            starts += [int(((each > 0) & hit[i:j]).sum()), int((each > 0).sum())]
            both = np.concatenate([words, h])
            order, at, _ = _distinct(both)
            counts = np.stack([_sums(np.concatenate([counts[0], np.repeat(hit[i:j], each)]), order, at), _sums(np.concatenate([counts[1], np.ones(len(h), np.int64)]), order, at)])
            words = both[order][at]
            if len(words) > HELD:
                yield out()
                words, counts = words[:0], counts[:, :0]
    yield out()
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), *(pa.array([int(x)], pa.int64()) for x in (*starts, size))], names=names)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", target: str = "quality = 1") -> Pair:
    """Both models, counted over all texts; rows of ``labels`` with ``target`` mark the target's documents.

    Bigrams are counted where they are asked for, in ``score``.
    """
    small_batches(docs.sparkSession)
    ids = labels.filter(target).select(F.col(doc_id).alias("doc_id")).dropna().distinct().withColumn("hit", F.lit(True))
    small = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(ids) if small else ids, "doc_id", "left").select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("hit", F.lit(False)).alias("hit"))
    return Pair(docs, rows, (doc_id, text))


def _scorer(models: Pair):
    n, scale, total, starts = models.n, models.scale, models.total, models.starts

    def run(table: pa.Table, back: pa.Table) -> pa.Table:
        words, bound, _, *own_counts, at = _own(table)
        back = back.sort_by("bucket")
        each = np.diff(bound)
        first = bound[:-1][each > 0]
        losses = []
        for m, name in ((0, "t"), (1, "b")):
            total_counts = own_counts[m] + np.concatenate([*_read(back, name, "<i8"), np.zeros(0, np.int64)])
            count = total_counts[at] * scale[m]
            pairs, own = count[: len(words)], count[len(words) :]
            history = np.empty_like(own)
            history[1:] = own[:-1]
            history[first] = starts[m]
            p = (np.minimum(pairs, history) + PRIOR * _share(own, total[m], n)) / (history + PRIOR)
            sums = np.zeros(len(each))
            if len(first):
                sums[each > 0] = np.add.reduceat(-np.log(p), first)
            losses.append(np.round(sums / np.maximum(each, 1), 6))
        none = each == 0
        out = pa.table({"doc_id": table.column("doc_id"), "n_words": pa.array(each), "target_loss": pa.array(losses[0], mask=none), "background_loss": pa.array(losses[1], mask=none), "difference": pa.array(np.round(losses[0] - losses[1], 6), mask=none)})
        return out.filter(pa.array(_flag(table, "wanted")))

    return run


def score(docs: DataFrame, models: Pair, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, target_loss, background_loss, difference`` for every row.

    Other documents than those of ``fit`` are scored beside these, which count again.
    """
    small_batches(docs.sparkSession)
    own = docs is models.docs and (doc_id, text) == models.names
    rows, size = models.rows.withColumns({"counted": F.lit(True), "wanted": F.lit(own)}), models.size
    if not own:
        others = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.lit(False).alias("hit"), F.lit(False).alias("counted"), F.lit(True).alias("wanted"))
        rows, size = rows.unionByName(others), size + (others.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    parts = 1 + size // CHUNK
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("long"))
    asked = rows.groupBy("chunk").applyInArrow(_ask(parts), "chunk bigint, bucket bigint, keys binary, t binary, b binary")
    back = asked.groupBy("bucket").applyInArrow(_answer, "chunk bigint, bucket bigint, t binary, b binary")
    return rows.groupBy("chunk").cogroup(back.groupBy("chunk")).applyInArrow(_scorer(models), "doc_id bigint, n_words bigint, target_loss double, background_loss double, difference double")
