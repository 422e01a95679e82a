"""Benchmark decontamination by pigeonhole edit matching.

A test item of L normalised bytes may occur in a document with up to
k = floor(error_rate * L) edits.  The item is split into k+1 pieces: one of them
must then occur unchanged.  One Aho-Corasick pass over a document finds all piece
hits, and Myers' bit-parallel distance checks the text around each hit.

Normalised: UTF-8 bytes with A-Z lower-cased and runs of ASCII white space and
punctuation as one space.  Cases: null or empty texts match nothing; items whose
normalised form has fewer than ``min_item`` bytes are found unchanged (budget 0) and
at word boundaries only, items without any byte never; repeated items are reported
each under its own id; items with a null id or text are left out; an empty table of
either kind gives an empty result.  Each row of the result is the best match of one
item in one document (smallest distance, then first end).

Items are dealt into blocks of about ``BLOCK_BYTES``.  A block is on the driver only
while it becomes a broadcast, which Spark keeps on disk and executors fetch when a task
of that block starts, so a benchmark of any size takes as many passes over the documents
as it has blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .work import Work, small_batches

ERROR_RATE = 0.05
MIN_ITEM = 20
#: Normalised bytes of test items that are searched for in one pass; more items take more passes.
BLOCK_BYTES = 16 << 20
_TABLE = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 128 and not chr(c).isalnum() else c for c in range(256))


def normalise(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split())


def pieces(item: bytes, k: int) -> list[tuple[int, bytes]]:
    """k+1 consecutive pieces of nearly equal length, each with its offset."""
    n = len(item)
    cuts = [n * j // (k + 1) for j in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


class Myers:
    """Smallest edit distance of a pattern to any substring of a text."""

    def __init__(self, pattern: bytes):
        self.m = len(pattern)
        self.masks: dict[int, int] = {}
        for i, c in enumerate(pattern):
            self.masks[c] = self.masks.get(c, 0) | 1 << i

    def best(self, text: bytes, k: int) -> tuple[int, int] | None:
        """(distance, end) of the best match of at most k edits, the first of several."""
        if not self.m:
            return 0, 0
        full, top, get = (1 << self.m) - 1, 1 << (self.m - 1), self.masks.get
        pv, mv, score, found, left = full, 0, self.m, None, len(text)
        for j, c in enumerate(text):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & full
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            left -= 1
            if score <= k:
                found, k = (score, j + 1), score - 1
                if not score:
                    break
            elif score - left > k:
                break
            ph = ph << 1 & full
            mh = mh << 1 & full
            pv = mh | ~(xv | ph) & full
            mv = ph & xv
        return found


class Matcher:
    """Finds all items of one block in normalised texts."""

    def __init__(self, items: list[tuple[int, bytes]], error_rate: float = ERROR_RATE, min_item: int = 1):
        self.items = [(i, x, int(len(x) * error_rate) if len(x) >= min_item else 0) for i, x in items]
        self.min_item = min_item
        self.myers: dict[int, Myers] = {}
        table: dict[str, list[tuple[int, int]]] = {}
        for at, (_, x, k) in enumerate(self.items):
            for offset, piece in pieces(x, k):
                table.setdefault(piece.decode("latin-1"), []).append((at, offset + len(piece)))
        self.automaton = ahocorasick.Automaton()
        for piece, where in table.items():
            self.automaton.add_word(piece, where)
        if table:
            self.automaton.make_automaton()
        self.empty = not table

    def find(self, text: bytes) -> list[tuple[int, int, int, int]]:
        """(item id, distance, end of the match in the text, edit budget), one for each item that occurs."""
        if self.empty or not text:
            return []
        starts: dict[int, list[int]] = {}
        for end, where in self.automaton.iter(text.decode("latin-1")):
            for at, offset in where:
                starts.setdefault(at, []).append(end + 1 - offset)
        out = []
        for at, diagonals in starts.items():
            item, pattern, k = self.items[at]
            n, best = len(pattern), None
            if n < self.min_item:
                whole = [d for d in diagonals if text[d - 1 : d] in (b"", b" ") and text[d + n : d + n + 1] in (b"", b" ")]
                if whole:
                    out.append((item, 0, min(whole) + n, 0))
                continue
            exact = text.find(pattern) if any(text.startswith(pattern, d) for d in diagonals if d >= 0) else -1
            if exact >= 0:
                out.append((item, 0, exact + n, k))
                continue
            diagonals.sort()
            spans: list[list[int]] = []
            for d in diagonals:
                a, b = max(0, d - k), min(len(text), d + n + k)
                if spans and a <= spans[-1][1] - n:
                    spans[-1][1] = max(b, spans[-1][1])
                else:
                    spans.append([a, b])
            for a, b in spans if k else []:
                if at not in self.myers:
                    self.myers[at] = Myers(pattern)
                hit = self.myers[at].best(text[a:b], k if best is None else best[0] - 1)
                if hit:
                    best = (hit[0], a + hit[1])
            if best:
                out.append((item, *best, k))
        return out


def _blocks(texts: DataFrame) -> Iterator[list[tuple[int, bytes]]]:
    """The distinct texts (``k, t``) in blocks of bounded size; only one is on the driver at a time."""
    total = texts.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = int(total // BLOCK_BYTES) + 1
    for b in range(n):
        part = texts if n == 1 else texts.filter(F.pmod(F.xxhash64("t"), F.lit(n)) == b)
        yield sorted((r.k, normalise(r.t)) for r in part.collect())


def edit_matches(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", error_rate: float = ERROR_RATE, min_item: int = MIN_ITEM) -> DataFrame:
    """``doc_id, item_id, distance, match_end, budget`` for every item within its edit budget in a document."""
    small_batches(docs.sparkSession)
    work = Work(docs.sparkSession)
    out = None
    names = ["doc_id", "item_id", "distance", "match_end", "budget"]
    listed = items.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).dropna()
    # repeated texts are sought once, under a number of their own
    texts = work.save(listed.select("t").distinct().withColumn("k", F.monotonically_increasing_id()))
    for block in _blocks(texts):
        wanted = docs.sparkSession.sparkContext.broadcast([(i, x) for i, x in block if x])
        del block

        def run(batches: Iterator[pa.RecordBatch], wanted=wanted) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(wanted.value, error_rate, min_item)
            for b in batches:
                rows = [(d, *m) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for m in matcher.find(normalise(t))]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in (list(zip(*rows, strict=True)) or [()] * 5)], names=names)

        part = docs.select(F.col(doc_id).cast("long"), F.col(text)).mapInArrow(run, ", ".join(f"{n} bigint" for n in names))
        out = part if out is None else out.unionByName(part)
    return out.withColumnRenamed("item_id", "k").join(listed.join(texts, "t").select("k", F.col("i").alias("item_id")), "k").select(*names)


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the documents that hold a test item."""
    hit = edit_matches(docs, items, **options).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti")
