"""Language identification with hyperdimensional profiles.

Every letter, and the gap between words, has a random vector of +1 and -1 that follows from
its code point.  An n-gram's vector binds its letters: their vectors, each permuted once for
every place that it stands before the last, multiplied element by element.  A text's vector
bundles (sums) its n-grams' vectors, a language's prototype those of all its texts.
A text takes the language whose prototype has the largest cosine with its vector.

Letters are lower-cased code points of Unicode's letter classes; whatever lies between two
letters is one gap, and a gap stands before the first and behind the last letter.  Sums are of whole
numbers, so neither order nor partitions change a prototype.  Null texts and texts without
letters are ``und`` with score 0; so is every text if nothing could be learned.  Texts may be of any length;
ties go to the smallest language; repeated rows count again; other columns stay, and those
named ``lang_pred`` or ``score`` are replaced; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .work import Work

#: Elements of a vector, and letters of an n-gram.
DIM, LETTERS = 1024, 3
#: Languages at most; more are an error, since prototypes go to every task.
MOST = 1_000
UNKNOWN = "und"
#: Code points that are taken at once, and distinct n-grams whose vectors are.
CHUNK, GRAMS = 1 << 17, 4_096
#: Texts of one training row; partial sums of that many languages are kept in a task.
KEPT = 256


@cache
def _folded() -> np.ndarray:
    """For every code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


class Letters:
    """The letters' vectors, made when a letter is first met."""

    def __init__(self, dim: int, n: int):
        self.dim, self.n = dim, n
        self.row: dict[int, int] = {}
        self.turned = [np.zeros((0, dim), np.int8) for _ in range(n)]

    def vectors(self, grams: np.ndarray) -> np.ndarray:
        """Bound vectors of n-grams, whose letters are a matrix's rows."""
        new = [c for c in np.unique(grams).tolist() if c not in self.row]
        if new:
            drawn = np.stack([np.random.Generator(np.random.PCG64([c, 20])).integers(0, 2, self.dim, dtype=np.int8) * 2 - 1 for c in new])
            for c in new:
                self.row[c] = len(self.row)
            self.turned = [np.concatenate([old, np.roll(drawn, self.n - 1 - i, axis=1)]) for i, old in enumerate(self.turned)]
        found, where = np.unique(grams, return_inverse=True)
        at = np.array([self.row[c] for c in found.tolist()])[where.reshape(grams.shape)]
        out = self.turned[0][at[:, 0]]
        for i in range(1, self.n):
            out = out * self.turned[i][at[:, i]]
        return out


def _windows(codes: np.ndarray, owner: np.ndarray, carry: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-grams (a row each), the text of each, and what the next piece of the last text starts with.

    ``codes`` are folded code points; ``carry`` holds the last symbols of the piece before.
    """
    if not len(codes):
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64), carry
    before = np.empty_like(codes)
    before[1:] = codes[:-1]
    before[0] = carry[-1] if len(carry) else 1
    first = np.flatnonzero(np.diff(owner)) + 1
    before[first] = 1
    keep = (codes > 0) | (before > 0)  # of a gap only its first symbol
    seq = np.concatenate([carry, codes[keep]])
    who = np.concatenate([np.full(len(carry), owner[0]), owner[keep]])
    m = len(seq) - n + 1
    if m <= 0:
        return np.zeros((0, n), np.int64), np.zeros(0, np.int64), seq
    rows = np.flatnonzero(who[:m] == who[n - 1 :])
    return np.stack([seq[rows + i] for i in range(n)], axis=1), who[rows], seq[max(0, len(seq) - n + 1) :]


def _ngrams(texts: list[str | None], n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """N-grams and their texts' numbers, for some texts or a piece of a long one at a time."""
    none = np.zeros(0, np.int64)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK):
            size += len(texts[j] or "")
            j += 1
        # a gap on both sides of each text
        joined = "".join(f"\n{t or ''}\n" for t in texts[i:j])
        owner = np.repeat(np.arange(i, j), [len(t or "") + 2 for t in texts[i:j]])
        carry = none
        for at in range(0, len(joined), CHUNK):
            piece = joined[at : at + CHUNK]
            codes = _folded()[np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)]
            mine = owner[at : at + len(piece)]
            grams, who, carry = _windows(codes, mine, carry if at and owner[at - 1] == mine[0] else none, n)
            yield grams, who
        i = j


def bundles(texts: list[str | None], owner: np.ndarray, rows: int, letters: Letters) -> np.ndarray:
    """For each of ``rows`` owners the sum of the vectors of all n-grams of its texts (``owner``: each text's)."""
    out = np.zeros((rows, letters.dim), np.int64)
    for grams, who in _ngrams(texts, letters.n):
        if not len(grams):
            continue
        key = grams[:, 0]
        for i in range(1, letters.n):
            key = key * 0x110000 + grams[:, i]
        _, first, place = np.unique(key, return_index=True, return_inverse=True)
        mine, row = np.unique(owner[who], return_inverse=True)
        for at in range(0, len(first), GRAMS):
            part = first[at : at + GRAMS]
            inside = (place >= at) & (place < at + GRAMS)
            counts = np.bincount(row[inside] * len(part) + place[inside] - at, minlength=len(mine) * len(part)).reshape(len(mine), len(part))
            # whole numbers far below 2**24: exact in single precision
            out[mine] += (counts.astype(np.float32) @ letters.vectors(grams[part]).astype(np.float32)).astype(np.int64)
    return out


def fit(df: DataFrame, usable: Column | None = None, lang: str = "lang", text: str = "text", dim: int = DIM, n: int = LETTERS) -> dict[str, np.ndarray]:
    """Each language's prototype, of unit length, from all rows (those that ``usable`` holds) with a language and a letter.

    A prototype is 64-bit integers summed by Spark; only the sums, at most ``MOST`` times
    ``dim`` numbers, come to the driver.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, kept = Letters(dim, n), {}

        def row() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array([v.tolist() for v in kept.values()], pa.list_(pa.int64()))], names=["lang", "v"])
            kept.clear()
            return out

        for b in batches:
            names = b.column(0).dictionary_encode()
            found = bundles(b.column(1).to_pylist(), np.asarray(names.indices), len(names.dictionary), letters)
            for name, v in zip(names.dictionary.to_pylist(), found, strict=True):
                if v.any():
                    kept[name] = kept.get(name, 0) + v
                if len(kept) >= KEPT:
                    yield row()
        if kept:
            yield row()

    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull())
    if usable is not None:
        rows = rows.filter(usable)
    Work(df.sparkSession)  # small Arrow batches
    parts = rows.select(F.col(lang).alias("lang"), F.col(text).alias("text")).mapInArrow(sums, "lang string, v array<bigint>")
    total = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    found = total.groupBy("lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("v")).orderBy("lang").limit(MOST + 1).collect()
    if len(found) > MOST:
        raise ValueError(f"more than {MOST} languages")
    unit = lambda v: v / max(float(np.sqrt((v * v).sum())), 1e-300)
    return {r.lang: unit(np.array(r.v, np.float64)) for r in found}


def with_language(df: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text", n: int = LETTERS) -> DataFrame:
    """Adds ``lang_pred`` and ``score``, the cosine with that language's prototype (0 where it is negative)."""
    names = sorted(prototypes, key=lambda s: s.encode())
    matrix = np.stack([prototypes[k] for k in names]) if names else np.zeros((0, DIM))
    Work(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast((names, matrix))  # at most MOST prototypes
    kept = [c for c in df.columns if c not in ("lang_pred", "score")]
    at = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value
        letters = Letters(matrix.shape[1], n)
        for b in batches:
            texts = b.column(at).to_pylist()
            v = bundles(texts, np.arange(len(texts)), len(texts), letters).astype(np.float64)
            norm = np.sqrt((v * v).sum(axis=1))
            if names:
                # rounded, so that equal cosines tie wherever the text stands in a batch
                cos = np.round((v @ matrix.T) / np.maximum(norm, 1e-300)[:, None], 9)
                best = cos.argmax(axis=1)
                score = np.clip(cos[np.arange(len(best)), best], 0.0, 1.0)
            else:
                best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            known = (norm > 0) & bool(names)
            pred = [names[i] if k else UNKNOWN for i, k in zip(best.tolist(), known.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], schema=pa.schema([*b.schema, pa.field("lang_pred", pa.string()), pa.field("score", pa.float64())]))

    fields = df.select(*kept)
    return fields.mapInArrow(run, StructType([*fields.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())]))
