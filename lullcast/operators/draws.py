"""Places drawn by hashes: the middle of each draw, whole, in memory that grows with the root of its length."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashes that are made at once: their words stay in a core's cache.
BLOCK = 32_768
#: Draws of a task, and group sizes that share its hashes.
DRAWS, SIZES = 50, 32
#: Deviations of a draw's middle that are kept on each side; beyond them the draw is made again with all places.
WIDE = 8

_SHIFTS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def hashed(prefix: bytes, first: int, last: int) -> np.ndarray:
    """The first 48 bits of ``md5(prefix || j)`` for the numbers j from ``first`` to ``last``, which have equally many digits."""
    j, digits = np.arange(first, last + 1, dtype=np.int64), len(str(first))
    length = len(prefix) + digits
    if len(str(last)) != digits or length > 55:
        raise ValueError("one MD5 block with digits of one length")
    words: list = [int.from_bytes((prefix + bytes(digits) + b"\x80").ljust(56, b"\0")[4 * i : 4 * i + 4], "little") for i in range(14)] + [8 * length, 0]
    for place in range(length - 1, len(prefix) - 1, -1):
        j, digit = np.divmod(j, 10)
        words[place // 4] = words[place // 4] + ((digit + 48).astype(np.uint32) << np.uint32(8 * (place % 4)))
    a, b, c, d = (np.full(last - first + 1, x, np.uint32) for x in _START)
    f, t = np.empty_like(a), np.empty_like(a)
    for i in range(64):
        if i < 16:
            g = i
            np.bitwise_xor(c, d, out=f), np.bitwise_and(f, b, out=f), np.bitwise_xor(f, d, out=f)
        elif i < 32:
            g = (5 * i + 1) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_and(f, d, out=f), np.bitwise_xor(f, c, out=f)
        elif i < 48:
            g = (3 * i + 5) % 16
            np.bitwise_xor(b, c, out=f), np.bitwise_xor(f, d, out=f)
        else:
            g = 7 * i % 16
            np.invert(d, out=f), np.bitwise_or(f, b, out=f), np.bitwise_xor(f, c, out=f)
        np.add(f, a, out=f)
        if isinstance(words[g], int):
            np.add(f, np.uint32((words[g] + _SINES[i]) % 2**32), out=f)
        else:
            np.add(f, np.uint32(_SINES[i]), out=f), np.add(f, words[g], out=f)
        np.left_shift(f, np.uint32(_SHIFTS[i]), out=t), np.right_shift(f, np.uint32(32 - _SHIFTS[i]), out=f), np.bitwise_or(f, t, out=f)
        np.add(f, b, out=f)
        a, d, c, b, f = d, c, b, f, a
    high, low = (a + np.uint32(_START[0])).byteswap(), (b + np.uint32(_START[1])).byteswap()
    return (high.astype(np.int64) << 16) | (low >> np.uint32(16))


def _blocks(most: int) -> Iterator[tuple[int, int]]:
    """1 to ``most`` in blocks of numbers with equally many digits."""
    first = 1
    while first <= most:
        last = min(most, first + BLOCK - 1, 10 ** len(str(first)) - 1)
        yield first, last
        first = last + 1


def middles(prefix: bytes, sizes: list[int], wide: float = WIDE) -> list[tuple[int, int]]:
    """For each size k, the two middle ones of the k places ``hash(j) % k``, counted from 0."""
    edges = [(max(0, int(k / 2 - wide * math.sqrt(k)) - 1), min(k, int(k / 2 + wide * math.sqrt(k)) + 2)) for k in sizes]
    below, near = [0] * len(sizes), [[] for _ in sizes]
    for first, last in _blocks(max(sizes, default=0)):
        numbers = hashed(prefix, first, last)
        for i, (k, (lo, hi)) in enumerate(zip(sizes, edges, strict=True)):
            if first <= k:
                mine = numbers[: k - first + 1]
                at = mine - mine // k * k
                below[i] += int(np.count_nonzero(at < lo))
                near[i].append(at[(at >= lo) & (at < hi)])
    out = []
    for k, (lo, hi), before, parts in zip(sizes, edges, below, near, strict=True):
        found, places = np.sort(np.concatenate(parts)), ((k - 1) // 2 - before, k // 2 - before)
        if places[0] >= 0 and places[1] < len(found):
            out.append((int(found[places[0]]), int(found[places[1]])))
        else:
            out += middles(prefix, [k], math.sqrt(k))  # all of its places
    return out


def middle_places(sizes: DataFrame, draws: int, seed: int) -> DataFrame:
    """``_b, _k, _lo, _hi`` for each draw b and each number k of ``sizes (_k)``: the middle places of k hashes of (seed, b, j), modulo k.

    The hashes of a draw don't depend on k: sizes share them.  Draws are dealt over tasks.
    """
    every = sizes.agg(F.array_sort(F.collect_set("_k")).alias("_all"))  # one row: different sizes add up to the rows at most
    parts = F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_all") - 1) / SIZES).cast("int")), lambda i: F.slice("_all", i * SIZES + 1, SIZES)))
    chunks = every.filter(F.size("_all") > 0).select(parts.alias("_ks"))
    numbers = sizes.sparkSession.range(1, draws + 1, 1, max(1, -(-draws // DRAWS))).withColumnRenamed("id", "_b")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, ks in zip(batch.column("_b").to_pylist(), batch.column("_ks").to_pylist(), strict=True):
                found = middles(f"{seed}:{b}:".encode(), ks)
                columns = [[b] * len(ks), ks, [lo for lo, _ in found], [hi for _, hi in found]]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["_b", "_k", "_lo", "_hi"])

    return numbers.crossJoin(F.broadcast(chunks)).mapInArrow(each, "_b long, _k long, _lo long, _hi long")
