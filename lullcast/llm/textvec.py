"""Vectorised work on Arrow text columns: no loop over rows or characters in Python.

A batch's texts are one UTF-8 byte array plus offsets; words, hashes and n-grams
are computed over the whole array with numpy.  Null texts are empty texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Hashes are polynomials over the field of this prime, with the bytes plus one as coefficients.
PRIME = np.uint64((1 << 61) - 1)
#: A point for each family of hashes, drawn once: two strings of n bytes agree with a chance of n / PRIME.
_POINTS = [int(x) for x in np.random.Generator(np.random.PCG64(20240229)).integers(1 << 40, (1 << 61) - 1, 2, dtype=np.uint64)]
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_31, _30, _61 = np.uint64(31), np.uint64(30), np.uint64(61)
_LOW31, _LOW30 = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its n+1 offsets into them (both start at 0)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows [i, j) of about ``limit`` bytes; a longer text is a run of its own."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, j
        i = j


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> _61)
    x -= PRIME * (x >= PRIME)
    return x


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products in the field; 2**61 is one there."""
    ah, al, bh, bl = a >> _31, a & _LOW31, b >> _31, b & _LOW31
    mid = ah * bl + al * bh
    return _reduced(((ah * bh) << np.uint64(1)) + (mid >> _30) + ((mid & _LOW30) << _31) + al * bl)


def powers(n: int, family: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a family's point and of its inverse."""
    if family not in _powers or len(_powers[family][0]) <= n:
        size = max(n + 1, 1 << 20)
        found = []
        for x in (_POINTS[family], pow(_POINTS[family], -1, int(PRIME))):
            out, have = np.ones(size, np.uint64), 1
            while have < size:
                out[have : 2 * have] = _times(out[: min(have, size - have)], np.uint64(pow(x, have, int(PRIME))))
                have *= 2
            found.append(out)
        _powers[family] = tuple(found)
    return _powers[family]


class Prefix:
    """Hashes of all prefixes of some bytes, in one family."""

    def __init__(self, values: np.ndarray, family: int):
        self.values, self.family = values, family

    def __len__(self) -> int:
        return len(self.values)


#: Elements that are taken at once, so that what lies between stays in a processor's cache.
_AT_ONCE = 1 << 13


def prefix_hash(buf: np.ndarray, family: int = 0) -> Prefix:
    """Prefix sums from which ``span_hash`` gives the hash of any byte span."""
    out = np.zeros(len(buf) + 1, np.uint64)
    up = powers(len(buf), family)[0]
    for at in range(0, len(buf), _AT_ONCE):
        value = buf[at : at + _AT_ONCE].astype(np.uint64) + np.uint64(1)
        power = up[at : at + len(value)]
        high = value * (power >> _31)
        term = (high >> _30) + ((high & _LOW30) << _31) + value * (power & _LOW31)  # below 2**62
        high, low = np.cumsum(term >> _31), np.cumsum(term & _LOW31)  # of so few terms below 2**45
        out[at + 1 : at + 1 + len(value)] = _reduced((high >> _30) + ((high & _LOW30) << _31) + low + out[at])
    return Prefix(out, family)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def span_hash(prefix: Prefix, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of buf[start:end] for each pair; equal spans have equal hashes wherever they are."""
    values, down = prefix.values, powers(len(prefix), prefix.family)[1]
    out = np.empty(len(start), np.uint64)
    for at in range(0, len(start), _AT_ONCE):
        a, z = start[at : at + _AT_ONCE], end[at : at + _AT_ONCE]
        own = _reduced(values[z] + (PRIME - values[a]))
        out[at : at + len(a)] = mix(_times(own, down[a]) + (z - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of word bytes within each text, and n+1 offsets of the texts into them."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    w = is_word[buf]
    before, after = np.empty_like(w), np.empty_like(w)
    before[1:], before[0] = w[:-1], False
    after[:-1], after[-1] = w[1:], False
    inner = offs[(offs > 0) & (offs < len(buf))]
    before[inner] = False
    after[inner - 1] = False
    start, end = np.flatnonzero(w & ~before), np.flatnonzero(w & ~after) + 1
    return start, end, np.searchsorted(start, offs).astype(np.int64)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[buf]


def lower_latin(buf: np.ndarray) -> np.ndarray:
    """Lower case for A-Z and for the capitals U+00C0..U+00DE in UTF-8."""
    out = lower_ascii(buf)
    if len(out) > 1:
        up = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
        out[up] += 0x20
    return out
