"""Token counts by offset-mapped attribution.

A whole document is encoded once.  The tokens' character spans are interval-joined
to the spans of its fields (the first line and the rest), of its lines and of
blocks of fixed length.  A token that crosses a boundary goes, by ``rule``, to the
part that holds its first character (``start``), its last one (``end``) or most of
its characters (``majority``; of equal parts to the first).  Every token is
counted exactly once in each of the three divisions.

Cases: null and empty texts have no tokens and no parts; a text that ends in a
line feed has no empty last line; equal texts get equal counts; texts of any
length are encoded whole; tables may be empty and may have other columns, which
pass through.  The vocabulary file's path is a parameter; the driver reads it.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .work import small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the vocabulary's texts are split before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK = 1000
RULES = ("start", "end", "majority")


@functools.cache
def encoding(data: bytes, pattern: str = PATTERN):
    """The encoder and each token's length in bytes."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
    sizes = np.zeros(max(ranks.values(), default=-1) + 1, np.int64)
    for token, i in ranks.items():
        sizes[i] = len(token)
    return tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), sizes


#: Fixed value: what the pattern takes for white space, in runs that its look-ahead can't hold on the encoder's stack.
LONG_BLANK = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def encode(text: str, encoder) -> list[int]:
    """The tokens of ``text``; a very long run of white space, up to the character before what follows, is one piece of the pattern and is merged alone."""
    out, at = [], 0
    for run in LONG_BLANK.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoder.encode_ordinary(text[at : run.start()]) + encoder._encode_single_piece(text[run.start() : end])
        at = end
    return out + encoder.encode_ordinary(text[at:])


def spans(text: str, coder) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of the tokens of ``text``; a token that holds part of a character's bytes spans that character."""
    encoder, sizes = coder
    end = np.cumsum(sizes[np.array(encode(text, encoder), np.int64)])
    if not len(end):
        return end, end
    start = np.concatenate([[0], end[:-1]])
    if len(text) == end[-1]:
        return start, end
    lead = np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)
    return lead[start] - 1, lead[end - 1]


def attribute(start: np.ndarray, end: np.ndarray, cuts: np.ndarray, rule: str = "start") -> tuple[np.ndarray, int]:
    """Tokens in each part [cuts[i], cuts[i+1]), and how many cross a boundary."""
    first = np.searchsorted(cuts, start, "right") - 1
    last = np.searchsorted(cuts, end - 1, "right") - 1
    crossing = np.flatnonzero(first != last)
    own = first if rule != "end" else last
    if rule == "majority":
        own = first.copy()
        for t in crossing:
            parts = np.arange(first[t], last[t] + 1)
            own[t] = parts[np.argmax(np.minimum(cuts[parts + 1], end[t]) - np.maximum(cuts[parts], start[t]))]
    return np.bincount(own, minlength=len(cuts) - 1), len(crossing)


def divisions(text: str, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries of the fields (two, the second may be empty), the lines and the blocks of a text that isn't empty."""
    n, at, feeds = len(text), text.find("\n"), []
    while at >= 0:
        feeds.append(at + 1)
        at = text.find("\n", at + 1)
    lines = np.array([0, *feeds] if feeds and feeds[-1] == n else [0, *feeds, n])
    return np.array([0, feeds[0] if feeds else n, n]), lines, np.append(np.arange(0, n, block), n)


def count(df: DataFrame, text: str = "text", path: str = VOCABULARY, rule: str = "start", block: int = BLOCK) -> DataFrame:
    """Adds ``n_tokens``, ``title_tokens``, ``body_tokens``, ``line_tokens``, ``block_tokens`` (arrays in order), ``lines_crossed`` and ``blocks_crossed``."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    small_batches(df.sparkSession)
    with open(path, "rb") as f:
        data = f.read()
    new = {"n_tokens": (pa.int64(), T.LongType()), "title_tokens": (pa.int64(), T.LongType()), "body_tokens": (pa.int64(), T.LongType()), "line_tokens": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), "block_tokens": (pa.list_(pa.int32()), T.ArrayType(T.IntegerType())), "lines_crossed": (pa.int64(), T.LongType()), "blocks_crossed": (pa.int64(), T.LongType())}
    names = [c for c in df.columns if c not in new]

    def one(t: str | None, coder) -> tuple:
        if not t:
            return 0, 0, 0, [], [], 0, 0
        start, end = spans(t, coder)
        fields, lines, blocks = divisions(t, block)
        f, _ = attribute(start, end, fields, rule) if fields[1] < fields[2] else (np.array([len(start), 0]), 0)
        by_line, lines_crossed = attribute(start, end, lines, rule)
        by_block, blocks_crossed = attribute(start, end, blocks, rule)
        return len(start), int(f[0]), int(f[1]), by_line.astype(np.int32), by_block.astype(np.int32), lines_crossed, blocks_crossed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(data)
        for b in batches:
            rows = list(zip(*(one(t.as_py(), coder) for t in b.column(names.index(text))), strict=True)) or [()] * len(new)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(v, k) for v, (k, _) in zip(rows, new.values(), strict=True))], names=[*names, *new])

    plain = df.select(*names)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, *(T.StructField(n, k) for n, (_, k) in new.items())]))
