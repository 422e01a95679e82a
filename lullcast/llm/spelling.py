"""Spelling variants: words at an edit distance of one, found in FM indexes of the vocabulary.

The vocabulary is dealt into blocks.  A block's words stand delimited in one text, whose
Burrows-Wheeler transform gives rank intervals.  There are two directions: an index in which a
match grows to the right from the delimiter before a word, and one in which it grows to the
left from the delimiter behind it.  A search matches the half on its side of the word exactly,
then goes on across the other half with one error, and ends at the other delimiter.  An
error lies in one half, so the two searches find every word at distance one.

A word meets only blocks that can hold an answer: a word of length m that shares a word's exact
half shares at least its own first (m - 1) // 2 code points, so words are dealt by length and that
prefix, and each word asks three lengths: one of them with one code point replaced, one with
one more and one with one less.  Keys with more words, or more askers, than a task should
hold are dealt over several tasks.  So the work grows with the vocabulary, not its square.

Null texts have no words, empty texts neither; a null id counts as an empty one; texts and words may be
of any length; repeated rows count again; other columns are allowed; an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .work import Work

LETTERS = r"A-Za-zÀ-ÿ"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Least code points and occurrences of a word, and how much more frequent its form is.
LENGTH, LEAST, TIMES = 7, 2, 10
#: One run in so many loses a code point, chosen by a checksum of its document and itself.
EVERY = 31
#: Words of one index, about; askers of one task, and states taken at once.
BLOCK, ASKERS, BATCH = 30_000, 120_000, 16_384
#: Hot keys that are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
SAME, LONGER, SHORTER = 0, 1, 2


def runs(df: DataFrame, least: int = LENGTH, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word``: each run of letters of at least ``least`` code points, A-Z lower-cased; one in ``EVERY`` without one code point."""
    found = df.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("d"), F.explode(F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0))).alias("r"))
    found = found.select(F.translate("r", _UPPER, _LOWER).alias("r"), "d")
    h = F.crc32(F.concat("d", F.lit(":"), "r").cast("binary"))
    at = F.pmod(F.col("h"), F.char_length("r")).cast("int")
    less = F.concat(F.col("r").substr(F.lit(1), at), F.col("r").substr(at + 2, F.char_length("r")))
    return found.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("r")).alias("word"))


def vocabulary(df: DataFrame, length: int = LENGTH, least: int = LEAST, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, n``: words of at least ``length`` code points with at least ``least`` occurrences."""
    return runs(df, length, doc_id, text).filter(F.char_length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


class Index:
    """Rank intervals over delimited words; a match starts behind a word's delimiter and grows by its code points in turn.

    The text holds the words backwards, since rank intervals grow to the left.
    """

    def __init__(self, codes: np.ndarray, ends: np.ndarray):
        """``codes``: the words' code points one after another; ``ends``: where each ends."""
        n, lengths = len(ends), np.diff(ends, prepend=0)
        self.alphabet = np.unique(codes)
        size = len(codes) + n
        word = np.repeat(np.arange(n), lengths + 1)
        last = np.cumsum(lengths + 1) - 1
        text = np.zeros(size, np.int64)  # 0 is the delimiter, here behind each reversed word
        start = last - lengths
        within = np.arange(size) - start[word]
        inner = within < lengths[word]
        from_ = ends[word] - 1 - within
        text[inner] = np.searchsorted(self.alphabet, codes[from_[inner]]) + 1
        # prefix doubling up to the delimiter; equal suffixes stand in the order of their words
        rank, left, step = text.copy(), last[word] - np.arange(size), 1
        order = np.argsort(rank, kind="stable")
        longest = int(lengths.max(initial=0))
        while True:
            order = np.argsort(rank, kind="stable")
            if step > longest:
                break
            follow = np.where(left >= step, rank[np.minimum(np.arange(size) + step, size - 1)] + 1, 0)
            both = rank * (int(rank.max(initial=0)) + 2) + follow
            rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
            step *= 2
        # the symbol before each suffix; before a reversed word stands the delimiter
        before = np.where(within[order] == 0, 0, text[order - 1])
        self.size, self.symbols = size, len(self.alphabet) + 1
        self.bwt = before
        keys = before * size + np.arange(size)
        sorting = np.argsort(before, kind="stable")
        self.keys = keys[sorting]
        #: Of each place where a word is complete, in row order: the word.
        self.complete = word[order][sorting[: np.searchsorted(self.keys, size)]]
        self.all = (0, n)  # rows that start with a delimiter

    def code(self, codes: np.ndarray) -> np.ndarray:
        """Symbols of code points; those of no word are -1."""
        if not len(self.alphabet):
            return np.full(len(codes), -1)
        at = np.minimum(np.searchsorted(self.alphabet, codes), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == codes, at + 1, -1)

    def grow(self, lo: np.ndarray, hi: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of each match with one more symbol: rows before it plus the symbol's rank."""
        base = symbol * self.size
        return np.searchsorted(self.keys, base + lo), np.searchsorted(self.keys, base + hi)

    def children(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Every symbol (no delimiter) that may follow each match, as (match, symbol) pairs."""
        wide = hi - lo >= self.symbols
        a = np.flatnonzero(wide)
        pairs = (a[:, None] * self.symbols + np.arange(1, self.symbols)).ravel()
        b = np.flatnonzero(~wide)
        width = (hi - lo)[b]
        owner = np.repeat(b, width)
        row = np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(lo[b], width)
        found = np.unique(owner * self.symbols + self.bwt[row])
        pairs = np.concatenate([pairs, found[found % self.symbols > 0]])
        return pairs // self.symbols, pairs % self.symbols

    def ended(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The word that each match is, or -1."""
        a, b = self.grow(lo, hi, np.zeros(len(lo), np.int64))
        return np.where(b > a, self.complete[np.minimum(a, max(len(self.complete) - 1, 0))] if len(self.complete) else -1, -1)


def one_error(index: Index, codes: np.ndarray, start: np.ndarray, length: np.ndarray, half: np.ndarray, kind: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(asker, word) pairs: the first ``half`` code points agree, and one error of the kind follows.

    The error's place is the last possible one (in a run of equal code points), so a pair comes once.
    """
    own = index.code(codes)
    sym = lambda q, j: own[start[q] + j]
    q = np.arange(len(start))
    lo, hi = np.full(len(q), index.all[0]), np.full(len(q), index.all[1])

    def exact(q, j, lo, hi):
        c = sym(q, j)
        ok = c > 0
        q, j, lo, hi, c = q[ok], j[ok], lo[ok], hi[ok], c[ok]
        lo, hi = index.grow(lo, hi, c)
        ok = hi > lo
        return q[ok], j[ok] + 1, lo[ok], hi[ok]

    j = np.zeros(len(q), np.int64)
    for step in range(int(half.max(initial=0))):
        now = half[q] > step
        done = [x[~now] for x in (q, j, lo, hi)]
        more = exact(q[now], j[now], lo[now], hi[now])
        q, j, lo, hi = (np.concatenate(p) for p in zip(done, more, strict=True))
    late = tuple(np.zeros(0, np.int64) for _ in range(4))  # matches with their error behind them
    while len(q) or len(late[0]):
        # a new error at each match's place
        if kind == SHORTER:
            can = j < length[q]
            nxt = np.where(j[can] + 1 < length[q[can]], sym(q[can], np.minimum(j[can] + 1, length[q[can]] - 1)), -2)
            keep = np.flatnonzero(can)[nxt != sym(q[can], j[can])]
            new = (q[keep], j[keep] + 1, lo[keep], hi[keep])
        else:
            can = np.flatnonzero(j < length[q] + (kind == LONGER))
            at, c = index.children(lo[can], hi[can])
            at = can[at]
            inside = j[at] < length[q[at]]
            other = ~inside | (c != sym(q[at], np.minimum(j[at], length[q[at]] - 1)))
            at, c = at[other], c[other]
            a, b = index.grow(lo[at], hi[at], c)
            ok = b > a
            new = (q[at[ok]], j[at[ok]] + (kind == SAME), a[ok], b[ok])
        late = tuple(np.concatenate(p) for p in zip(late, new, strict=True))
        over = late[1] == length[late[0]]
        word = index.ended(late[2][over], late[3][over])
        yield late[0][over][word >= 0], word[word >= 0]
        late = exact(*(x[~over] for x in late))
        more = j < length[q]
        q, j, lo, hi = exact(q[more], j[more], lo[more], hi[more])


def _joined(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all words, and where each ends."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.cumsum([len(w) for w in words], dtype=np.int64)


def _search(t: pa.Table) -> pa.Table:
    """One block: its words (``kind`` null) and askers; pairs of an asker and a word at distance one."""
    kind = np.asarray(t.column("kind").fill_null(-1).combine_chunks())
    words, back = t.column("word").to_pylist(), np.asarray(t.column("back").combine_chunks())
    n = np.asarray(t.column("n").combine_chunks())
    asker, near, near_n = [], [], []
    for side in (False, True):
        turn = (lambda w: w[::-1]) if side else (lambda w: w)
        mine = np.flatnonzero((back == side) & (kind < 0))
        held = sorted(mine.tolist(), key=lambda i: words[i])
        if not held:
            continue
        index = Index(*_joined([turn(words[i]) for i in held]))
        for k in (SAME, LONGER, SHORTER):
            asking = sorted(np.flatnonzero((back == side) & (kind == k)).tolist(), key=lambda i: turn(words[i]))
            for at in range(0, len(asking), BATCH):
                part = asking[at : at + BATCH]
                codes, ends = _joined([turn(words[i]) for i in part])
                length = np.diff(ends, prepend=0)
                half = length - length // 2 if side else length // 2
                for q, w in one_error(index, codes, ends - length, length, half, k):
                    for i, j in zip(q.tolist(), w.tolist(), strict=True):
                        a, b = words[part[i]], words[held[j]]
                        cut = len(a) // 2
                        if not side or a[:cut] != b[:cut]:  # else the search to the right has found the pair
                            asker.append(a)
                            near.append(b)
                            near_n.append(n[held[j]])
    return pa.table({"word": pa.array(asker, pa.string()), "near": pa.array(near, pa.string()), "near_n": pa.array(near_n, pa.int64())})


def _cards(vocab: DataFrame) -> DataFrame:
    """``word, n, back, kind, key``: each word's two places in indexes, and its six questions."""
    size = F.char_length("word")
    cards = []
    for back in (False, True):
        turned = F.reverse("word") if back else F.col("word")
        for kind, m in ((None, size), (SAME, size), (LONGER, size + 1), (SHORTER, size - 1)):
            key = F.concat(F.lit("<" if back else ">"), m.cast("string"), F.lit(":"), turned.substr(F.lit(1), F.floor((m - 1) / 2).cast("int")))
            cards.append(F.struct(F.lit(back).alias("back"), F.lit(kind).cast("int").alias("kind"), key.alias("key")))
    return vocab.select("word", "n", F.explode(F.array(*cards)).alias("c")).select("word", "n", "c.back", "c.kind", "c.key")


def _dealt(cards: DataFrame, hot: DataFrame, blocks: int) -> DataFrame:
    """Adds ``block, slice``: words of a hot key go to one of its blocks and all its slices, its askers to all blocks and one slice."""
    some = F.pmod(F.xxhash64("word"), F.lit(1 << 30))
    rows = cards.join(hot, "key", "left").withColumns({"b": F.coalesce("b", F.lit(1)), "s": F.coalesce("s", F.lit(1))})
    holds = F.col("kind").isNull()
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    rows = rows.withColumn("i", F.explode(F.when(holds, F.array(some % F.col("b"))).otherwise(every(F.col("b")))))
    rows = rows.withColumn("k", F.explode(F.when(holds, every(F.col("s"))).otherwise(F.array(some % F.col("s")))))
    alone = (F.col("b") > 1) | (F.col("s") > 1)
    block = F.when(alone, F.xxhash64("key", "i", "k")).otherwise(F.pmod(F.xxhash64("key"), F.lit(blocks)))
    return rows.select("word", "n", "back", "kind", block.alias("block"), F.when(alone, F.col("key")).alias("hot"))


def near_words(vocab: DataFrame, block: int = BLOCK, askers: int = ASKERS) -> DataFrame:
    """``word, near, near_n`` for every two words of ``vocab (word, n)``, a stored table of distinct words, at an edit distance of exactly one."""
    cards = _cards(vocab)
    blocks = max(1, -(-2 * vocab.count() // block))
    counted = cards.groupBy("key").agg(F.count_if(F.col("kind").isNull()).alias("held"), F.count_if(F.col("kind").isNotNull()).alias("asked"))
    hot = counted.filter((F.col("held") > 0) & ((F.col("held") > block) | (F.col("asked") > askers))).select("key", F.ceil(F.col("held") / block).alias("b"), F.ceil(F.col("asked") / askers).alias("s"))
    few = hot.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return _dealt(cards, F.broadcast(hot) if few else hot, blocks).groupBy("block", "hot").applyInArrow(_search, "word string, near string, near_n bigint")


def variants(df: DataFrame, length: int = LENGTH, least: int = LEAST, times: int = TIMES, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each word of the texts.

    ``form``: the near word of largest n (ties: the smallest in code-point order) where that
    is at least ``times`` the word's own n; ``root``: the end of the chain of forms.
    """
    work = Work(df.sparkSession)
    vocab = work.save(vocabulary(df, length, least, doc_id, text))
    best: Column = F.min(F.struct((-F.col("near_n")).alias("minus"), "near"))
    found = near_words(vocab).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    fits = -F.col("best.minus") >= times * F.col("n")
    words = work.save(vocab.join(found, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")))
    # n grows along a chain, so it ends; each round doubles what is followed
    roots = work.save(words.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        next_ = roots.select(F.col("word").alias("root"), F.col("root").alias("on"))
        if roots.join(next_, "root", "left_semi").isEmpty():
            break
        further = work.save(roots.join(next_, "root", "left").select("word", F.coalesce("on", "root").alias("root")))
        work.drop(roots)
        roots = further
    return words.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
