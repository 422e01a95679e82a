"""Toxicity by a bidirectional gated recurrent network with attention pooling.

Inputs are words: an embedding of the word itself (words of the training sample)
plus the mean embedding of its hashed character 3- to 5-grams with edge marks, so
unseen inflections of a known stem count too.  The network reads windows of
``WINDOW`` words, one every ``STRIDE`` words, so that all windows overlap and cover
the whole text; a document's score is that of its highest window.

Training is numpy only, in one task, from a bounded sample of labelled rows:
``SAMPLE`` of each label at most (twice as many of label 0), the first in hash
order, texts of any length; of a long one ``PARTS`` parts of ``PART`` characters are
trained on, so that the task's memory has a bound.
First every window takes its document's label, then only the highest windows do.  The
cut at which the probability is one half comes from a fifth of the sample that the
weights have not seen.

Cases: null and empty texts are one window without words and get its score; texts
of any length are scored whole; repeated ids in ``documents`` add one text to the sample; equal texts get equal scores; without labels of
both kinds every score is low; tables may be empty and may have other columns.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .work import small_batches

WINDOW, STRIDE = 32, 16
HIDDEN, INPUT, BUCKETS = 8, 12, 1 << 14
SAMPLE = 1200
#: Of a longer text the network is trained on so many parts of so many characters, evenly spread from its first to its last.
PARTS, PART = 10, 2_000
_IS_WORD = np.array([chr(b).isalnum() if b < 128 else True for b in range(256)])


def ngrams(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3- to 5-grams of each marked word: buckets one after another, and n+1 offsets."""
    size = end - start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    marked = np.empty(at[-1], np.uint8)
    marked[at[:-1]], marked[at[1:] - 1] = 1, 2
    inner = np.ones(len(marked), bool)
    inner[at[:-1]] = inner[at[1:] - 1] = False
    n = size - 2
    marked[inner] = buf[np.repeat(start - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    prefix = tv.prefix_hash(marked)
    word = np.repeat(np.arange(len(start), dtype=np.int32), size)
    last = at[1:][word]
    grams, owner = [], []
    for g in (3, 4, 5):
        s = np.flatnonzero(np.arange(len(marked)) + g <= last)
        grams.append((tv.span_hash(prefix, s, s + g) >> np.uint64(64 - 14)).astype(np.uint16))
        owner.append(word[s])
    owner = np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(grams)[order], np.searchsorted(owner[order], np.arange(len(start) + 1))


@dataclass
class Words:
    """The distinct words of some texts and the windows of word numbers; number n stands for no word."""

    hashes: np.ndarray
    grams: np.ndarray
    gram_at: np.ndarray
    windows: np.ndarray
    doc_at: np.ndarray

    @classmethod
    def of(cls, buf: np.ndarray, offs: np.ndarray) -> Words:
        low = tv.lower_latin(buf)
        start, end, bound = tv.word_spans(low, offs, _IS_WORD)
        each = [tv.span_hash(tv.prefix_hash(low[offs[i] : offs[j]]), start[bound[i] : bound[j]] - offs[i], end[bound[i] : bound[j]] - offs[i]) for i, j in tv.chunks(offs)]
        hashes, first, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_index=True, return_inverse=True)
        parts, gram_at = [np.zeros(0, np.uint16)], [np.zeros(1, np.int64)]
        for a in range(0, len(first), 20000):  # in blocks, as each word has many
            grams, at = ngrams(low, start[first[a : a + 20000]], end[first[a : a + 20000]])
            parts.append(grams)
            gram_at.append(at[1:] + gram_at[-1][-1])
        grams, gram_at = np.concatenate(parts), np.concatenate(gram_at)
        n = np.diff(bound)
        count = np.maximum(1, -(-(n - STRIDE) // STRIDE))
        doc_at = np.concatenate([[0], np.cumsum(count)])
        doc = np.repeat(np.arange(len(n)), count)
        begin = bound[:-1][doc] + STRIDE * (np.arange(doc_at[-1]) - doc_at[:-1][doc])
        stop = bound[1:][doc]
        which = np.append(which, len(hashes)).astype(np.int32)
        windows = np.empty((len(begin), WINDOW), np.int32)
        for k in range(WINDOW):
            windows[:, k] = which[np.where(begin + k < stop, begin + k, len(which) - 1)]
        return cls(hashes, grams, gram_at, windows, doc_at)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * np.tanh(np.float32(0.5) * x) + np.float32(0.5)


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with each index 0..n-1."""
    return np.stack([np.bincount(at, rows[:, j], n) for j in range(rows.shape[1])], 1).astype(np.float32)


@dataclass
class Network:
    known: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    p: dict[str, np.ndarray] = field(default_factory=dict)

    def start(self, seed: int = 1) -> Network:
        rng = np.random.default_rng(seed)
        r = lambda *shape, s: (rng.standard_normal(shape) * s).astype(np.float32)
        h, d = HIDDEN, INPUT
        self.p = {"word": r(len(self.known) + 1, d, s=0.02), "char": r(BUCKETS, d, s=0.02), "v": r(2 * h, s=0.1), "w": r(2 * h, s=0.3), "b": np.zeros(1, np.float32)}
        for k in "fb":
            self.p |= {f"W{k}": r(d, 3 * h, s=d**-0.5), f"U{k}": r(h, 3 * h, s=h**-0.5), f"c{k}": np.zeros(3 * h, np.float32)}
        self.p["word"][0] = 0
        return self

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """1 and more for the known words, 0 for others."""
        if not len(self.known):
            return np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return np.where(self.known[at] == hashes, at + 1, 0)

    def inputs(self, ids: np.ndarray, grams: np.ndarray, gram_at: np.ndarray) -> np.ndarray:
        if not len(ids):
            return np.zeros((0, INPUT), np.float32)
        n = np.diff(gram_at).astype(np.float32)
        out = self.p["word"][ids]
        for a in range(0, len(ids), 20000):
            at = gram_at[a : a + 20001]
            out[a : a + 20000] += np.add.reduceat(self.p["char"][grams[at[0] : at[-1]]], at[:-1] - at[0], axis=0) / n[a : a + 20000, None]
        return out

    def run(self, x: np.ndarray, windows: np.ndarray, trace: dict | None = None) -> np.ndarray:
        """Logits of the windows over the words' inputs ``x``."""
        h, n = HIDDEN, len(windows)
        mask = windows < len(x)
        states = np.zeros((WINDOW, n, 2 * h), np.float32)
        for k, side in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            proj = np.concatenate([x @ self.p[f"W{k}"] + self.p[f"c{k}"], np.zeros((1, 3 * h), np.float32)])
            state, U = np.zeros((n, h), np.float32), self.p[f"U{k}"]
            for t in range(WINDOW) if k == "f" else range(WINDOW - 1, -1, -1):
                a, u = proj[windows[:, t]], state @ U
                zr = _sigmoid(a[:, : 2 * h] + u[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * u[:, 2 * h :])
                new = c + z * (state - c)
                new *= mask[:, t, None]
                if trace is not None:
                    trace[k, t] = (state, z, r, c, u[:, 2 * h :])
                state = new
                states[t, :, side] = state
        e = states @ self.p["v"]
        e[~mask.T] = -30
        e = np.exp(e - e.max(axis=0))
        attention = e / e.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", attention, states)
        if trace is not None:
            trace |= {"mask": mask, "states": states, "attention": attention, "pooled": pooled}
        return pooled @ self.p["w"] + self.p["b"][0]

    def gradients(self, x: np.ndarray, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray, float]:
        """Gradients of the mean weighted log loss by parameter, and by ``x``."""
        h, tr = HIDDEN, {}
        logit = self.run(x, windows, tr)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        d = ((p - y) * weight / weight.sum()).astype(np.float32)
        loss = float(-(weight * (y * np.log(p + 1e-9) + (1 - y) * np.log(1 - p + 1e-9))).sum() / weight.sum())
        states, att, mask = tr["states"], tr["attention"], tr["mask"]
        g = {"w": tr["pooled"].T @ d, "b": np.array([d.sum()], np.float32)}
        dpool = d[:, None] * self.p["w"]
        datt = np.einsum("nh,tnh->tn", dpool, states)
        de = att * (datt - (att * datt).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", de, states)
        dstates = att[:, :, None] * dpool + de[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        for k, side in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            U, W = self.p[f"U{k}"], self.p[f"W{k}"]
            carry, gU, each = np.zeros((len(windows), h), np.float32), np.zeros_like(U), np.empty((WINDOW, len(windows), 3 * h), np.float32)
            for t in range(WINDOW - 1, -1, -1) if k == "f" else range(WINDOW):
                state, z, r, c, un = tr[k, t]
                dn = (dstates[t, :, side] + carry) * mask[:, t, None]
                dc = dn * (1 - z) * (1 - c * c)
                dz = dn * (state - c) * z * (1 - z)
                dr = dc * un * r * (1 - r)
                each[t] = np.concatenate([dz, dr, dc], 1)
                du = np.concatenate([dz, dr, dc * r], 1)
                gU += state.T @ du
                carry = dn * z + du @ U.T
            dproj = _summed(windows.T.ravel(), each.reshape(-1, 3 * h), len(x) + 1)[:-1]
            g[f"U{k}"], g[f"c{k}"], g[f"W{k}"] = gU, dproj.sum(axis=0), x.T @ dproj
            dx += dproj @ W.T
        return g, dx, loss

    def score(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Probability of each text's highest window."""
        words = Words.of(buf, offs)
        x = self.inputs(self.ids(words.hashes), words.grams, words.gram_at)
        logits = np.concatenate([self.run(x, words.windows[a : a + 4096]) for a in range(0, len(words.windows), 4096)]) if len(words.windows) else np.zeros(0)
        top = np.maximum.reduceat(logits, words.doc_at[:-1]) if len(logits) else logits
        return 1 / (1 + np.exp(-np.clip(top.astype(np.float64), -30, 30)))


def train(texts: list[str], labels: list[int], seed: int = 1, warm: int = 84, steps: int = 320, batch: int = 512, rate: float = 0.02, decay: float = 2e-3) -> Network:
    net = Network()
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        net.start(seed)
        net.p["w"][:] = 0
        net.p["b"][:] = -3
        return net
    words = Words.of(*tv.utf8(pa.array(texts, pa.large_string())))
    # each fifth text is kept back for the cut, where that leaves both labels on both sides
    back = np.arange(len(y)) % 5 == 4
    if len(set(y[back])) < 2 or len(set(y[~back])) < 2:
        back[:] = False
    doc = np.repeat(np.arange(len(y)), np.diff(words.doc_at))
    seen = words.windows[~back[doc]]
    times = np.bincount(seen[seen < len(words.hashes)], minlength=len(words.hashes))
    del seen
    net.known = words.hashes[times >= 6]
    net.start(seed)
    ids, rng = net.ids(words.hashes), np.random.default_rng(seed)
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0

    def update(rows: np.ndarray, target: np.ndarray, weight: np.ndarray) -> None:
        nonlocal step
        used, inverse = np.unique(words.windows[rows], return_inverse=True)
        inverse = inverse.reshape(len(rows), WINDOW)
        real = used < len(ids)
        used = used[real]
        size = words.gram_at[used + 1] - words.gram_at[used]
        at = np.concatenate([[0], np.cumsum(size)])
        grams = words.grams[np.repeat(words.gram_at[used] - at[:-1], size) + np.arange(at[-1])]
        g, dx, _ = net.gradients(net.inputs(ids[used], grams, at), inverse, target, weight)
        g["word"] = _summed(ids[used], dx, len(net.p["word"]))
        g["word"][0] = 0
        g["char"] = _summed(grams, np.repeat(dx / np.maximum(size, 1)[:, None].astype(np.float32), size, axis=0), BUCKETS)
        step += 1
        now = rate * max(0.05, 1 - step / steps)
        for k, v in net.p.items():
            m, s = moment[k]
            m += 0.1 * (g[k] - m)
            s += 0.01 * (g[k] * g[k] - s)
            v -= now * (m / (1 - 0.9**step) / (np.sqrt(s / (1 - 0.99**step)) + 1e-7) + (decay * v if k != "b" else 0))

    def sweep(rows: np.ndarray) -> None:
        rows = rng.permutation(rows)
        target = y[doc[rows]]
        weight = np.where(target > 0, 0.3 / max(target.sum(), 1), 0.7 / max((1 - target).sum(), 1)).astype(np.float32)
        size = max(32, min(batch, len(rows) // 8))
        for a in range(0, len(rows), size):
            update(rows[a : a + size], target[a : a + size], weight[a : a + size])

    while step < steps:
        if step < warm:
            take = np.minimum(np.diff(words.doc_at), 12)
            sweep(np.concatenate([rng.choice(np.arange(a, a + n), m, replace=False) for a, n, m, b in zip(words.doc_at, np.diff(words.doc_at), take, back, strict=False) if not b]))
            continue
        x = net.inputs(ids, words.grams, words.gram_at)
        logits = np.concatenate([net.run(x, words.windows[a : a + 4096]) for a in range(0, len(words.windows), 4096)])
        order = np.lexsort((-logits, doc))
        place = np.arange(len(order)) - words.doc_at[:-1][doc[order]]
        use = ~back[doc[order]]
        hard = order[use & ((place == 0) | ((y[doc[order]] == 0) & (place < 3)))]
        sweep(np.concatenate([hard, order[use & (y[doc[order]] == 1) & (place == 1) & (logits[order] > 0)]]))
    x = net.inputs(ids, words.grams, words.gram_at)
    logits = np.concatenate([net.run(x, words.windows[a : a + 4096]) for a in range(0, len(words.windows), 4096)])
    cut = back if back.any() else ~back
    net.p["b"] -= np.float32(middle(np.maximum.reduceat(logits, words.doc_at[:-1])[cut], y[cut]))
    return net


def middle(logits: np.ndarray, y: np.ndarray, cost: float = 5.0) -> float:
    """Midway between two cuts.

    One has the least errors (a clean text above it counts ``cost`` times; of equal cuts the
    middle of the widest gap), but hangs on few texts; the other lies midway between 99 % of
    the clean texts and 98 % of the toxic ones.
    """
    order = np.argsort(logits, kind="stable")
    s, label = logits[order], y[order]
    wrong = np.concatenate([[0], np.cumsum(label)]) + cost * np.concatenate([np.cumsum((1 - label)[::-1])[::-1], [0]])
    ends = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    best = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    k = best[np.argmax(ends[best + 1] - ends[best])]
    least = float(ends[k] + ends[k + 1]) / 2
    return (least + float(np.quantile(s[label == 0], 0.99) + np.quantile(s[label == 1], 0.02)) / 2) / 2


def parts_of(text) -> Column:
    """A text as it is trained on: whole (null stays null), or ``PARTS`` parts of it."""
    n = F.char_length(text)
    at = lambda i: F.floor(i * (n - PART) / (PARTS - 1)).cast("int") + 1
    spread = F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring(text, at(i), F.lit(PART)))
    return F.when(n > PARTS * PART, F.array_join(spread, "\n")).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, usable=None) -> Network:
    """A network from a bounded sample of labelled rows, of those for which ``usable`` (a column expression) holds.

    At most ``sample`` texts with label 1 and twice as many with label 0, of any length, come to
    one task, of each at most ``PARTS * PART`` characters: 72 million at most by default.
    The network is trained there; only its weights come to the driver.
    """
    rows = labels.select(F.col(doc_id).cast("long").alias("i"), F.col(label).cast("int").alias("y")).filter("i is not null and y in (0, 1)")
    rows = rows.filter(usable) if usable is not None else rows
    own = docs.select(F.col(doc_id).cast("long").alias("i"), F.col(text).alias("t")).filter("t is not null")
    known = rows.join(own.select("i").distinct(), "i", "left_semi")
    first = lambda y, n: known.filter(F.col("y") == y).orderBy(F.xxhash64("i", F.lit(17)), "i").limit(n)
    chosen = F.broadcast(first(1, sample).unionByName(first(0, 2 * sample)))  # 3 * sample ids at most
    rows = own.join(chosen, "i").groupBy("i", "y").agg(F.min(parts_of(F.col("t"))).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted((i, y, t) for b in batches for i, y, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
        net = train([t for _, _, t in found], [y for _, y, _ in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net)], pa.binary())], names=["net"])

    small_batches(docs.sparkSession)
    made = rows.repartition(1).mapInArrow(run, "net binary").first()
    return pickle.loads(made.net) if made else train([], [])


#: Rows that labels may be learned from.
LEARNABLE = "pmod(crc32(cast(i as string)), 5) <> 0"


def with_toxicity(df: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """Adds ``score``: the probability that label 1 fits, to six places."""
    from pyspark.sql import types as T

    small_batches(df.sparkSession)
    names = [c for c in df.columns if c != "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, offs = tv.utf8(b.column(names.index(text)))
            for i, j in tv.chunks(offs):
                scores = net.score(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                yield pa.RecordBatch.from_arrays([*b.slice(i, j - i).columns, pa.array(np.round(scores, 6))], names=[*names, "score"])

    plain = df.select(*names)
    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("score", T.DoubleType())]))
