"""Gradient-boosted trees with logistic loss, trained and applied in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Complete binary trees of one depth: arrays [tree, inner node] and leaf values [tree, leaf]."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    bias: float
    depth: int

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, np.float64)
        out = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - (2**self.depth - 1)]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1."""
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, reg: float = 1.0) -> Boosted:
    """Histogram boosting: at each node the split with the largest gain over all features and quantile bins."""
    x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
    n, d = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for j in range(d)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1) if n else np.zeros((0, d), int)
    mean = min(max(float(y.mean()) if n else 0.5, 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    inner = 2**depth - 1
    feature, threshold, value = np.zeros((trees, inner), int), np.full((trees, inner), np.inf), np.zeros((trees, inner + 1))
    score = np.full(n, bias)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        at = np.zeros(n, int)
        for node in range(inner):
            own = np.flatnonzero(at == node)
            if len(own):
                best = (1e-9, 0, np.inf)
                gs, hs = g[own].sum(), h[own].sum()
                for j in range(d):
                    if len(edges[j]):
                        b = binned[own, j]
                        gl = np.cumsum(np.bincount(b, g[own], len(edges[j]) + 1))[:-1]
                        hl = np.cumsum(np.bincount(b, h[own], len(edges[j]) + 1))[:-1]
                        gain = gl**2 / (hl + reg) + (gs - gl) ** 2 / (hs - hl + reg) - gs**2 / (hs + reg)
                        k = int(np.argmax(gain))
                        if gain[k] > best[0]:
                            best = (gain[k], j, edges[j][k])
                feature[t, node], threshold[t, node] = best[1:]
            at[own] = 2 * node + 1 + (x[own, feature[t, node]] > threshold[t, node])
        leaf = at - inner
        value[t] = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + reg)
        score += value[t][leaf]
    return Boosted(feature, threshold, value, bias, depth)


def threshold_for(scores: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest score at and above which at least ``precision`` of held-out rows have label 1; above 1 where none has."""
    order = np.argsort(-scores, kind="stable")
    s, hit = scores[order], np.cumsum(y[order])
    last = np.append(s[1:] != s[:-1], True)
    good = np.flatnonzero(last & (hit / np.arange(1, len(s) + 1) >= precision)) if len(s) else []
    return float(s[good[-1]]) if len(good) else 2.0
