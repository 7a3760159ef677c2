"""Histogram gradient-boosted trees in numpy: logistic loss, complete trees flattened into arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees in heap order: node i has children 2i + 1 and 2i + 2.

    ``feature`` and ``edge`` are (trees, inner nodes), ``value`` is (trees, leaves); a node without a
    split has an infinite edge, so that all rows go left.
    """

    base: float
    depth: int
    feature: np.ndarray
    edge: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1: all rows walk all trees together, a level at a time."""
        trees = np.arange(len(self.value))[None, :]
        rows = np.arange(len(x))[:, None]
        node = np.zeros((len(x), len(self.value)), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.edge[trees, node])
        margin = self.base + self.value[trees, node - (1 << self.depth) + 1].sum(1)
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 1.0, least: float = 5.0) -> Forest:
    """Trees grown level by level on histograms of gradients over quantile bins.

    Without rows, or with one label only, the forest is empty and scores the (smoothed) base rate.
    """
    n, inner, leaves = len(y), (1 << depth) - 1, 1 << depth
    base = np.log((y.sum() + 0.5) / (n - y.sum() + 0.5))
    if n == 0 or y.min() == y.max():
        trees = 0
    out = Forest(float(base), depth, np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves)))
    if not trees:
        return out
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, wide = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(wide, 1e-6)
            g_all, h_all = np.bincount(at, grad, wide), np.bincount(at, hess, wide)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                cell = at * bins + code[:, j]
                g = np.bincount(cell, grad, wide * bins).reshape(wide, bins).cumsum(1)[:, : len(e)]
                h = np.bincount(cell, hess, wide * bins).reshape(wide, bins).cumsum(1)[:, : len(e)]
                gr, hr = g_all[:, None] - g, h_all[:, None] - h
                gain = g**2 / (h + l2) + gr**2 / (hr + l2) - (g_all**2 / (h_all + l2))[:, None]
                gain[(h < least / 4) | (hr < least / 4)] = 0
                k = gain.argmax(1)
                better = gain[np.arange(wide), k] > best
                for i in np.flatnonzero(better):
                    best[i] = gain[i, k[i]]
                    out.feature[t, first + i], out.edge[t, first + i] = j, e[k[i]]
            node = 2 * node + 1 + (x[np.arange(n), out.feature[t, node]] > out.edge[t, node])
        at = node - inner
        out.value[t] = -rate * np.bincount(at, grad, leaves) / (np.bincount(at, hess, leaves) + l2)
        margin += out.value[t, at]
    return out
