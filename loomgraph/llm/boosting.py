"""Boosted regression trees for a yes/no target, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting over quantile bins; every tree is a full binary tree of fixed depth."""

    def __init__(self, rounds: int = 120, depth: int = 4, rate: float = 0.2, bins: int = 32, leaf_rows: float = 4.0):
        self.rounds, self.depth, self.rate, self.bins, self.leaf_rows = rounds, depth, rate, bins, leaf_rows

    def fit(self, x: np.ndarray, y: np.ndarray) -> "BoostedTrees":
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        binned = np.column_stack([np.searchsorted(c, v, side="left") for c, v in zip(self.cuts, x.T)])
        self.start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        self.trees, score = [], np.full(len(y), self.start)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            tree, step = self._grow(binned, p - y, np.maximum(p * (1 - p), 1e-6))
            self.trees.append(tree)
            score += step
        return self

    def _grow(self, binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray) -> tuple[list, np.ndarray]:
        """One tree; a level's histograms over all nodes, features and bins are one bincount each."""
        rows, n_features = binned.shape
        width = max(map(len, self.cuts)) + 1
        place = binned + np.arange(n_features) * width
        each = [np.repeat(v, n_features) for v in (gradient, hessian)]
        node, tree = np.zeros(rows, np.int64), []
        for level in range(self.depth):
            nodes = 1 << level
            at = (node[:, None] * (n_features * width) + place).ravel()
            g, h, count = (np.bincount(at, w, nodes * n_features * width).reshape(nodes, n_features, width).cumsum(axis=2) for w in (*each, None))
            gain = g[..., :-1] ** 2 / (h[..., :-1] + 1) + (g[..., -1:] - g[..., :-1]) ** 2 / (h[..., -1:] - h[..., :-1] + 1) - g[..., -1:] ** 2 / (h[..., -1:] + 1)
            gain[(count[..., :-1] < self.leaf_rows) | (count[..., -1:] - count[..., :-1] < self.leaf_rows)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            feature, k = best // (width - 1), best % (width - 1)
            split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-6
            k = np.where(split, k, width)
            cut = np.array([self.cuts[f][i] if s else np.inf for f, i, s in zip(feature, k, split)])
            node = 2 * node + (binned[np.arange(rows), feature[node]] > k[node])
            tree.append((feature, cut))
        g, h = np.bincount(node, gradient, 1 << self.depth), np.bincount(node, hessian, 1 << self.depth)
        leaves = -self.rate * g / (h + 1)
        tree.append(leaves)
        return tree, leaves[node]

    def probability(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for *levels, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in levels:
                node = 2 * node + (x[np.arange(len(x)), feature[node]] > cut[node])
            score += leaves[node]
        return 1 / (1 + np.exp(-score))
