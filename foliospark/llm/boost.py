"""Gradient-boosted regression trees for two classes, on binned features, with numpy alone."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting of complete trees of a fixed depth."""

    def __init__(self, rounds: int = 40, depth: int = 4, bins: int = 32, rate: float = 0.25, penalty: float = 5.0):
        self.rounds, self.depth, self.bins, self.rate, self.penalty = rounds, depth, bins, rate, penalty

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1).astype(np.uint8)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> "Trees":
        share = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], share)) for j in range(x.shape[1])]
        binned = self._bin(x)
        weight = np.ones(len(y)) if weight is None else weight
        p = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
        self.base = np.log(p / (1 - p))
        score = np.full(len(y), self.base)
        self.trees = []
        width = x.shape[1]
        for _ in range(self.rounds):
            prob = 1 / (1 + np.exp(-score))
            grad, hess = weight * (y - prob), weight * prob * (1 - prob)
            node = np.zeros(len(y), np.int64)
            features, cuts = [], []
            for level in range(self.depth):
                nodes = 1 << level
                flat = (node[:, None] * width + np.arange(width)) * self.bins + binned
                size = nodes * width * self.bins
                g = np.bincount(flat.ravel(), np.repeat(grad, width), size).reshape(nodes, width, self.bins)
                h = np.bincount(flat.ravel(), np.repeat(hess, width), size).reshape(nodes, width, self.bins)
                gl, hl = g.cumsum(2)[:, :, :-1], h.cumsum(2)[:, :, :-1]
                gt, ht = g.sum(2)[:, :, None], h.sum(2)[:, :, None]
                gain = gl**2 / (hl + self.penalty) + (gt - gl) ** 2 / (ht - hl + self.penalty)
                best = gain.reshape(nodes, -1).argmax(1)
                feature, cut = best // (self.bins - 1), best % (self.bins - 1)
                features.append(feature)
                cuts.append(cut)
                node = 2 * node + (binned[np.arange(len(y)), feature[node]] > cut[node])
            leaves = 1 << self.depth
            value = self.rate * np.bincount(node, grad, leaves) / (np.bincount(node, hess, leaves) + self.penalty)
            score += value[node]
            self.trees.append((features, cuts, value))
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of class 1 for each row."""
        binned = self._bin(x)
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for features, cuts, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for feature, cut in zip(features, cuts):
                node = 2 * node + (binned[row, feature[node]] > cut[node])
            out += value[node]
        return out
