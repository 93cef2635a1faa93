"""Small gradient-boosted trees (logistic loss, level-wise, histogram splits) in numpy."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier; complete trees of fixed depth, so that prediction is array work."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, least: float = 3.0) -> None:
        self.trees, self.depth, self.rate, self.bins, self.least = trees, depth, rate, bins, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) if n else np.zeros(0) for j in range(m)]
        codes = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1) if m else np.zeros((n, 0), int)
        p = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        width = self.bins + 1
        self.feature, self.cut, self.leaf = [], [], []
        for _ in range(self.trees):
            prob = 1 / (1 + np.exp(-f))
            g, h = y - prob, prob * (1 - prob) + 1e-6
            node = np.zeros(n, int)
            feature = np.zeros(2**self.depth - 1, int)
            cut = np.full(2**self.depth - 1, np.inf)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                local = node - first
                best = np.full(count, 1e-6)
                for j in range(m):
                    if not len(cuts[j]):
                        continue
                    at = local * width + codes[:, j]
                    gs = np.bincount(at, g, count * width).reshape(count, width).cumsum(1)
                    hs = np.bincount(at, h, count * width).reshape(count, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    k = len(cuts[j])
                    gl, hl = gs[:, :k], hs[:, :k]
                    gain = gl**2 / (hl + 1) + (gt - gl) ** 2 / (ht - hl + 1) - gt**2 / (ht + 1)
                    gain[(hl < self.least * 0.05) | (ht - hl < self.least * 0.05)] = 0
                    top = gain.argmax(1)
                    value = gain[np.arange(count), top]
                    for i in np.flatnonzero(value > best):
                        best[i], feature[first + i], cut[first + i] = value[i], j, cuts[j][top[i]]
                node = 2 * node + 1 + (x[np.arange(n), feature[node]] > cut[node])
            local = node - (2**self.depth - 1)
            leaf = self.rate * np.bincount(local, g, 2**self.depth) / (np.bincount(local, h, 2**self.depth) + 1)
            f = f + leaf[local]
            self.feature.append(feature)
            self.cut.append(cut)
            self.leaf.append(leaf)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities."""
        f = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), int)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            f += leaf[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-f))
