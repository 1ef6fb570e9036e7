"""Gradient-boosted regression trees on binned features, in numpy."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Logistic boosting of trees of fixed depth; ``calibrate`` maps margins to held-out frequencies."""

    def __init__(self, trees: int = 50, depth: int = 3, rate: float = 0.25, bins: int = 16, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.ridge = trees, depth, rate, bins, ridge
        self.base, self.cuts, self.nodes = 0.0, [], []
        self.scale = (1.0, 0.0)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(self.cuts)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.cuts = []
        for k in range(x.shape[1]):
            values = np.unique(x[:, k])
            self.cuts.append(((values[1:] + values[:-1]) / 2) if len(values) <= self.bins else np.unique(np.quantile(x[:, k], np.arange(1, self.bins) / self.bins)))
        b = self._binned(x)
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(y), self.base)
        width = self.bins + 1
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            leaf = np.zeros(len(y), np.int64)
            splits = []
            for level in range(self.depth):
                count = 1 << level
                gain = np.full(count, 1e-6)
                best = np.zeros((count, 2), np.int64)
                best[:, 1] = width  # no split: all to the left
                for f in range(x.shape[1]):
                    slot = leaf * width + b[:, f]
                    gs = np.cumsum(np.bincount(slot, g, count * width).reshape(count, width), axis=1)
                    hs = np.cumsum(np.bincount(slot, h, count * width).reshape(count, width), axis=1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    score = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    at = score.argmax(axis=1)
                    top = score[np.arange(count), at]
                    better = top > gain
                    gain[better] = top[better]
                    best[better, 0], best[better, 1] = f, at[better]
                splits.append(best)
                leaf = leaf * 2 + (b[np.arange(len(b)), best[leaf, 0]] > best[leaf, 1])
            size = 1 << self.depth
            value = -self.rate * np.bincount(leaf, g, size) / (np.bincount(leaf, h, size) + self.ridge)
            self.nodes.append((splits, value))
            margin += value[leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        b = self._binned(x)
        rows = np.arange(len(b))
        for splits, value in self.nodes:
            leaf = np.zeros(len(b), np.int64)
            for best in splits:
                leaf = leaf * 2 + (b[rows, best[leaf, 0]] > best[leaf, 1])
            out += value[leaf]
        return out

    def calibrate(self, x: np.ndarray, y: np.ndarray, rounds: int = 30) -> BoostedTrees:
        """Platt scaling with smoothed targets on rows that the trees were not fitted on."""
        return self.calibrate_margins(self.margin(x), y, np.ones(len(y)), rounds)

    def calibrate_margins(self, m: np.ndarray, y: np.ndarray, count: np.ndarray, rounds: int = 30) -> BoostedTrees:
        """The same for so many rows of each margin and label."""
        up, down = (y * count).sum(), ((1 - y) * count).sum()
        target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        z = np.stack([m, np.ones(len(m))], axis=1)
        w = np.array([1.0, 0.0])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (count * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ z + 1e-4 * np.eye(2), z.T @ (count * (p - target)))
            w -= np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-6:
                break
        self.scale = (float(w[0]), float(w[1]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.probability(self.margin(x))

    def probability(self, margin: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
