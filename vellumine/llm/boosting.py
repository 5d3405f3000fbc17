"""Gradient-boosted trees on binned features, and isotonic regression, in NumPy."""
from __future__ import annotations

import numpy as np


class Trees:
    """Logistic loss, trees of a fixed depth on quantile bins, Newton leaves."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.15, bins: int = 64, ridge: float = 5.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.least = rounds, depth, rate, bins, ridge, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        n, k = x.shape
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(k)]
        # A feature that is mostly one value still gets cuts among the others.
        self.cuts = [np.unique(np.concatenate([c, np.quantile(v, np.linspace(0, 1, 17)[:-1])])) if len(v := x[x[:, j] > 0, j]) else c for j, c in enumerate(self.cuts)]
        binned = self._binned(x)
        width = max(len(c) for c in self.cuts) + 1
        rate = min(max(y.mean(), 1e-4), 1 - 1e-4)
        self.base = float(np.log(rate / (1 - rate)))
        margin = np.full(n, self.base)
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        flat = binned + np.arange(k) * width
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = y - p, p * (1 - p)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, width, np.int64)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, nodes = 2**level - 1, 2**level
                at = ((node - first) * (k * width))[:, None] + flat
                sums = [np.bincount(at.ravel(), np.repeat(v, k), nodes * k * width).reshape(nodes, k, width) for v in (g, h, np.ones(n))]
                left = [np.cumsum(s, axis=2) for s in sums]
                total = [s[:, :, -1:] for s in left]
                score = lambda a, b: a * a / (b + self.ridge)
                gain = score(left[0], left[1]) + score(total[0] - left[0], total[1] - left[1]) - score(total[0], total[1])
                gain[(left[2] < self.least) | (total[2] - left[2] < self.least)] = 0
                best = gain.reshape(nodes, -1).argmax(axis=1)
                good = gain.reshape(nodes, -1).max(axis=1) > 1e-6
                feature[first : first + nodes] = best // width
                cut[first : first + nodes] = np.where(good, best % width, width)
                node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.ridge)
            margin += value[leaf]
            self.trees.append((feature, cut, value))
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, out = self._binned(x), np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += value[node - (2**self.depth - 1)]
        return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; knots (mean x, mean y) of the pooled blocks, both rising."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(x[order], y[order]):
        blocks.append([a, float(b), 1.0])
        while len(blocks) > 1 and blocks[-2][1] / blocks[-2][2] >= blocks[-1][1] / blocks[-1][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])
