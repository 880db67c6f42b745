"""Gradient-boosted trees for small training samples: logistic loss, histogram splits, Newton leaves. Only numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    rounds: int = 60
    depth: int = 3
    rate: float = 0.2
    bins: int = 32
    least: float = 4.0
    l2: float = 1.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        x, y = np.asarray(x, float), np.asarray(y, float)
        w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        b = self._binned(x)
        p = np.clip((w * y).sum() / w.sum(), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            q = 1 / (1 + np.exp(-f))
            g, h = w * (y - q), np.maximum(w * q * (1 - q), 1e-9)
            tree, leaf = self._grow(b, g, h)
            self.trees.append(tree)
            f += tree[2][leaf]
        return self

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray):
        size = 2 ** (self.depth + 1) - 1
        feature, cut, value = np.full(size, -1), np.zeros(size, int), np.zeros(size)
        at = np.zeros(len(g), int)
        for node in range(size):
            rows = np.flatnonzero(at == node)
            if not len(rows):
                continue
            gs, hs = g[rows].sum(), h[rows].sum()
            value[node] = self.rate * gs / (hs + self.l2)
            if node >= size // 2:
                continue
            best = (1e-6, -1, 0)
            for j in range(b.shape[1]):
                m = len(self.edges[j]) + 1
                gl = np.cumsum(np.bincount(b[rows, j], g[rows], m))[:-1]
                hl = np.cumsum(np.bincount(b[rows, j], h[rows], m))[:-1]
                if not len(gl):
                    continue
                gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                gain[(hl < self.least / 16) | (hs - hl < self.least / 16)] = 0
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], j, k)
            if best[1] >= 0:
                feature[node], cut[node] = best[1], best[2]
                at[rows] = 2 * node + 1 + (b[rows, best[1]] > best[2])
        return (feature, cut, value), at

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the positive class."""
        if not len(x):
            return np.zeros(0)
        b = self._binned(np.asarray(x, float))
        f = np.full(len(b), self.base)
        for feature, cut, value in self.trees:
            at = np.zeros(len(b), int)
            for _ in range(self.depth):
                j = feature[at]
                inner = j >= 0
                right = b[np.arange(len(b)), np.maximum(j, 0)] > cut[at]
                at = np.where(inner, 2 * at + 1 + right, at)
            f += value[at]
        return 1 / (1 + np.exp(-f))
