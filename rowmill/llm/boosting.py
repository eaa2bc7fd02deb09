"""Gradient-boosted trees of depth two for small feature tables (logistic loss)."""

from __future__ import annotations

import numpy as np


class Boosted:
    """fit(x, y) on a bounded sample; score(x) gives probabilities. Ties between splits go to
    the first feature and the lowest threshold, so a fit is deterministic."""

    def __init__(self, rounds: int = 40, rate: float = 0.3, bins: int = 16, least: int = 5):
        self.rounds, self.rate, self.bins, self.least = rounds, rate, bins, least
        self.base, self.trees = 0.0, []

    def _split(self, x: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, float, float] | None:
        best = None
        total_g, total_h = g.sum(), h.sum()
        for f in range(x.shape[1]):
            for t in self.cuts[f]:
                left = x[:, f] <= t
                n = int(left.sum())
                if n < self.least or len(g) - n < self.least:
                    continue
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl * gl / (hl + 1) + (total_g - gl) ** 2 / (total_h - hl + 1) - total_g**2 / (total_h + 1)
                if best is None or gain > best[0] + 1e-12:
                    best = (gain, f, float(t))
        return best and (best[1], best[2], best[0])

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        share = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
        self.base = float(np.log(share / (1 - share)))
        self.trees = []
        if len(y) == 0 or y.min() == y.max():
            return self
        self.cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) for f in range(x.shape[1])]
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            g, h = y - p, p * (1 - p)
            root = self._split(x, g, h)
            if root is None:
                break
            f, t, _ = root
            side = x[:, f] <= t
            leaves = []
            for part in (side, ~side):
                below = self._split(x[part], g[part], h[part])
                if below is None or below[2] < 1e-6:
                    leaves.append((-1, 0.0, *[self.rate * g[part].sum() / (h[part].sum() + 1)] * 2))
                else:
                    low = part & (x[:, below[0]] <= below[1])
                    high = part & ~low
                    leaves.append((below[0], below[1], self.rate * g[low].sum() / (h[low].sum() + 1), self.rate * g[high].sum() / (h[high].sum() + 1)))
            self.trees.append((f, t, leaves))
            z += self._tree(x, self.trees[-1])
        del self.cuts
        return self

    @staticmethod
    def _tree(x: np.ndarray, tree: tuple) -> np.ndarray:
        f, t, leaves = tree
        out = np.zeros(len(x))
        side = x[:, f] <= t
        for part, (f2, t2, low, high) in zip((side, ~side), leaves):
            out[part] = np.where(x[part, f2] <= t2, low, high) if f2 >= 0 else low
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for tree in self.trees:
            z += self._tree(x, tree)
        return 1 / (1 + np.exp(-z))
