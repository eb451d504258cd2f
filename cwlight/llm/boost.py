"""Gradient-boosted regression trees for two classes, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Boosted:
    """Trees of one depth on binned features, fitted to logistic loss with Newton leaves."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, penalty: float = 1.0) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], axis=1)

    def _split(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[int, int] | None:
        """(feature, bin): rows with a greater bin go right."""
        best, where = 1e-6, None
        total_g, total_h = g.sum(), h.sum()
        for j in range(b.shape[1]):
            gl = np.cumsum(np.bincount(b[:, j], g, self.bins))[:-1]
            hl = np.cumsum(np.bincount(b[:, j], h, self.bins))[:-1]
            gr, hr = total_g - gl, total_h - hl
            gain = gl**2 / (hl + self.penalty) + gr**2 / (hr + self.penalty) - total_g**2 / (total_h + self.penalty)
            gain[(hl < 1e-3) | (hr < 1e-3)] = 0
            k = int(gain.argmax())
            if gain[k] > best:
                best, where = gain[k], (j, k)
        return where

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        levels = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], levels)) for j in range(x.shape[1])]
        b, y = self._binned(x), y.astype(float)
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(p / (1 - p)))
        f = np.full(len(y), self.start)
        self.trees = []
        for _ in range(self.rounds):
            q = sigmoid(f)
            g, h = y - q, q * (1 - q)
            tree: dict[int, tuple[int, int] | float] = {}
            at = np.zeros(len(y), int)  # node 0 is the root; node k has 2k + 1 and 2k + 2
            for level in range(self.depth + 1):
                for node in range(2**level - 1, 2 ** (level + 1) - 1):
                    rows = np.flatnonzero(at == node)
                    if not len(rows):
                        continue
                    cut = self._split(b[rows], g[rows], h[rows]) if level < self.depth else None
                    if cut is None:
                        tree[node] = self.rate * float(g[rows].sum() / (h[rows].sum() + self.penalty))
                        f[rows] += tree[node]
                        at[rows] = -1
                    else:
                        tree[node] = cut
                        at[rows] = 2 * node + 1 + (b[rows, cut[0]] > cut[1])
            self.trees.append(tree)
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, f = self._binned(x), np.full(len(x), self.start)
        for tree in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(self.depth + 1):
                for node in np.unique(at[at >= 0]):
                    rows, what = np.flatnonzero(at == node), tree.get(int(node), 0.0)
                    if isinstance(what, tuple):
                        at[rows] = 2 * node + 1 + (b[rows, what[0]] > what[1])
                    else:
                        f[rows] += what
                        at[rows] = -1
        return f
