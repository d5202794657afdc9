"""Small gradient-boosted trees on numpy: logistic loss, histogram splits, depth-limited, with Platt calibration.

Defined results: features are numbers without NaN; equal rows get equal scores; of equal gains the first feature and
the lowest split win; labels of one kind only give a constant near that label's rate; no rows to score give none.
"""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """fit(X, y) and proba(X); every tree has depth levels of splits on feature <= value, all rows use every feature."""

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0, least: int = 5):
        self.rounds, self.depth, self.rate, self.bins, self.l2, self.least = rounds, depth, rate, bins, l2, least
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.base, self.platt = 0.0, (1.0, 0.0)

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(e, x[:, j]) for j, e in enumerate(edges)], 1)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(rate / (1 - rate)))
        score = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, p * (1 - p)
            nodes = 2 ** (self.depth + 1) - 1
            feature, value, leaf = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
            at = np.zeros(len(y), int)
            for node in range(nodes):
                rows = np.flatnonzero(at == node)
                if not len(rows):
                    continue
                gs, hs = g[rows].sum(), h[rows].sum()
                leaf[node] = self.rate * gs / (hs + self.l2)
                if node >= 2**self.depth - 1:
                    continue
                best = (1e-6, -1, 0)
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    c = code[rows, j]
                    gl, hl, nl = (np.bincount(c, w, len(e) + 1).cumsum()[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
                    gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (gain[k], j, k)
                if best[1] >= 0:
                    feature[node], value[node] = best[1], edges[best[1]][best[2]]
                    at[rows] = np.where(code[rows, best[1]] <= best[2], 2 * node + 1, 2 * node + 2)
            self.trees.append((feature, value, leaf))
            score += self._leaf(x, self.trees[-1])
        return self

    def _leaf(self, x: np.ndarray, tree: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        feature, value, leaf = tree
        at = np.zeros(len(x), int)
        for _ in range(self.depth):
            f = feature[at]
            down = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= value[at], 2 * at + 1, 2 * at + 2)
            at = np.where(f >= 0, down, at)
        return leaf[at]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((self._leaf(x, t) for t in self.trees), np.zeros(len(x)))

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 200) -> BoostedTrees:
        """Platt scaling on rows that fit() did not see."""
        s, (a, b) = self.raw(x), self.platt
        for _ in range(steps):  # Newton steps of a logistic regression on one input
            p = 1 / (1 + np.exp(-(a * s + b)))
            w = p * (1 - p) + 1e-6
            grad = np.array([((y - p) * s).sum() - 1e-2 * a, (y - p).sum()])
            hess = np.array([[(w * s * s).sum() + 1e-2, (w * s).sum()], [(w * s).sum(), w.sum()]])
            step = np.linalg.solve(hess, grad)
            a, b = a + step[0], b + step[1]
            if abs(step).max() < 1e-9:
                break
        self.platt = (float(a), float(b))
        return self

    def proba(self, x: np.ndarray) -> np.ndarray:
        a, b = self.platt
        return 1 / (1 + np.exp(-np.clip(a * self.raw(x) + b, -50, 50)))
