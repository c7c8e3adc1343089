"""A small random forest over a bounded table of numbers: bootstrap rows, square-root features, Gini splits."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Nodes of all trees in arrays; a leaf's feature is -1. roots: each tree's first node."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 7) -> "Forest":
        rng = np.random.default_rng(seed)
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, -1, -1, share])
            if level < depth and len(rows) >= 2 * least and 0 < share < 1:
                best = None
                for f in rng.choice(x.shape[1], max(1, round(x.shape[1] ** 0.5)), replace=False):
                    order = np.argsort(x[rows, f], kind="stable")
                    v, ones = x[rows, f][order], np.cumsum(y[rows][order])
                    cut = np.flatnonzero(v[1:] > v[:-1])
                    n = cut + 1.0
                    ok = (n >= least) & (len(rows) - n >= least)
                    if ok.any():
                        a, b = ones[cut] / n, (ones[-1] - ones[cut]) / (len(rows) - n)
                        impurity = np.where(ok, n * a * (1 - a) + (len(rows) - n) * b * (1 - b), np.inf)
                        k = int(impurity.argmin())
                        if best is None or impurity[k] < best[0]:
                            best = (impurity[k], int(f), (v[cut[k]] + v[cut[k] + 1]) / 2)
                if best:
                    lower = x[rows, best[1]] <= best[2]
                    nodes[at][:2] = best[1:]
                    nodes[at][2] = grow(rows[lower], level + 1)
                    nodes[at][3] = grow(rows[~lower], level + 1)
            return at

        roots = [grow(rng.integers(0, len(y), len(y)), 0) for _ in range(trees)]
        f, t, a, b, v = zip(*nodes, strict=True)
        return cls(np.array(f), np.array(t), np.array(a), np.array(b), np.array(v), np.array(roots))

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Mean share of ones over the trees."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at].mean(axis=1)
            lower = x[rows, np.maximum(f, 0)] <= self.threshold[at]
            at = np.where(inner, np.where(lower, self.left[at], self.right[at]), at)
