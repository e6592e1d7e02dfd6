"""Small gradient-boosted trees over dense features, fitted on the driver from a bounded sample."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """Parallel arrays of nodes; feature -1 marks a leaf.  A row goes left if its value <= threshold."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        feature, threshold, left, right, value = (np.array(v) for v in (self.feature, self.threshold, self.left, self.right, self.value))
        rows = np.arange(len(x))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return value[at]
            goes = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(goes, left[at], right[at]), at)


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, cuts: list[np.ndarray], least: int, l2: float, some: np.ndarray) -> Tree:
    tree = Tree([], [], [], [], [])

    def node(rows: np.ndarray, d: int) -> int:
        me = len(tree.feature)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        for column, v in zip((tree.feature, tree.threshold, tree.left, tree.right, tree.value), (-1, 0.0, me, me, float(-total_g / (total_h + l2))), strict=True):
            column.append(v)
        if d == 0 or len(rows) < 2 * least:
            return me
        best, base = (1e-6, -1, 0.0), total_g**2 / (total_h + l2)
        for f in some:
            if not len(cuts[f]):
                continue
            bins = np.searchsorted(cuts[f], x[rows, f], side="left")
            n = len(cuts[f]) + 1
            gl, hl, nl = (np.cumsum(np.bincount(bins, weights=w, minlength=n))[:-1] for w in (g[rows], h[rows], np.ones(len(rows))))
            gain = gl**2 / (hl + l2) + (total_g - gl) ** 2 / (total_h - hl + l2) - base
            gain[(nl < least) | (len(rows) - nl < least)] = -1
            at = int(np.argmax(gain))
            if gain[at] > best[0]:
                best = (float(gain[at]), int(f), float(cuts[f][at]))
        if best[1] < 0:
            return me
        goes = x[rows, best[1]] <= best[2]
        tree.feature[me], tree.threshold[me] = best[1], best[2]
        tree.left[me] = node(rows[goes], d - 1)
        tree.right[me] = node(rows[~goes], d - 1)
        return me

    node(np.arange(len(x)), depth)
    return tree


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += self.rate * t.predict(x)
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit_boosted(x: np.ndarray, y: np.ndarray, *, trees: int = 30, depth: int = 3, rate: float = 0.3, least: int = 5, l2: float = 1.0, bins: int = 64, features: float = 1.0, rows: float = 1.0, seed: int = 7) -> Boosted:
    """Logistic loss, second-order leaves; ``features`` and ``rows`` are the shares each tree sees."""
    p = float(np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3))
    model = Boosted(float(np.log(p / (1 - p))), rate, [])
    if len(y) < 2 * least or y.min() == y.max():
        return model
    rng = np.random.default_rng(seed)
    cuts = []
    for f in range(x.shape[1]):
        u = np.unique(x[:, f])
        edges = (u[:-1] + u[1:]) / 2
        cuts.append(edges if len(edges) <= bins else np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])))
    margin = np.full(len(y), model.base)
    for _ in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        pick = rng.random(len(y)) < rows if rows < 1 else np.ones(len(y), bool)
        some = np.sort(rng.choice(x.shape[1], max(1, round(features * x.shape[1])), replace=False))
        tree = _grow(x[pick], (prob - y)[pick], (prob * (1 - prob))[pick], depth, cuts, least, l2, some)
        margin += rate * tree.predict(x)
        model.trees.append(tree)
    return model
