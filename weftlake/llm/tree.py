"""A small decision tree (CART, Gini) in numpy."""

from __future__ import annotations

import numpy as np


class Tree:
    """Binary classification tree over numeric features.

    Splits lie halfway between neighbouring values and leave ``min_leaf`` rows
    on either side; growth ends when a node is pure, at ``max_depth`` or when no
    split lowers the impurity.
    """

    def __init__(self, max_depth: int = 8, min_leaf: int = 1) -> None:
        self.max_depth, self.min_leaf = max_depth, min_leaf
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.label: list[bool] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Tree":
        self._grow(np.asarray(x, float), np.asarray(y, bool), 0)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        me = len(self.feature)
        self.feature.append(-1)
        self.cut.append(0.0)
        self.left.append(0)
        self.right.append(0)
        self.label.append(bool(2 * y.sum() >= len(y)))
        best = self._best_split(x, y) if 0 < y.sum() < len(y) and depth < self.max_depth else None
        if best:
            j, cut = best
            low = x[:, j] <= cut
            self.feature[me], self.cut[me] = j, cut
            self.left[me] = self._grow(x[low], y[low], depth + 1)
            self.right[me] = self._grow(x[~low], y[~low], depth + 1)
        return me

    def _best_split(self, x: np.ndarray, y: np.ndarray) -> tuple[int, float] | None:
        n, total = len(y), y.sum()
        least, best = 2 * total * (n - total) / n - 1e-9, None
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, hits = x[order, j], np.cumsum(y[order])[:-1]
            size = np.arange(1, n)
            rest, rest_hits = n - size, total - hits
            impurity = 2 * hits * (size - hits) / size + 2 * rest_hits * (rest - rest_hits) / rest
            impurity[(v[1:] == v[:-1]) | (size < self.min_leaf) | (rest < self.min_leaf)] = np.inf
            k = int(np.argmin(impurity)) if n > 1 else 0
            if n > 1 and impurity[k] < least - 1e-12:
                least, best = impurity[k], (j, float((v[k] + v[k + 1]) / 2))
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Labels of the rows of ``x``, found level by level for all rows at once."""
        x = np.asarray(x, float)
        feature, cut = np.array(self.feature), np.array(self.cut)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(x), int)
        rows = np.arange(len(x))
        for _ in range(self.max_depth + 1):
            j = feature[at]
            inner = j >= 0
            if not inner.any():
                break
            goes_left = x[rows, np.maximum(j, 0)] <= cut[at]
            at = np.where(inner, np.where(goes_left, left[at], right[at]), at)
        return np.array(self.label)[at]
