"""Gradient-boosted trees for two classes, on small dense tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from lodestone.llm.linear import platt, sigmoid


@dataclass
class Trees:
    """Trees of one depth: feature and bound of each inner node, level by level, and the value of each leaf."""

    start: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, bound, value in self.trees:
            at = np.zeros(len(x), np.int64)
            while len(x) and at[0] < len(feature):
                at = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
            total += value[at - len(feature)]
        return total

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.slope * self.margins(x) + self.shift)


def fit(x: np.ndarray, y: np.ndarray, *, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0) -> Trees:
    """Logistic loss, Newton leaf values; a node is split where that gains most over quantile bounds."""
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Trees(start=float(np.log(share / (1 - share))))
    bounds = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    codes = np.stack([np.searchsorted(b, x[:, j]) for j, b in enumerate(bounds)], axis=1)
    margin, inner = np.full(len(x), model.start), 2**depth - 1
    for _ in range(rounds):
        p = sigmoid(margin)
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, bound = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(x), np.int64)
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            best = 1e-6
            total_g, total_h = g[rows].sum(), h[rows].sum()
            for j, b in enumerate(bounds):
                if not len(b) or len(rows) < 10:
                    continue
                left_g = np.cumsum(np.bincount(codes[rows, j], g[rows], len(b) + 1))[:-1]
                left_h = np.cumsum(np.bincount(codes[rows, j], h[rows], len(b) + 1))[:-1]
                gain = left_g**2 / (left_h + ridge) + (total_g - left_g) ** 2 / (total_h - left_h + ridge) - total_g**2 / (total_h + ridge)
                k = int(gain.argmax())
                if gain[k] > best:
                    best, feature[at], bound[at] = gain[k], j, b[k]
            node[rows] = 2 * at + 1 + (x[rows, feature[at]] > bound[at])
        leaf = node - inner
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        margin += value[leaf]
        model.trees.append((feature, bound, value))
    return model


def calibrate(model: Trees, x: np.ndarray, y: np.ndarray) -> None:
    model.slope, model.shift = platt(model.margins(x), y)
