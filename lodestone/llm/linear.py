"""Linear hinge-loss models by dual coordinate descent, on sparse rows."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows: the indices and values of row i are those from at[i] to at[i + 1]."""

    def __init__(self, at: np.ndarray, indices: np.ndarray, values: np.ndarray):
        self.at, self.indices, self.values = at, indices, values

    def __len__(self) -> int:
        return len(self.at) - 1

    @classmethod
    def of(cls, rows: list[tuple[np.ndarray, np.ndarray]]) -> Rows:
        at = np.concatenate([[0], np.cumsum([len(i) for i, _ in rows])]).astype(np.int64)
        if not rows:
            return cls(at, np.zeros(0, np.int64), np.zeros(0))
        return cls(at, np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]))

    def take(self, which: np.ndarray) -> Rows:
        return Rows.of([(self.indices[self.at[i] : self.at[i + 1]], self.values[self.at[i] : self.at[i + 1]]) for i in which])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        doc = np.repeat(np.arange(len(self)), np.diff(self.at))
        return np.bincount(doc, weights[self.indices] * self.values, minlength=len(self))


def svm(rows: Rows, sign: np.ndarray, dims: int, *, cost: float = 1.0, epochs: int = 15, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * sum of squared hinge losses; sign is +1 or -1 for each row.

    Dual coordinate descent: one dual variable a row, each step solves for one exactly; the bias is a feature of value 1.
    """
    weights, bias = np.zeros(dims), 0.0
    alpha = np.zeros(len(rows))
    ridge = 1 / (2 * cost)
    square = np.array([rows.values[a:b] @ rows.values[a:b] for a, b in zip(rows.at[:-1], rows.at[1:], strict=True)]) + 1 + ridge if len(rows) else np.zeros(0)
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            a, b = rows.at[i], rows.at[i + 1]
            idx, val = rows.indices[a:b], rows.values[a:b]
            slope = sign[i] * (weights[idx] @ val + bias) - 1 + ridge * alpha[i]
            new = max(alpha[i] - slope / square[i], 0.0)
            if (step := (new - alpha[i]) * sign[i]) != 0.0:
                weights[idx] += step * val
                bias += step
                alpha[i] = new
                worst = max(worst, abs(slope))
        if worst < 1e-3:
            break
    return weights, bias


def platt(margin: np.ndarray, label: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """(a, b) of the logistic curve 1 / (1 + exp(-(a m + b))) that fits labels 0 and 1, by Newton steps on smoothed targets."""
    pos = label.sum()
    neg = len(label) - pos
    target = np.where(label > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * margin + b)
        g, h = p - target, np.maximum(p * (1 - p), 1e-9)
        grad = np.array([g @ margin, g.sum()])
        hess = np.array([[h @ margin**2, h @ margin], [h @ margin, h.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        move /= max(1.0, np.abs(move).max())
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return max(a, 1e-6), b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
