"""Linear classifiers on sparse rows, trained by accelerated gradient steps on all rows; deterministic."""

from __future__ import annotations

import numpy as np


class Rows:
    """Sparse rows, one after another: columns and values; the row of each is not kept, and products are made in place."""

    def __init__(self, columns: list[np.ndarray], values: list[np.ndarray], width: int):
        self.n, self.width = len(columns), width
        self.sizes = np.array([len(c) for c in columns], np.int64)
        self.held = self.sizes > 0
        self.starts = (np.cumsum(self.sizes) - self.sizes)[self.held]
        self.column = np.concatenate([np.empty(0, np.int64), *columns]).astype(np.int64, copy=False)
        self.value = np.concatenate([np.empty(0), *values]).astype(np.float64, copy=False)

    def dot(self, weights: np.ndarray) -> np.ndarray:
        parts = weights[self.column]
        parts *= self.value
        out = np.zeros(self.n)
        if len(parts):
            out[self.held] = np.add.reduceat(parts, self.starts)
        return out

    def back(self, errors: np.ndarray) -> np.ndarray:
        parts = np.repeat(errors, self.sizes)
        parts *= self.value
        return np.bincount(self.column, parts, self.width)


def _steepest(rows: Rows, share: np.ndarray) -> float:
    """Largest eigenvalue, with a margin, of the rows' weighted second moments (with a column of ones), by power steps."""
    w, b, grown = np.ones(rows.width), 1.0, 1.0
    for _ in range(30):
        grown = float(np.sqrt(w @ w + b * b))
        error = share * (rows.dot(w / grown) + b / grown)
        w, b = rows.back(error), float(error.sum())
    return 1.1 * float(np.sqrt(w @ w + b * b)) + 1e-9


def fit(rows: Rows, labels: np.ndarray, loss: str, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights and bias for labels -1 and 1 under the mean loss ("hinge", squared, or "logistic") and penalty * |w|^2 / 2.

    Both classes count alike, however many rows they have.
    """
    share = np.where(labels > 0, 0.5 / max(1, (labels > 0).sum()), 0.5 / max(1, (labels < 0).sum()))
    reach = (2.0 if loss == "hinge" else 0.25) * _steepest(rows, share) + penalty
    w, b = np.zeros(rows.width), 0.0
    v, c, t = w, b, 1.0
    for _ in range(steps):
        margin = labels * (rows.dot(v) + c)
        if loss == "hinge":
            error = -2 * labels * share * np.maximum(0, 1 - margin)
        else:
            error = -labels * share / (1 + np.exp(np.clip(margin, -50, 50)))
        w_next = v - (rows.back(error) + penalty * v) / reach
        b_next = c - error.sum() / reach
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v = w_next + (t - 1) / t_next * (w_next - w)
        c = b_next + (t - 1) / t_next * (b_next - b)
        w, b, t = w_next, b_next, t_next
    return w, b


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))
