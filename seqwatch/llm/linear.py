"""Logistic regression on sparse binary features, fitted on a bounded sample."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


class Rows:
    """Sparse binary rows with some dense columns beside them."""

    #: Rows gone through at once: what is made of their features is many times as large as these.
    AT_ONCE = 3000

    def __init__(self, indices: list, n_features: int, dense: np.ndarray | None = None):
        self.lengths = np.array([len(x) for x in indices], dtype=np.int64)
        self.flat = np.concatenate([np.asarray(x, dtype=np.int64) for x in indices]) if len(indices) else np.empty(0, np.int64)
        self.ends = np.concatenate([[0], np.cumsum(self.lengths)])
        self.dense = dense if dense is not None else np.zeros((len(indices), 0))
        self.n_features = n_features

    def _parts(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some rows at a time: which, their features, and the row of each, from 0."""
        for start in range(0, len(self.lengths), self.AT_ONCE):
            rows = slice(start, min(start + self.AT_ONCE, len(self.lengths)))
            yield rows, self.flat[self.ends[rows.start] : self.ends[rows.stop]], np.repeat(np.arange(rows.stop - start), self.lengths[rows])

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """weights: a row per feature, then per dense column; a column per class."""
        out = np.zeros((len(self.lengths), weights.shape[1]))
        for rows, features, row in self._parts():
            for k in range(weights.shape[1]):
                out[rows, k] = np.bincount(row, weights[: self.n_features, k][features], rows.stop - rows.start)
        return out + self.dense @ weights[self.n_features :]

    def gathered(self, rest: np.ndarray) -> np.ndarray:
        """The product of the transposed rows with ``rest``."""
        out = np.zeros((self.n_features, rest.shape[1]))
        for rows, features, row in self._parts():
            for k in range(rest.shape[1]):
                out[:, k] += np.bincount(features, rest[rows, k][row], self.n_features)
        return np.concatenate([out, self.dense.T @ rest])

    def shares(self, weight: np.ndarray) -> np.ndarray:
        """Each feature's weight over the rows that have it."""
        return self.gathered(weight[:, None])[: self.n_features, 0]


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def fit(rows: Rows, target: np.ndarray, weight: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights (features, dense columns and a last row of biases; a column per class) for a one-hot ``target``.

    Nesterov's accelerated gradient with a ridge penalty; the step follows the largest curvature. Features
    are scaled by how often they occur, so that rare ones are learnt as fast as common ones and not shrunk more.
    """
    k = target.shape[1]
    width = rows.n_features + rows.dense.shape[1]
    weight = weight / weight.sum()
    share = rows.shares(weight)
    scale = np.ones((width + 1, 1))
    scale[: rows.n_features, 0] = 1 / np.sqrt(np.maximum(share, weight.max()))

    def forward(w: np.ndarray) -> np.ndarray:
        w = w * scale
        return rows.dot(w[:-1]) + w[-1]

    def backward(rest: np.ndarray) -> np.ndarray:
        return np.concatenate([rows.gathered(rest), rest.sum(axis=0, keepdims=True)]) * scale

    probe = np.ones((width + 1, 1))
    for _ in range(12):
        probe = backward(weight[:, None] * forward(probe))
        largest = np.linalg.norm(probe)
        probe /= largest or 1.0
    step = 1 / (0.5 * 1.1 * largest + penalty)
    w = ahead = np.zeros((width + 1, k))
    for i in range(rounds):
        rest = weight[:, None] * (softmax(forward(ahead)) - target)
        slope = backward(rest)
        slope[:-1] += penalty * ahead[:-1]
        moved = ahead - step * slope
        ahead = moved + i / (i + 3) * (moved - w)
        w = moved
    return w * scale
