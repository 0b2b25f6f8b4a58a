"""Linear models fitted on the driver from bounded samples: dual coordinate descent and score calibration."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of a sparse matrix: column numbers and values, one array each for all rows, cut at `edge`."""

    def __init__(self, idx: np.ndarray, val: np.ndarray, edge: np.ndarray, width: int):
        self.idx, self.val, self.edge, self.width = idx, val, edge, width

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.edge[i], self.edge[i + 1])
        return self.idx[at], self.val[at]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.array([v @ w[k] for k, v in map(self.row, range(len(self.edge) - 1))], np.float64)


def hinge_dual(x: np.ndarray | Sparse, y: np.ndarray, c: np.ndarray | float = 1.0, epochs: int = 30, seed: int = 7, tol: float = 1e-3, rows: np.ndarray | None = None) -> np.ndarray:
    """Weights of a linear SVM (hinge loss, no bias) by dual coordinate descent with shrinking.  y: -1 or 1.

    `rows`: the rows of x that y and c belong to, by default all; they are read in place, not copied.
    """
    n, sparse = len(y), isinstance(x, Sparse)
    rows = np.arange(n) if rows is None else rows
    c = np.broadcast_to(np.asarray(c, np.float64), (n,))
    get = x.row if sparse else lambda i: (slice(None), x[i])
    norms = np.array([float(v @ v) for _, v in map(get, rows)])
    alpha, w, rng = np.zeros(n), np.zeros(x.width if sparse else x.shape[1], np.float32), np.random.default_rng(seed)
    active = np.flatnonzero(norms > 0)
    for epoch in range(epochs):
        worst, keep = 0.0, []
        for i in rng.permutation(active):
            at, v = get(rows[i])
            g = y[i] * float(v @ w[at]) - 1.0
            if alpha[i] == 0 and g > max(worst, 0.1) and epoch > 3:
                continue  # stays at zero
            keep.append(i)
            pg = min(g, 0) if alpha[i] == 0 else max(g, 0) if alpha[i] == c[i] else g
            worst = max(worst, abs(pg))
            if abs(pg) > 1e-9:
                old = alpha[i]
                alpha[i] = min(max(old - g / norms[i], 0.0), c[i])
                if alpha[i] != old:
                    w[at] += np.float32((alpha[i] - old) * y[i]) * v
        if worst < tol:
            if len(keep) == len(active):
                break
            active = np.flatnonzero(norms > 0)
        else:
            active = np.array(keep, np.int64) if len(keep) else active
    return w


def platt(margin: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 50) -> tuple[float, float]:
    """(a, b) such that sigmoid(a * margin + b) estimates the probability of label 1; targets are smoothed.  y: 0 or 1."""
    w = np.ones(len(y)) if weight is None else weight
    pos, neg = (w * y).sum(), (w * (1 - y)).sum()
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    scale = max(float(np.abs(margin).mean()), 1e-9)
    m = margin / scale
    p = np.array([1.0, 0.0])
    for _ in range(rounds):
        s = sigmoid(p[0] * m + p[1])
        g = np.array([(w * (s - t) * m).sum(), (w * (s - t)).sum()]) + 1e-6 * p
        d = w * s * (1 - s) + 1e-12
        h = np.array([[(d * m * m).sum(), (d * m).sum()], [(d * m).sum(), d.sum()]]) + 1e-4 * np.eye(2)
        step = np.linalg.solve(h, g)
        p = p - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(p[0] / scale), float(p[1])


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))
