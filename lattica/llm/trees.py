"""Gradient-boosted trees in flat numpy node arrays, with monotonic constraints."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees of one depth side by side: node arrays of shape (trees, nodes), children of node k at 2k+1 and 2k+2.

    A leaf above the last level repeats itself through a threshold of infinity, so every walk has the same length.
    """

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds for each row of x; all rows and trees take a step at a time."""
        at = np.zeros((len(x), len(self.feature)), np.int64)
        tree = np.arange(len(self.feature))[None, :]
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = 2 * at + 1 + (x[row, self.feature[tree, at]] > self.threshold[tree, at])
        return self.base + self.value[tree, at].sum(1)


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: int = 10) -> Forest:
    """Newton boosting of the logistic loss over quantile bins.

    monotone: feature -> +1 (score never falls as it grows) or -1. A split that breaks its constraint is refused, and
    the halves of a constrained split are held on their sides of the middle of their values, so that deeper splits
    can't cross it. Without rows, or with one class, the score is constant.
    """
    n, width = x.shape
    nodes = 2 ** (depth + 1) - 1
    rate_of = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(rate_of / (1 - rate_of)))
    if n == 0 or y.min() == y.max():
        trees = 0
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)] if trees else []
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1) if trees else None
    feature = np.zeros((trees, nodes), np.int64)
    threshold = np.full((trees, nodes), np.inf)
    value = np.zeros((trees, nodes))
    score = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        work = [(0, np.arange(n), -np.inf, np.inf)]
        while work:
            k, rows, low, high = work.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            own = float(np.clip(g / (h + ridge), low, high))
            value[t, k] = own
            best = (1e-9, None)
            if 2 * k + 2 < nodes and len(rows) >= 2 * least:
                for j in range(width):
                    size = len(edges[j]) + 1
                    gl = np.bincount(codes[rows, j], grad[rows], size).cumsum()[:-1]
                    hl = np.bincount(codes[rows, j], hess[rows], size).cumsum()[:-1]
                    nl = np.bincount(codes[rows, j], minlength=size).cumsum()[:-1]
                    vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip((g - gl) / (h - hl + ridge), low, high)
                    gain = 2 * (gl * vl + (g - gl) * vr) - (hl + ridge) * vl**2 - (h - hl + ridge) * vr**2 - (2 * g * own - (h + ridge) * own**2)
                    allowed = (nl >= least) & (len(rows) - nl >= least) & ((vr - vl) * monotone.get(j, 0) >= 0)
                    gain = np.where(allowed, gain, -1)
                    if len(gain) and gain.max() > best[0]:
                        c = int(gain.argmax())
                        best = (gain[c], (j, c, (vl[c] + vr[c]) / 2))
            if best[1] is None:
                # a leaf: the left child, and its left child, carry its value down to the last level
                while 2 * k + 1 < nodes:
                    k = 2 * k + 1
                    value[t, k] = own
                continue
            j, c, middle = best[1]
            feature[t, k], threshold[t, k] = j, edges[j][c]
            left = codes[rows, j] <= c
            sign = monotone.get(j, 0)
            bounds = [(low, middle), (middle, high)] if sign > 0 else [(middle, high), (low, middle)] if sign < 0 else [(low, high)] * 2
            work += [(2 * k + 1, rows[left], *bounds[0]), (2 * k + 2, rows[~left], *bounds[1])]
        value[t] *= rate
        one = Forest(0.0, feature[t : t + 1], threshold[t : t + 1], value[t : t + 1], depth)
        score = score + one.score(x)
    return Forest(base, feature, threshold, value, depth)
