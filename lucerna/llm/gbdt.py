"""Histogram gradient-boosted trees for a bounded sample, and their flattened form for scoring.

Training sees binned features (at most ``bins`` quantile cuts each); every level of a tree is
chosen from gradient and hessian histograms.  A finished model is five arrays with one row per
tree (complete binary trees), so scoring a batch is ``depth`` vectorised gathers.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Forest:
    """``feature``/``threshold``: trees x inner nodes; ``value``: trees x leaves."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Sum of leaf values for each row of ``x``."""
        if not len(x):
            return np.zeros(0)
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            right = x[rows, self.feature[trees, node]] > self.threshold[trees, node]
            node = 2 * node + 1 + right
        return self.base + self.value[trees, node - (2**self.depth - 1)].sum(axis=1)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, l2: float = 1.0, least_hessian: float = 1.0) -> Forest:
    """Logistic loss, level-wise growth.  With no rows or one class the forest is a constant."""
    n, width = x.shape
    prior = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(prior / (1 - prior)))
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int32)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    if n == 0 or len(np.unique(y)) < 2:
        return Forest(feature, threshold, value, base, depth)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(width)], 1)
    margin = np.full(n, base)
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            local = node - first
            best = np.full(count, 1e-9)
            for j in range(width):
                if not len(cuts[j]):
                    continue
                slots = len(cuts[j]) + 1
                at = local * slots + binned[:, j]
                gl = np.bincount(at, g, count * slots).reshape(count, slots).cumsum(1)
                hl = np.bincount(at, h, count * slots).reshape(count, slots).cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt**2 / (ht + l2)
                gain[(hl < least_hessian) | (ht - hl < least_hessian)] = 0
                cut = gain[:, :-1].argmax(1)
                better = gain[np.arange(count), cut] > best
                best[better] = gain[np.arange(count), cut][better]
                feature[t, first : first + count][better] = j
                threshold[t, first : first + count][better] = cuts[j][cut][better]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, leaves), np.bincount(leaf, h, leaves)
        value[t] = -rate * gs / (hs + l2)
        margin += value[t, leaf]
    return Forest(feature, threshold, value, base, depth)


@dataclass(frozen=True)
class Isotonic:
    """A non-decreasing piecewise-linear map from score to probability."""

    at: np.ndarray
    to: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.at, self.to) if len(self.at) else np.asarray(score, float)


def isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators on (score, label); equal scores are pooled first."""
    if not len(score):
        return Isotonic(np.zeros(0), np.zeros(0))
    at, inverse, weight = np.unique(score, return_inverse=True, return_counts=True)
    mean = np.bincount(inverse, y) / weight
    blocks: list[list[float]] = []
    for s, m, w in zip(at, mean, weight, strict=True):
        blocks.append([m, w, s, s])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, hi = blocks.pop()
            m1, w1, lo, _ = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    xs, ys = [], []
    for m, _, lo, hi in blocks:
        xs += [lo] if lo == hi else [lo, hi]
        ys += [m] if lo == hi else [m, m]
    return Isotonic(np.array(xs), np.array(ys))
