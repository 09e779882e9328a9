"""Gradient-boosted trees on a bounded sample, and calibrated probabilities."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Tree:
    """A complete binary tree: inner node k has children 2k+1 and 2k+2."""

    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        inner = len(self.feature)
        for _ in range(int(np.log2(inner + 1))):
            node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[node]] > self.cut[node])
        return self.value[node - inner]


@dataclass(frozen=True)
class Booster:
    start: float
    rate: float
    trees: list[Tree]

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.start + self.rate * sum((t.predict(x) for t in self.trees), np.zeros(len(x)))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _grow(binned: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, depth: int, ridge: float) -> Tree:
    inner = 2**depth - 1
    feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
    node = np.zeros(len(grad), np.int64)
    columns = binned.shape[1]
    for level in range(depth):
        first, width = 2**level - 1, 2**level
        local = node - first
        g = np.stack([np.bincount(local * BINS + binned[:, f], grad, width * BINS) for f in range(columns)]).reshape(columns, width, BINS)
        h = np.stack([np.bincount(local * BINS + binned[:, f], hess, width * BINS) for f in range(columns)]).reshape(columns, width, BINS)
        left_g, left_h = g.cumsum(2), h.cumsum(2)
        all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
        gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
        gain[(left_h < 1e-3) | (all_h - left_h < 1e-3)] = 0
        for k in range(width):
            best = int(gain[:, k].argmax())
            f, b = divmod(best, BINS)
            if gain[f, k, b] > 1e-9 and b < len(cuts[f]):
                feature[first + k], cut[first + k] = f, cuts[f][b]
        at = feature[node]
        # A bin b holds values above cuts[b-1] and up to cuts[b].
        goes = np.array([np.searchsorted(cuts[f], c, "left") if np.isfinite(c) else BINS for f, c in zip(feature, cut)])[node]
        node = 2 * node + 1 + (binned[np.arange(len(node)), at] > goes)
    leaf = node - inner
    total_g, total_h = np.bincount(leaf, grad, inner + 1), np.bincount(leaf, hess, inner + 1)
    return Tree(feature, cut, -total_g / (total_h + ridge))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, ridge: float = 1.0) -> Booster:
    """Logistic boosting of 0/1 labels; both labels weigh the same in total."""
    positive = y.mean()
    if positive in (0.0, 1.0):
        return Booster(8.0 if positive else -8.0, rate, [])
    weight = np.where(y == 1, 0.5 / positive, 0.5 / (1 - positive))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="midpoint")) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(x.shape[1])], axis=1)
    margin, trees = np.zeros(len(y)), []
    for _ in range(rounds):
        p = _sigmoid(margin)
        tree = _grow(binned, cuts, weight * (p - y), weight * p * (1 - p), depth, ridge)
        trees.append(tree)
        margin += rate * tree.predict(x)
    return Booster(0.0, rate, trees)


def calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through held-out margins (Platt, with his smoothed targets), by grid."""
    n1, n0 = y.sum(), len(y) - y.sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    best = (np.inf, 1.0, 0.0)
    for a in np.geomspace(0.25, 4, 25):
        for b in np.linspace(-4, 4, 33):
            z = a * margin + b
            loss = float((np.logaddexp(0, z) - target * z).sum())
            best = min(best, (loss, float(a), float(b)))
    return best[1], best[2]
