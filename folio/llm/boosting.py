"""Gradient-boosted trees on logistic loss over dense features, and isotonic calibration; numpy, for bounded training sets."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

BINS = 64


@dataclass
class Tree:
    """A tree of fixed depth as arrays: node i has children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int

    def apply(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            f = self.feature[node]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > self.threshold[node])
            node = 2 * node + 1 + right
        return self.value[node]


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree in self.trees:
            out += self.rate * tree.apply(x)
        return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, least: float = 0.3, penalty: float = 1.0) -> Boosted:
    """Newton boosting over quantile histograms. Splits need ``least`` summed hessian on both sides; the result only depends on the rows, in any order up to rounding."""
    share = np.clip(y.mean() if len(y) else 0.0, 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(share / (1 - share))), rate)
    if len(np.unique(y)) < 2:
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    margin = np.full(len(y), model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size), np.zeros(size), depth)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.zeros(n)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                at = (node - first) * BINS + bins[:, j]
                gs = np.cumsum(np.bincount(at, g, n * BINS).reshape(n, BINS), axis=1)
                hs = np.cumsum(np.bincount(at, h, n * BINS).reshape(n, BINS), axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + penalty) + (gt - gs) ** 2 / (ht - hs + penalty) - gt**2 / (ht + penalty)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(e) :] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(n), k] > best + 1e-9
                best[better] = gain[np.arange(n), k][better]
                tree.feature[first : first + n][better] = j
                tree.threshold[first : first + n][better] = e[k[better]]
            f = tree.feature[node]
            right = (f >= 0) & (x[np.arange(len(x)), np.maximum(f, 0)] > tree.threshold[node])
            node = 2 * node + 1 + right
        gs, hs = np.bincount(node, g, size), np.bincount(node, h, size)
        tree.value = -gs / (hs + penalty)
        model.trees.append(tree)
        margin += rate * tree.apply(x)
    return model


@dataclass
class Isotonic:
    """A non-decreasing piecewise-linear map from margins to probabilities."""

    at: np.ndarray
    value: np.ndarray

    def apply(self, margin: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(margin, self.at, self.value), 0.0, 1.0)


def fit_isotonic(margin: np.ndarray, y: np.ndarray, prior: float = 1.0) -> Isotonic:
    """Pool adjacent violators over the rows sorted by margin; each pool is drawn towards the mean by ``prior`` rows."""
    if not len(y):
        return Isotonic(np.zeros(1), np.zeros(1))
    at, inverse = np.unique(margin, return_inverse=True)
    pools: list[list[float]] = []  # labels, rows, margin sum
    for s, n, m in zip(np.bincount(inverse, y), np.bincount(inverse), at * np.bincount(inverse), strict=True):
        pools.append([s, n, m])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    s, n, m = np.array(pools, float).T
    return Isotonic(m / n, np.maximum.accumulate((s + prior * y.mean()) / (n + prior)))
