"""Gradient-boosted trees for two classes and isotonic calibration, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    feature: np.ndarray  # of each inner node of a full binary tree; -1: always left
    cut: np.ndarray  # x <= cut goes left
    value: np.ndarray  # of each leaf


@dataclass
class Boosted:
    base: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = t.feature[at]
                right = (f >= 0) & (x[row, f] > t.cut[at])
                at = 2 * at + 1 + right
            out += t.value[at - (2**self.depth - 1)]
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: float = 1.0) -> Boosted:
    """Newton boosting of the log loss over histograms of at most ``bins`` quantile bins a feature."""
    n, m = x.shape
    p0 = np.clip(y.mean(), 1e-4, 1 - 1e-4)
    model = Boosted(float(np.log(p0 / (1 - p0))), depth)
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) if (c := x[:, j]).size else np.zeros(0) for j in range(m)]
    # a feature that is mostly zero has its first cut just above
    cuts = [np.unique(np.concatenate((c, [0.0], np.quantile(z, np.linspace(0, 1, 16)) if len(z := x[x[:, j] > 0, j]) else [])))[: 2 * bins] for j, c in enumerate(cuts)]
    codes = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)
    width = max(len(c) for c in cuts) + 1
    margin = np.full(n, model.base)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, p * (1 - p)
        at = np.zeros(n, np.int64)
        feature, cut = np.full(2**depth - 1, -1), np.zeros(2**depth - 1)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            local = at - first
            best = np.full(nodes, 1e-6)
            code = np.zeros(nodes, np.int64)
            for j in range(m):
                key = local * width + codes[:, j]
                gs = np.bincount(key, g, nodes * width).reshape(nodes, width).cumsum(axis=1)
                hs = np.bincount(key, h, nodes * width).reshape(nodes, width).cumsum(axis=1)
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                gain[(hs < least) | (ht - hs < least)] = 0
                gain[:, len(cuts[j]) :] = 0
                k = gain.argmax(axis=1)
                top = gain[np.arange(nodes), k]
                better = top > best
                best[better], code[better] = top[better], k[better]
                feature[first : first + nodes][better] = j
                cut[first : first + nodes][better] = cuts[j][k[better]] if len(cuts[j]) else 0
            f = feature[at]
            right = (f >= 0) & (codes[np.arange(n), f] > code[local])
            at = 2 * at + 1 + right
        leaf = at - (2**depth - 1)
        value = rate * np.bincount(leaf, g, 2**depth) / (np.bincount(leaf, h, 2**depth) + ridge)
        model.trees.append(Tree(feature, cut, value))
        margin += value[leaf]
    return model


@dataclass
class Isotonic:
    """A non-decreasing step function by pool-adjacent-violators, linear between the steps' middles."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    order = np.argsort(margin, kind="stable")
    xs, first, n = np.unique(margin[order], return_index=True, return_counts=True)
    sums = np.add.reduceat(y[order].astype(float), first)
    blocks: list[list[float]] = []  # sum of y, of x, count
    for x, s, c in zip(xs, sums, n, strict=True):
        blocks.append([s, x * c, float(c)])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return Isotonic(np.array([b[1] / b[2] for b in blocks]), np.array([b[0] / b[2] for b in blocks]))
