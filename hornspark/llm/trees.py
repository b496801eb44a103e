"""Small tree ensembles in numpy, for models that are trained on the driver from bounded samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Tree:
    """A binary tree in arrays: leaves have feature -1."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            inner = f >= 0
            if not inner.any():
                return self.value[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at])
            at = np.where(inner, down, at)


def binned(x: np.ndarray, bins: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Each column's bin numbers, and the cuts between bins."""
    cuts = []
    out = np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        c = (values[:-1] + values[1:]) / 2
        if len(c) > bins - 1:
            c = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1]))
        cuts.append(c)
        out[:, j] = np.searchsorted(c, x[:, j], side="left")
    return out, cuts


def grow(codes: np.ndarray, cuts: list, grad: np.ndarray, hess: np.ndarray, depth: int, features: int | None, rng: np.random.Generator, smooth: float, least: float) -> Tree:
    """A tree that fits -grad / hess, split by the gain of second-order boosting.

    With grad = -y and hess = 1 its leaves are means of y, and the gain orders splits of 0/1
    labels as Gini impurity does. ``features``: how many random columns a split may use.
    """
    n_bins = max(len(c) for c in cuts) + 1 if cuts else 1
    width = codes.shape[1]
    nodes: list[list] = []

    def add(rows: np.ndarray, level: int) -> int:
        k = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([-1, 0.0, 0, 0, -g / (h + smooth)])
        if level == depth or h < 2 * least:
            return k
        use = np.arange(width) if features is None else rng.choice(width, min(features, width), replace=False)
        flat = (codes[rows][:, use] + np.arange(len(use)) * n_bins).ravel()
        gs = np.bincount(flat, np.repeat(grad[rows], len(use)), len(use) * n_bins).reshape(len(use), n_bins).cumsum(axis=1)
        hs = np.bincount(flat, np.repeat(hess[rows], len(use)), len(use) * n_bins).reshape(len(use), n_bins).cumsum(axis=1)
        gain = gs**2 / (hs + smooth) + (g - gs) ** 2 / (h - hs + smooth) - g**2 / (h + smooth)
        gain[(hs < least) | (h - hs < least)] = -1
        j, b = np.unravel_index(gain.argmax(), gain.shape)
        if gain[j, b] <= 1e-9 or b >= len(cuts[use[j]]):
            return k
        go = codes[rows, use[j]] <= b
        nodes[k][:2] = [int(use[j]), float(cuts[use[j]][b])]
        nodes[k][2] = add(rows[go], level + 1)
        nodes[k][3] = add(rows[~go], level + 1)
        return k

    add(np.arange(len(codes)), 0)
    f, c, left, right, v = zip(*nodes, strict=True)
    return Tree(np.array(f), np.array(c), np.array(left), np.array(right), np.array(v))


@dataclass
class Boosted:
    """Gradient-boosted trees for a probability."""

    base: float
    trees: list[Tree]

    def logits(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for t in self.trees:
            out += t(x)
        return out


def boost(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.3, seed: int = 7) -> Boosted:
    codes, cuts = binned(x, 32)
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    out = Boosted(float(np.log(mean / (1 - mean))), [])
    score = np.full(len(y), out.base)
    rng = np.random.default_rng(seed)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        t = grow(codes, cuts, p - y, np.maximum(p * (1 - p), 1e-6), depth, None, rng, 1.0, 1.0)
        t.value *= rate
        out.trees.append(t)
        score += t(x)
    return out


@dataclass
class Forest:
    """A random forest of probability trees."""

    trees: list[Tree]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return sum(t(x) for t in self.trees) / len(self.trees) if len(x) else np.zeros(0)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, seed: int = 7) -> Forest:
    """Each tree from its own bootstrap sample, each split from a random subset of columns."""
    rng = np.random.default_rng(seed)
    codes, cuts = binned(x, 64)
    features = max(1, round(np.sqrt(x.shape[1])))
    out = []
    for _ in range(trees):
        rows = rng.integers(0, len(y), len(y))
        out.append(grow(codes[rows], cuts, -y[rows].astype(float), np.ones(len(rows)), depth, features, rng, 1e-9, 2.0))
    return Forest(out)
