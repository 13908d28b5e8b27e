"""Gradient-boosted trees on the logistic loss, over binned features, in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A full binary tree by levels: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    below: np.ndarray
    value: np.ndarray

    def at(self, x: np.ndarray, depth: int) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.below[node])
        return self.value[node - (len(self.feature))]


@dataclass
class Trees:
    """The edges of each feature's bins, the first log-odds, and the trees."""

    edges: list[np.ndarray]
    start: float
    depth: int
    trees: list[Tree] = field(default_factory=list)

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], side="left") for i, e in enumerate(self.edges)], axis=1).astype(np.int16) if len(x) else np.zeros((0, len(self.edges)), np.int16)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        return self.start + sum((t.at(b, self.depth) for t in self.trees), np.zeros(len(b)))


def fit(x: np.ndarray, y: np.ndarray, w: np.ndarray, rounds: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, least: float = 10) -> Trees:
    """Trees for rows x with labels y (0 or 1) and weights w; a split leaves the weight ``least`` on either side.

    Ties between splits go to the first feature and edge.
    """
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1], method="nearest")) if len(np.unique(c)) > bins else np.unique(c)[:-1] for c in x.T]
    share = np.clip((w @ y) / w.sum(), 1e-6, 1 - 1e-6)
    model = Trees(edges, float(np.log(share / (1 - share))), depth)
    b, margin, d = model.binned(x), np.full(len(x), model.start), x.shape[1]
    flat = b + np.arange(d) * bins
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, curve = w * (y - p), w * p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, below = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, np.iinfo(np.int16).max, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            cell = ((node - first)[:, None] * (d * bins) + flat).ravel()
            gl, hl, wl = (np.bincount(cell, np.repeat(s, d), n * d * bins).reshape(n, d, bins).cumsum(axis=2) for s in (slope, curve, w))
            gt, ht, wt = (s[:, :, -1:] for s in (gl, hl, wl))
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain = np.where((wl >= least) & (wt - wl >= least), gain, 0)
            best = gain.reshape(n, -1).argmax(axis=1)
            split = gain.reshape(n, -1).max(axis=1) > 1e-9
            feature[first : first + n] = best // bins
            below[first : first + n] = np.where(split, best % bins, np.iinfo(np.int16).max)
            node = 2 * node + 1 + (b[np.arange(len(x)), feature[node]] > below[node])
        leaf = node - len(feature)
        g, h = np.bincount(leaf, slope, 2**depth), np.bincount(leaf, curve, 2**depth)
        tree = Tree(feature, below, rate * g / (h + ridge))
        model.trees.append(tree)
        margin += tree.value[leaf]
    return model
