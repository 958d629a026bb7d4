"""A random forest of binary classification trees in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Trees as flat arrays: feature (-1 in leaves), threshold, left and right child, share of positives."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, value in self.trees:
            node = np.zeros(len(x), np.int64)
            while (inner := np.flatnonzero(feature[node] >= 0)).size:
                at = node[inner]
                node[inner] = np.where(x[inner, feature[at]] <= threshold[at], left[at], right[at])
            total += value[node]
        return total / max(1, len(self.trees))


def _split(x: np.ndarray, y: np.ndarray, features: np.ndarray, least: int) -> tuple[float, int, float]:
    """(impurity, feature, threshold) of the best split by Gini; impurity is infinite where there is none."""
    best = (np.inf, -1, 0.0)
    n = len(y)
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        size = np.arange(1, n)
        able = (v[1:] > v[:-1]) & (size >= least) & (n - size >= least)
        if not able.any():
            continue
        p, q = ones[:-1] / size, (ones[-1] - ones[:-1]) / (n - size)
        impurity = np.where(able, size * p * (1 - p) + (n - size) * q * (1 - q), np.inf)
        i = int(impurity.argmin())
        if impurity[i] < best[0]:
            best = (float(impurity[i]), int(f), float(v[i]))
    return best


def fit_forest(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 10, least: int = 3, seed: int = 11) -> Forest:
    """Bootstrap samples, a random subset of features at each node, Gini splits down to ``least`` rows a leaf."""
    rng = np.random.default_rng(seed)
    some = max(1, round(x.shape[1] ** 0.5) + 1)
    made = []
    for _ in range(trees if len(y) else 0):
        nodes: list[list] = []

        def grow(rows: np.ndarray, level: int) -> int:
            at = len(nodes)
            nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
            if level < depth and len(rows) >= 2 * least and 0 < nodes[at][4] < 1:
                _, feature, threshold = _split(x[rows], y[rows], rng.choice(x.shape[1], some, replace=False), least)
                if feature >= 0:
                    low = x[rows, feature] <= threshold
                    nodes[at][:4] = [feature, threshold, grow(rows[low], level + 1), grow(rows[~low], level + 1)]
            return at

        grow(rng.integers(0, len(y), len(y)), 0)
        columns = list(zip(*nodes, strict=True))
        made.append(tuple(np.array(c, k) for c, k in zip(columns, (np.int64, float, np.int64, np.int64, float), strict=True)))
    return Forest(made)
