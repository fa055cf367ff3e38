"""Decision trees and forests on NumPy arrays, for kernels that run inside one task: weighted, with pluggable impurity."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def gini(counts: np.ndarray) -> np.ndarray:
    """Of weighted class counts in the last axis, times their sum."""
    total = counts.sum(-1)
    return total - (counts**2).sum(-1) / np.maximum(total, 1e-300)


def balance(counts: np.ndarray) -> np.ndarray:
    """Balance entropy (log2 of the sum minus the mean of log2 counts), times the sum."""
    total = counts.sum(-1)
    logs = (counts * np.log2(np.maximum(counts, 1e-300))).sum(-1)
    return np.where(total > 0, total * np.log2(np.maximum(total, 1e-300)) - logs, 0.0)


@dataclass
class Tree:
    """A fitted tree as flat arrays: feature (-1: leaf), threshold, left, right, class shares."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    proba: np.ndarray

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while True:
            f = self.feature[at]
            live = f >= 0
            if not live.any():
                return self.proba[at]
            go = x[rows[live], f[live]] <= self.threshold[at[live]]
            at[live] = np.where(go, self.left[at[live]], self.right[at[live]])


def fit_tree(x, y, classes, w=None, depth=64, least_split=2, least_leaf=1, mtry=None, impurity=gini, rng=None, random_cut=False) -> Tree:
    """Grows a tree; mtry features are tried at a node (all if none); random_cut draws one threshold for each of them."""
    rng = rng or np.random.default_rng(0)
    w = np.ones(len(y)) if w is None else np.asarray(w, float)
    onehot = np.eye(classes)[y] * w[:, None]
    nodes: list[list] = []

    def grow(rows, level):
        counts = onehot[rows].sum(0)
        number = len(nodes)
        nodes.append([-1, 0.0, -1, -1, counts / max(counts.sum(), 1e-300)])
        if level >= depth or len(rows) < least_split or (counts > 0).sum() < 2:
            return number
        tried = rng.permutation(x.shape[1])
        best, found = impurity(counts) - 1e-12, None
        for j, f in enumerate(tried):
            if mtry and j >= mtry and found is not None:
                break
            v = x[rows, f]
            if random_cut:
                low, high = v.min(), v.max()
                if low == high:
                    continue
                cut = rng.uniform(low, high)
                go = v <= cut
                if least_leaf <= go.sum() <= len(rows) - least_leaf:
                    cost = impurity(onehot[rows[go]].sum(0)) + impurity(onehot[rows[~go]].sum(0))
                    if cost < best:
                        best, found = cost, (f, cut)
                continue
            order = np.argsort(v, kind="stable")
            sorted_ = v[order]
            left = np.cumsum(onehot[rows[order]], 0)[:-1]
            able = np.flatnonzero(sorted_[1:] > sorted_[:-1])
            able = able[(able + 1 >= least_leaf) & (len(rows) - able - 1 >= least_leaf)]
            if len(able):
                cost = impurity(left[able]) + impurity(counts - left[able])
                k = int(cost.argmin())
                if cost[k] < best:
                    cut = (sorted_[able[k]] + sorted_[able[k] + 1]) / 2
                    best, found = cost[k], (f, cut if cut < sorted_[able[k] + 1] else sorted_[able[k]])
        if found:
            go = x[rows, found[0]] <= found[1]
            nodes[number][:2] = found
            nodes[number][2], nodes[number][3] = grow(rows[go], level + 1), grow(rows[~go], level + 1)
        return number

    grow(np.arange(len(y)), 0)
    return Tree(*(np.array([n[i] for n in nodes]) for i in range(5)))


@dataclass
class Forest:
    trees: list

    def predict_proba(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict_proba(x) for t in self.trees], 0)


def fit_forest(x, y, classes, n=30, seed=0, w=None, bootstrap=True, **kw) -> Forest:
    """Bagged trees with the root of the features at each node."""
    rng = np.random.default_rng(seed)
    kw = {"mtry": max(1, int(np.sqrt(x.shape[1])))} | kw
    trees = []
    for _ in range(n):
        pick = rng.integers(0, len(y), len(y)) if bootstrap else np.arange(len(y))
        trees.append(fit_tree(x[pick], y[pick], classes, None if w is None else np.asarray(w)[pick], rng=rng, **kw))
    return Forest(trees)
