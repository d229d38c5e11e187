"""Histogram gradient-boosted trees in numpy: fitted on the driver from a bounded sample, scored in flat arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """All trees as complete binary trees: `feature` and `bound` of inner nodes, `leaf` values; children of i: 2i+1, 2i+2."""

    bias: float
    feature: np.ndarray  # (trees, inner nodes)
    bound: np.ndarray
    leaf: np.ndarray  # (trees, leaves)

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Level by level through all trees at once; rows in blocks, so scratch space is bounded."""
        out = np.empty(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        tree = np.arange(len(self.feature))[None, :]
        for start in range(0, len(x), 2048):
            part = x[start : start + 2048]
            node = np.zeros((len(part), len(self.feature)), np.int64)
            row = np.arange(len(part))[:, None]
            for _ in range(depth):
                node = 2 * node + 1 + (part[row, self.feature[tree, node]] > self.bound[tree, node])
            score = self.bias + (self.leaf[tree, node - (self.leaf.shape[1] - 1)].sum(axis=1) if self.leaf.size else 0)
            out[start : start + 2048] = 1 / (1 + np.exp(-score))
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 2.0, least: float = 4.0) -> Trees:
    """Logistic loss; gradients and Hessians are summed by (node, feature, bin), never sorted by value."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    share = min(max(share, 1e-3), 1 - 1e-3)
    bias = float(np.log(share / (1 - share)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(bias, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    n, f = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], "left") for j in range(f)])  # x > edges[b] goes right of b
    score = np.full(n, bias)
    feature, bound, leaf = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for d in range(depth):
            width = 2**d
            local = node - (width - 1)
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            best = np.full(width, 1e-6)
            for j in range(f):
                key = local * bins + binned[j]
                left_g = np.cumsum(np.bincount(key, g, width * bins).reshape(width, bins), axis=1)
                left_h = np.cumsum(np.bincount(key, h, width * bins).reshape(width, bins), axis=1)
                right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
                gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(left_h < least) | (right_h < least)] = 0
                gain[:, len(edges[j]) :] = 0
                at = gain.argmax(axis=1)
                value = gain[np.arange(width), at]
                for k in np.flatnonzero(value > best):
                    best[k] = value[k]
                    feature[t, width - 1 + k], bound[t, width - 1 + k] = j, edges[j][at[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > bound[t, node])
        local = node - inner
        leaf[t] = rate * np.bincount(local, g, leaves) / (np.bincount(local, h, leaves) + ridge)
        score += leaf[t, local]
    return Trees(bias, feature, bound, leaf)
