"""Gradient-boosted trees for two classes, on histograms, in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Trees:
    """Complete trees: split features and thresholds by level order, then leaves."""

    base: float
    feature: np.ndarray  # trees, splits
    bound: np.ndarray
    leaf: np.ndarray  # trees, leaves

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        every = np.arange(len(rows))
        splits = self.feature.shape[1]
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            at = np.zeros(len(rows), np.int64)
            for _ in range((splits + 1).bit_length() - 1):
                at = 2 * at + 1 + (rows[every, feature[at]] > bound[at])
            total += leaf[at - splits]
        return total


def fit(
    rows: np.ndarray, labels: np.ndarray, weights: np.ndarray,
    trees: int = 70, depth: int = 4, rate: float = 0.25, ridge: float = 1.0,
) -> Trees:
    """Newton steps on the logistic loss, one complete tree of `depth` levels at a time."""
    edges = []
    binned = np.empty(rows.shape, np.int64)
    for f in range(rows.shape[1]):
        cuts = np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1]))
        # a column of few values is cut between them
        values = np.unique(rows[:, f])
        if len(values) < BINS:
            cuts = (values[1:] + values[:-1]) / 2
        edges.append(cuts)
        binned[:, f] = np.searchsorted(cuts, rows[:, f])
    mean = np.clip((labels * weights).sum() / weights.sum(), 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    odds = np.full(len(rows), base)
    features, bounds, leaves = [], [], []
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-odds))
        slope, curve = (labels - chance) * weights, np.maximum(chance * (1 - chance), 1e-6) * weights
        at = np.zeros(len(rows), np.int64)
        feature = np.zeros(2**depth - 1, np.int64)
        bound = np.full(2**depth - 1, np.inf)
        for level in range(depth):
            n, start = 2**level, 2**level - 1
            best = np.full(n, 1e-6)
            split = np.full(n, BINS)
            for f in range(rows.shape[1]):
                if not len(edges[f]):
                    continue
                key = (at - start) * BINS + binned[:, f]
                g = np.bincount(key, slope, n * BINS).reshape(n, BINS)
                h = np.bincount(key, curve, n * BINS).reshape(n, BINS)
                gl, hl = g.cumsum(1)[:, :-1], h.cumsum(1)[:, :-1]
                gt, ht = g.sum(1)[:, None], h.sum(1)[:, None]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain = gain[:, : len(edges[f])]
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best[better] = gain[np.arange(n), top][better]
                split[better], feature[start : start + n][better] = top[better], f
                bound[start : start + n][better] = edges[f][top[better]]
            at = 2 * at + 1 + (rows[np.arange(len(rows)), feature[at]] > bound[at])
        at -= 2**depth - 1
        g, h = np.bincount(at, slope, 2**depth), np.bincount(at, curve, 2**depth)
        leaf = rate * g / (h + ridge)
        odds += leaf[at]
        features.append(feature)
        bounds.append(bound)
        leaves.append(leaf)
    return Trees(base, np.array(features), np.array(bounds), np.array(leaves))
