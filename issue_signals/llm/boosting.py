"""Gradient-boosted trees for two classes, on histograms of binned features. Small by intent: a bounded
sample is fitted in one task, and the model is an array per field of its nodes."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of one depth: node k has children 2k+1 and 2k+2; leaves hold log odds."""

    feature: np.ndarray  # trees x inner nodes
    cut: np.ndarray  # go right if the value is above
    leaf: np.ndarray  # trees x leaves
    start: float

    def log_odds(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        inner = self.feature.shape[1]
        at_row = np.arange(len(rows))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(rows), np.int64)
            while inner and node[:1].size and node[0] < inner:
                node = 2 * node + 1 + (rows[at_row, feature[node]] > cut[node])
            total += leaf[node - inner]
        return total


def fit_trees(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 5, rate: float = 0.2, least: float = 2.0, ridge: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss; least: curvature that each side of a split must hold."""
    n, width = rows.shape
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, BINS + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)], axis=1)
    share = min(max(float(labels.mean()), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    score = np.full(n, start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, cuts, values = [], [], []
    for _ in range(trees):
        likely = 1 / (1 + np.exp(-score))
        slope, curve = labels - likely, likely * (1 - likely)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            own = node - first
            best = np.full(count, 1e-6)
            at_bin = np.zeros(count, np.int64)
            totals = np.bincount(own, slope, count), np.bincount(own, curve, count)
            base = totals[0] ** 2 / (totals[1] + ridge)
            for f in range(width):
                if not len(edges[f]):
                    continue
                cell = own * BINS + binned[:, f]
                left = [np.bincount(cell, x, count * BINS).reshape(count, BINS).cumsum(axis=1)[:, :-1] for x in (slope, curve)]
                right = [t[:, None] - x for t, x in zip(totals, left)]
                gain = left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge) - base[:, None]
                gain[(left[1] < least) | (right[1] < least)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(count), top] > best
                best[better], at_bin[better] = gain[np.arange(count), top][better], top[better]
                feature[first : first + count][better] = f
                cut[first : first + count][better] = edges[f][top[better]]
            node = 2 * node + 1 + (rows[np.arange(n), feature[node]] > cut[node])
        place = node - inner
        value = rate * np.bincount(place, slope, leaves) / (np.bincount(place, curve, leaves) + ridge)
        score = score + value[place]
        features.append(feature)
        cuts.append(cut)
        values.append(value)
    return Trees(np.array(features), np.array(cuts), np.array(values), start)
