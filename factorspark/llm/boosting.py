"""Gradient-boosted trees for two classes: histogram splits, Newton leaves, numpy only."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trees:
    """Complete trees of one depth. A row goes right where its feature is above the threshold."""

    features: np.ndarray    # tree x inner node
    thresholds: np.ndarray  # tree x inner node
    leaves: np.ndarray      # tree x leaf
    start: float

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.start)
        depth = int(np.log2(self.leaves.shape[1]))
        every = np.arange(len(rows))
        for feature, threshold, leaf in zip(self.features, self.thresholds, self.leaves):
            node = np.zeros(len(rows), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
            out += leaf[node - len(feature)]
        return out


def boost(rows: np.ndarray, label: np.ndarray, weight: np.ndarray, trees: int = 80, depth: int = 3, rate: float = 0.2,
          bins: int = 32, ridge: float = 1.0) -> Trees:
    """Trees fitted to weighted rows by the gradients of the logistic loss."""
    borders = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(rows.shape[1])]
    binned = np.stack([np.searchsorted(b, rows[:, f], "left") for f, b in enumerate(borders)], axis=1)
    share = float(np.clip(np.average(label, weights=weight), 1e-6, 1 - 1e-6))
    start = float(np.log(share / (1 - share)))
    margin = np.full(len(rows), start)
    inner, found = 2**depth - 1, ([], [], [])
    for _ in range(trees):
        chance = 1 / (1 + np.exp(-margin))
        slope, bend = weight * (label - chance), weight * chance * (1 - chance)
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(rows), np.int64)
        for level in range(depth):
            first, nodes = 2**level - 1, 2**level
            at = node - first
            best = np.full(nodes, 1e-6)
            base = np.bincount(at, slope, nodes) ** 2 / (np.bincount(at, bend, nodes) + ridge)
            for f, border in enumerate(borders):
                size = len(border) + 1
                if size == 1:
                    continue
                cell = at * size + binned[:, f]
                left_slope = np.bincount(cell, slope, nodes * size).reshape(nodes, size).cumsum(axis=1)
                left_bend = np.bincount(cell, bend, nodes * size).reshape(nodes, size).cumsum(axis=1)
                right_slope, right_bend = left_slope[:, -1:] - left_slope, left_bend[:, -1:] - left_bend
                gain = (left_slope**2 / (left_bend + ridge) + right_slope**2 / (right_bend + ridge) - base[:, None])[:, :-1]
                top = gain.argmax(axis=1)
                value = gain[np.arange(nodes), top]
                better = value > best
                best[better] = value[better]
                feature[first: first + nodes][better] = f
                threshold[first: first + nodes][better] = border[top[better]]
            every = np.arange(len(rows))
            node = 2 * node + 1 + (rows[every, feature[node]] > threshold[node])
        leaf = node - inner
        value = rate * np.bincount(leaf, slope, inner + 1) / (np.bincount(leaf, bend, inner + 1) + ridge)
        margin = margin + value[leaf]
        for column, part in zip(found, (feature, threshold, value)):
            column.append(part)
    return Trees(*(np.array(c) for c in found), start)


def sigmoid_fit(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(a, b) of the calibrated chance 1 / (1 + exp(-(a * margin + b))), by Newton steps with a little ridge."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        chance = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        error, bend = weight * (label - chance), weight * chance * (1 - chance)
        slope = np.array([(error * margin).sum() - 1e-2 * (a - 1), error.sum() - 1e-2 * b])
        cross = (bend * margin).sum()
        curve = np.array([[(bend * margin**2).sum() + 1e-2, cross], [cross, bend.sum() + 1e-2]])
        step = np.linalg.solve(curve, slope)
        a, b = a + float(np.clip(step[0], -1, 1)), b + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-9:
            break
    return max(a, 1e-3), b
