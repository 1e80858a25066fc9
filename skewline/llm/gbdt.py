"""Histogram gradient-boosted trees for a binary label, in numpy.

Training bins every feature at its quantiles and grows complete trees level by level from
gradient histograms.  A fitted model is three arrays (split feature, threshold, leaf value)
in heap order, so scoring walks all rows down one tree at a time without branching.
"""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
        l2: float = 1.0, min_hessian: float = 2.0) -> dict[str, np.ndarray]:
    """Fit on rows ``x`` (finite values) with labels ``y`` in 0..1, each counting ``weight`` times.
    Without rows the model scores 0.5; with one class only, a constant close to it."""
    n, f = x.shape
    weight = np.ones(n) if weight is None else weight.astype(float)
    inner, leaves = (1 << depth) - 1, 1 << depth
    model = {"feature": np.zeros((trees, inner), np.int32), "threshold": np.full((trees, inner), np.inf),
             "leaf": np.zeros((trees, leaves)), "prior": np.zeros(1)}
    p = ((weight * y).sum() + 0.5) / (weight.sum() + 1)
    model["prior"][0] = np.log(p / (1 - p))
    if n == 0 or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(f)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)]).astype(np.int64)
    margin = np.full(n, model["prior"][0])
    for t in range(trees):
        prob = 1 / (1 + np.exp(-margin))
        g, h = weight * (y - prob), weight * prob * (1 - prob)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            width, base = 1 << level, (1 << level) - 1
            best = np.full(width, 1e-9)
            feature, cut = np.zeros(width, np.int64), np.full(width, bins, np.int64)
            for j in range(f):
                at = node * bins + codes[j]
                gl = np.cumsum(np.bincount(at, g, width * bins).reshape(width, bins), 1)
                hl = np.cumsum(np.bincount(at, h, width * bins).reshape(width, bins), 1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl ** 2 / (hl + l2) + (gt - gl) ** 2 / (ht - hl + l2) - gt ** 2 / (ht + l2)
                gain[(hl < min_hessian) | (ht - hl < min_hessian)] = 0
                k = gain.argmax(1)
                top = gain[np.arange(width), k]
                better = top > best
                best[better], feature[better], cut[better] = top[better], j, k[better]
            for i in range(width):
                if cut[i] < bins:
                    model["feature"][t, base + i] = feature[i]
                    model["threshold"][t, base + i] = edges[feature[i]][cut[i]]
            node = 2 * node + (codes[feature[node], np.arange(n)] > cut[node])
        value = rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
        model["leaf"][t] = value
        margin += value[node]
    return model


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for each row."""
    feature, threshold, leaf = model["feature"], model["threshold"], model["leaf"]
    depth = leaf.shape[1].bit_length() - 1
    rows, margin = np.arange(len(x)), np.full(len(x), model["prior"][0])
    for t in range(len(leaf)):
        node = np.zeros(len(x), np.int64)
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, feature[t, node]] > threshold[t, node])
        margin += leaf[t, node - (leaf.shape[1] - 1)]
    return 1 / (1 + np.exp(-margin))
