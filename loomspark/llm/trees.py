"""Gradient-boosted trees and random forests on a bounded sample, written out as SQL expressions.

Samples are small and bounded by whoever gathers them, so a tree is grown on the driver; scoring is a CASE
expression over feature columns, which runs inside Spark wherever those columns are.
"""

from __future__ import annotations

import numpy as np

BINS = 32


def cuts_of(x: np.ndarray) -> list[np.ndarray]:
    """Candidate thresholds of each feature: midpoints between neighbouring values, or of quantiles."""
    out = []
    for col in x.T:
        v = np.unique(col)
        if len(v) > BINS:
            v = np.unique(np.quantile(col, np.linspace(0, 1, BINS)))
        out.append((v[1:] + v[:-1]) / 2)
    return out


def grow(x, grad, hess, cuts, depth: int, least: float, ridge: float, features=None):
    """A tree of nested (feature, threshold, low, high), with leaf values -sum(grad) / (sum(hess) + ridge)."""
    g, h = grad.sum(), hess.sum()
    leaf = float(-g / (h + ridge))
    if not depth or len(x) < 2:
        return leaf
    best = (1e-6, None, None)
    for j in features() if features else range(x.shape[1]):
        if not len(cuts[j]):
            continue
        where = np.searchsorted(cuts[j], x[:, j], "left")
        gl = np.cumsum(np.bincount(where, grad, len(cuts[j]) + 1))[:-1]
        hl = np.cumsum(np.bincount(where, hess, len(cuts[j]) + 1))[:-1]
        gain = gl**2 / (hl + ridge) + (g - gl) ** 2 / (h - hl + ridge) - g * g / (h + ridge)
        gain[(hl < least) | (h - hl < least)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), j, float(cuts[j][k]))
    if best[1] is None:
        return leaf
    _, j, t = best
    low = x[:, j] <= t
    args = (cuts, depth - 1, least, ridge, features)
    return j, t, grow(x[low], grad[low], hess[low], *args), grow(x[~low], grad[~low], hess[~low], *args)


def values(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    j, t, low, high = tree
    out, at = np.empty(len(x)), x[:, j] <= t
    out[at], out[~at] = values(low, x[at]), values(high, x[~at])
    return out


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, rate: float = 0.3, ridge: float = 1.0, least: float = 0.5, weight: np.ndarray | None = None) -> tuple[float, list]:
    """Logistic boosting: the first log-odds and the trees, whose leaves already hold the rate. `least` is the curvature that a leaf must have, `weight` how many rows each one stands for."""
    w = np.ones(len(y)) if weight is None else weight
    p = ((w * y).sum() + 1) / (w.sum() + 2)
    start = float(np.log(p / (1 - p)))
    z, cuts, out = np.full(len(y), start), cuts_of(x), []

    def scaled(tree):
        return tree * rate if isinstance(tree, float) else (tree[0], tree[1], scaled(tree[2]), scaled(tree[3]))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        tree = scaled(grow(x, w * (p - y), w * p * (1 - p), cuts, depth, least, ridge))
        out.append(tree)
        z += values(tree, x)
    return start, out


def forest(x: np.ndarray, y: np.ndarray, trees: int = 24, depth: int = 6, seed: int = 11) -> list:
    """Random forest: each tree sees a bootstrap of the rows, each split a third of the features; leaves hold shares of ones."""
    rng, cuts, out = np.random.default_rng(seed), cuts_of(x), []
    some = max(1, x.shape[1] // 3)
    for _ in range(trees):
        own = rng.integers(0, len(y), len(y))
        w = y[own].astype(float)
        # with unit weights and gradients -y, a leaf is the mean of y and the gain is the drop of squared error
        out.append(grow(x[own], -w, np.ones(len(own)), cuts, depth, 2, 1e-9, lambda: rng.permutation(x.shape[1])[:some]))
    return out


def sql(tree, names: list[str]) -> str:
    """The tree as nested CASE over the named expressions."""
    if isinstance(tree, float):
        return f"{tree:.6f}D"
    j, t, low, high = tree
    return f"CASE WHEN {names[j]} <= {t:.6f}D THEN {sql(low, names)} ELSE {sql(high, names)} END"
