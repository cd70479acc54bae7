"""Gradient-boosted trees in numpy: small, one set of trees per class."""

from __future__ import annotations

import numpy as np


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, least: int, cuts: list[np.ndarray]):
    """A tree as nested lists [feature, threshold, left, right], or a leaf's value."""
    value = float(-g.sum() / (h.sum() + 1.0))
    if depth == 0 or len(g) < 2 * least:
        return round(value, 4)
    base, best = g.sum() ** 2 / (h.sum() + 1.0), (1e-6, None)
    for f, at in enumerate(cuts):
        for c in at:
            left = x[:, f] <= c
            n = int(left.sum())
            if least <= n <= len(g) - least:
                gl, hl = g[left].sum(), h[left].sum()
                gain = gl**2 / (hl + 1.0) + (g.sum() - gl) ** 2 / (h.sum() - hl + 1.0) - base
                if gain > best[0]:
                    best = (gain, (f, float(c), left))
    if best[1] is None:
        return round(value, 4)
    f, c, left = best[1]
    return [f, c, _tree(x[left], g[left], h[left], depth - 1, least, cuts), _tree(x[~left], g[~left], h[~left], depth - 1, least, cuts)]


def fit(x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 15, depth: int = 5, rate: float = 0.5, least: int = 3) -> list[list]:
    """Trees for each class 1..classes against the rest, by logistic loss."""
    cuts = [np.unique(np.quantile(np.unique(x[:, f]), np.linspace(0, 1, 12)[:-1])) for f in range(x.shape[1])]
    model = []
    for k in range(1, classes + 1):
        score, trees, target = np.full(len(y), -2.0), [], (y == k).astype(float)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            tree = _tree(x, p - target, p * (1 - p), depth, least, cuts)
            step = rate * evaluate(tree, x)
            score += step
            trees.append(tree)
        model.append(trees)
    return model


def evaluate(tree, x: np.ndarray) -> np.ndarray:
    """Value of a tree for each row."""
    out = np.empty(len(x))
    todo = [(tree, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if not isinstance(node, list):
            out[rows] = node
        elif len(rows):
            left = x[rows, node[0]] <= node[1]
            todo.append((node[2], rows[left]))
            todo.append((node[3], rows[~left]))
    return out


def scores(model: list[list], x: np.ndarray, rate: float = 0.5) -> np.ndarray:
    """Log-odds of each class for each row."""
    return np.stack([-2.0 + rate * sum(evaluate(t, x) for t in trees) for trees in model], axis=1) if len(x) else np.zeros((0, len(model)))
