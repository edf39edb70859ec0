"""Small tree learners on the driver, over bounded samples, and their compilation
to Spark column expressions."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class Node:
    value: float
    feature: int = -1
    cut: float = 0.0
    left: "Node | None" = None  # feature <= cut
    right: "Node | None" = None


def cut_points(x: np.ndarray, bins: int = 24) -> list[np.ndarray]:
    return [np.unique(np.round(np.quantile(x[:, j], np.linspace(0.02, 0.98, bins)), 6)) for j in range(x.shape[1])]


def fit_tree(x, grad, hess, cuts, depth: int, leaf: int, l2: float = 1.0) -> Node:
    """A regression tree on gradients (Newton boosting)."""
    g, h = grad.sum(), hess.sum()
    node = Node(float(g / (h + l2)))
    if depth == 0 or len(grad) < 2 * leaf:
        return node
    best, base = 1e-6, g * g / (h + l2)
    for j, points in enumerate(cuts):
        if not len(points):
            continue
        at = np.searchsorted(points, x[:, j], side="left")  # number of cuts below x, so x <= points[at]
        n = np.cumsum(np.bincount(at, minlength=len(points) + 1))[:-1]
        gl = np.cumsum(np.bincount(at, grad, len(points) + 1))[:-1]
        hl = np.cumsum(np.bincount(at, hess, len(points) + 1))[:-1]
        gain = gl**2 / (hl + l2) + (g - gl) ** 2 / (h - hl + l2) - base
        gain[(n < leaf) | (len(grad) - n < leaf)] = -1
        k = int(np.argmax(gain))
        if gain[k] > best:
            best, node.feature, node.cut = gain[k], j, float(points[k])
    if node.feature >= 0:
        go = x[:, node.feature] <= node.cut
        node.left = fit_tree(x[go], grad[go], hess[go], cuts, depth - 1, leaf, l2)
        node.right = fit_tree(x[~go], grad[~go], hess[~go], cuts, depth - 1, leaf, l2)
    return node


def predict_tree(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    return np.where(x[:, node.feature] <= node.cut, predict_tree(node.left, x), predict_tree(node.right, x))


def boost(x, y, trees: int, depth: int, leaf: int = 20, rate: float = 0.3, seed: int = 7) -> tuple[float, list[Node]]:
    """Log-odds bias and trees of a gradient boosting classifier."""
    rng, cuts = np.random.default_rng(seed), cut_points(x)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(p / (1 - p)))
    z, out = np.full(len(y), bias), []
    for _ in range(trees):
        q = sigmoid(z)
        pick = rng.random(len(y)) < 0.7
        tree = fit_tree(x[pick], (y - q)[pick], (q * (1 - q))[pick], cuts, depth, leaf)
        z += rate * predict_tree(tree, x)
        out.append(tree)
    return bias, out


def paths(node: Node, so_far=()) -> list[tuple]:
    """Every path below the root as a conjunction of (feature, is_le, cut)."""
    out = [so_far] if so_far else []
    if node.feature >= 0:
        out += paths(node.left, so_far + ((node.feature, True, node.cut),))
        out += paths(node.right, so_far + ((node.feature, False, node.cut),))
    return out


def rule_matrix(rules: list[tuple], x: np.ndarray) -> np.ndarray:
    m = np.ones((len(x), len(rules)), dtype=np.float32)
    for k, rule in enumerate(rules):
        for j, le, cut in rule:
            m[:, k] *= (x[:, j] <= cut) if le else (x[:, j] > cut)
    return m


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """L1-penalised logistic weights by accelerated proximal gradient; the bias is free."""
    n, k = m.shape
    step = 4.0 * n / max(1e-9, float(np.linalg.norm(m, 2)) ** 2 + n)
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    v, c, t = w.copy(), b, 1.0
    for _ in range(steps):
        r = sigmoid(m @ v + c) - y
        w2 = v - step * (m.T @ r) / n
        w2 = np.sign(w2) * np.maximum(np.abs(w2) - step * penalty, 0)
        b2, t2 = c - step * r.mean(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = w2 + (t - 1) / t2 * (w2 - w), b2 + (t - 1) / t2 * (b2 - b)
        w, b, t = w2, b2, t2
    return b, w


def rule_column(rule: tuple, names: list[str]):
    cond = None
    for j, le, cut in rule:
        c = (F.col(names[j]) <= F.lit(cut)) if le else (F.col(names[j]) > F.lit(cut))
        cond = c if cond is None else cond & c
    return cond


def tree_sql(node: Node, name) -> str:
    """The tree as nested CASE WHEN; ``name`` gives the SQL of a feature number."""
    if node.feature < 0:
        return f"{node.value!r}D"
    return f"CASE WHEN {name(node.feature)} <= {node.cut!r}D THEN {tree_sql(node.left, name)} ELSE {tree_sql(node.right, name)} END"
