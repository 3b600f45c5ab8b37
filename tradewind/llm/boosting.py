"""Gradient boosted trees for binary labels on small dense matrices, with a calibrated threshold."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """``trees``: per tree (feature, cut, left, right, value) arrays; a leaf has feature -1."""

    start: float = 0.0
    rate: float = 0.3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while len(at := np.flatnonzero(feature[node] >= 0)):
                here = node[at]
                node[at] = np.where(x[at, feature[here]] <= cut[here], left[here], right[here])
            z += self.rate * value[node]
        return z

    def probability(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of label 1."""
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.margin(x) + self.shift, -30, 30)))


def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[float, int, float]:
    best = (1e-9, -1, 0.0)
    whole = g.sum() ** 2 / (h.sum() + ridge)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, a, b = x[order, f], np.cumsum(g[order])[:-1], np.cumsum(h[order])[:-1]
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if len(cuts):
            gain = a[cuts] ** 2 / (b[cuts] + ridge) + (g.sum() - a[cuts]) ** 2 / (h.sum() - b[cuts] + ridge) - whole
            k = int(np.argmax(gain))
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    return best


def _tree(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, ridge: float) -> tuple[np.ndarray, ...]:
    nodes: list[list[float]] = []

    def grow(rows: np.ndarray, left: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, 0, 0, -g[rows].sum() / (h[rows].sum() + ridge)])
        if left and len(rows) >= 10:
            _, f, cut = _split(x[rows], g[rows], h[rows], ridge)
            if f >= 0:
                low = x[rows, f] <= cut
                nodes[me][:4] = [f, cut, grow(rows[low], left - 1), grow(rows[~low], left - 1)]
        return me

    grow(np.arange(len(x)), depth)
    feature, cut, left, right, value = zip(*nodes)
    return np.array(feature, dtype=np.int64), np.array(cut), np.array(left, dtype=np.int64), np.array(right, dtype=np.int64), np.array(value)


def boost(x: np.ndarray, y: np.ndarray, trees: int = 30, depth: int = 3, ridge: float = 1.0, precision: float = 0.98, folds: int = 4, aside: np.ndarray | None = None) -> Boosted:
    """Fit on three of four rows; calibrate (Platt) and choose the threshold on the fourth, or on the rows marked ``aside``.

    The threshold is the lowest probability from which on the calibration rows reach ``precision``;
    with one label only, or no rows, it is above 1 and nothing is selected.
    """
    model = Boosted(threshold=1.1)
    if len(y) < 20 or y.min() == y.max():
        return model
    aside = np.arange(len(y)) % folds == folds - 1 if aside is None else aside
    if aside.all() or not aside.any():
        return model
    fx, fy = x[~aside], y[~aside].astype(float)
    mean = min(max(fy.mean(), 1e-3), 1 - 1e-3)
    model.start = float(np.log(mean / (1 - mean)))
    z = np.full(len(fy), model.start)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-z))
        model.trees.append(_tree(fx, p - fy, p * (1 - p), depth, ridge))
        z = model.margin(fx)
    m, t = model.margin(x[aside]), y[aside].astype(float)
    # Platt scaling with his smoothed targets keeps the slope finite on separable rows.
    target = np.where(t > 0, (t.sum() + 1) / (t.sum() + 2), 1 / (len(t) - t.sum() + 2))
    for _ in range(200):
        p = 1.0 / (1.0 + np.exp(-np.clip(model.slope * m + model.shift, -30, 30)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - target) * m).sum(), (p - target).sum()])
        hess = np.array([[(w * m * m).sum() + 1e-3, (w * m).sum()], [(w * m).sum(), w.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        model.slope, model.shift = model.slope - 0.5 * step[0], model.shift - 0.5 * step[1]
    p = model.probability(x[aside])
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(t[order]) / np.arange(1, len(order) + 1) >= precision
    model.threshold = float(max(0.5, p[order][np.flatnonzero(good)[-1]])) if good.any() else 1.1
    return model
