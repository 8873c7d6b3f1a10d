"""Small gradient-boosted trees with isotonic calibration, trained on bounded samples on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """A complete binary tree; node i's children are 2i+1 (value <= threshold) and 2i+2. A node without a split has an infinite threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while len(at) and at[0] < len(self.feature):
            at = 2 * at + 1 + (x[rows, self.feature[at]] > self.threshold[at])
        return self.value[at - len(self.feature)]


@dataclass
class Boosted:
    base: float
    trees: list[Tree] = field(default_factory=list)

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.base + sum((t.predict(x) for t in self.trees), np.zeros(len(x)))

    def margin_sql(self, names: list[str]) -> str:
        """The same margin as one SQL expression over columns or fields ``names``."""

        def node(tree: Tree, i: int) -> str:
            if i >= len(tree.feature):
                return f"{float(tree.value[i - len(tree.feature)])!r}D"
            if np.isinf(tree.threshold[i]):
                return node(tree, 2 * i + 1)
            return f"CASE WHEN {names[tree.feature[i]]} > {float(tree.threshold[i])!r}D THEN {node(tree, 2 * i + 2)} ELSE {node(tree, 2 * i + 1)} END"

        return " + ".join([f"{self.base!r}D", *(f"({node(t, 0)})" for t in self.trees)])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 64, least_hessian: float = 1.0, ridge: float = 1.0) -> Boosted:
    """Logistic boosting on histogram splits. Deterministic; with one class only, the base alone."""
    rate_of_one = (y.sum() + 0.5) / (len(y) + 1.0)
    model = Boosted(float(np.log(rate_of_one / (1 - rate_of_one))))
    if not 0 < y.sum() < len(y):
        return model
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], axis=1)  # bin b holds values <= cut b
    margin = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = sigmoid(margin)
        g, h = p - y, p * (1 - p)
        feature, threshold, split = np.zeros(inner, np.int64), np.full(inner, np.inf), np.full(inner, bins + 1)
        at = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            best = np.zeros(width)
            for j in range(x.shape[1]):
                if not len(cuts[j]):
                    continue
                n = len(cuts[j]) + 1
                key = (at - first) * n + binned[:, j]
                gs = np.bincount(key, g, width * n).reshape(width, n).cumsum(axis=1)
                hs = np.bincount(key, h, width * n).reshape(width, n).cumsum(axis=1)
                gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                gain = gl**2 / (hl + ridge) + (ga - gl) ** 2 / (ha - hl + ridge) - ga**2 / (ha + ridge)
                gain[(hl < least_hessian) | (ha - hl < least_hessian)] = 0
                where = gain.argmax(axis=1)
                top = gain[np.arange(width), where]
                for i in np.flatnonzero(top > best + 1e-9):
                    best[i], feature[first + i], split[first + i], threshold[first + i] = top[i], j, where[i], cuts[j][where[i]]
            at = 2 * at + 1 + (binned[np.arange(len(y)), feature[at]] > split[at])
        leaf = at - inner
        value = -rate * np.bincount(leaf, g, inner + 1) / (np.bincount(leaf, h, inner + 1) + ridge)
        margin += value[leaf]
        model.trees.append(Tree(feature, threshold, value))
    return model


@dataclass
class Isotonic:
    """A non-decreasing map of margins to probabilities, linear between its knots."""

    knots: np.ndarray
    values: np.ndarray

    def apply(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.knots, self.values)

    def threshold(self, probability: float) -> float:
        """The least margin whose calibrated probability reaches ``probability``; infinite if none does."""
        if self.values[-1] < probability:
            return float("inf")
        i = int(np.argmax(self.values >= probability))
        if not i:
            return float(self.knots[0])
        a, b = self.values[i - 1], self.values[i]
        return float(self.knots[i - 1] + (self.knots[i] - self.knots[i - 1]) * (probability - a) / (b - a))


def isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators. Each pool carries one pseudo-row of the whole sample's rate, so small pools don't reach 0 or 1."""
    at, which = np.unique(margin, return_inverse=True)
    pools: list[list[float]] = []  # sum of y, rows, first margin, last margin; rows of one margin are one from the start
    for m, ones, rows in zip(at, np.bincount(which, y, len(at)), np.bincount(which, minlength=len(at)), strict=True):
        pools.append([float(ones), float(rows), float(m), float(m)])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            a = pools.pop()
            pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
    rate = y.mean() if len(y) else 0.0
    knots, values = [], []
    for ones, rows, first, last in pools:
        value = (ones + rate) / (rows + 1.0)
        for m in dict.fromkeys((first, last)):
            knots.append(m)
            values.append(max(value, values[-1]) if values else value)
    if not knots:
        return Isotonic(np.zeros(1), np.full(1, rate))
    return Isotonic(np.array(knots), np.array(values))
