"""Decision trees on binned features with numpy: bagged classifiers and gradient boosting.

For models fitted on a bounded sample on the driver and applied to columns of any size by the workers.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1. A row goes left where its value is at most the node's threshold."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def add(self, value: float) -> int:
        for column, x in ((self.feature, -1), (self.threshold, 0.0), (self.left, 0), (self.right, 0), (self.value, value)):
            column.append(x)
        return len(self.value) - 1

    def apply(self, x: np.ndarray) -> np.ndarray:
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right, value = np.array(self.left), np.array(self.right), np.array(self.value)
        at = np.zeros(len(x), int)
        while True:
            inner = np.flatnonzero(feature[at] >= 0)
            if not len(inner):
                return value[at]
            node = at[inner]
            at[inner] = np.where(x[inner, feature[node]] <= threshold[node], left[node], right[node])

    def spread(self, columns: np.ndarray, node: int = 0) -> np.ndarray | float:
        """As apply, for rows given by columns: each node for all rows at once, which is faster for shallow trees."""
        if self.feature[node] < 0:
            return self.value[node]
        goes = columns[self.feature[node]] <= self.threshold[node]
        return np.where(goes, self.spread(columns, self.left[node]), self.spread(columns, self.right[node]))

    def most(self, fixed: dict[int, float], node: int = 0) -> float:
        """The highest value of a row in which some features have fixed values."""
        if self.feature[node] < 0:
            return self.value[node]
        sides = [self.left[node], self.right[node]]
        if self.feature[node] in fixed:
            sides = sides[:1] if fixed[self.feature[node]] <= self.threshold[node] else sides[1:]
        return max(self.most(fixed, x) for x in sides)


def bin_edges(x: np.ndarray, bins: int = 64) -> list[np.ndarray]:
    """Cut points of each column, between its distinct values."""
    out = []
    for column in x.T:
        values = np.unique(column)
        if len(values) > bins:
            values = np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)))
        out.append((values[1:] + values[:-1]) / 2)
    return out


def grow(binned: np.ndarray, edges: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, depth: int, least: float, ridge: float = 1e-6, columns: np.ndarray | None = None) -> Tree:
    """A tree whose leaves hold sum(gradient) / (sum(weight) + ridge); splits gain in the sum of squared gradients."""
    tree = Tree()
    columns = np.arange(binned.shape[1]) if columns is None else columns

    def leaf(rows: np.ndarray) -> float:
        return float(gradient[rows].sum() / (weight[rows].sum() + ridge))

    def split(node: int, rows: np.ndarray, level: int) -> None:
        if level == depth or len(rows) < 2 * least:
            return
        g, w = gradient[rows], weight[rows]
        whole = g.sum() ** 2 / (w.sum() + ridge)
        best, where = 1e-9, None
        for c in columns:
            size = len(edges[c]) + 1
            if size < 2:
                continue
            gs, ws = np.cumsum(np.bincount(binned[rows, c], g, size))[:-1], np.cumsum(np.bincount(binned[rows, c], w, size))[:-1]
            n = np.cumsum(np.bincount(binned[rows, c], minlength=size))[:-1]
            gain = gs**2 / (ws + ridge) + (g.sum() - gs) ** 2 / (w.sum() - ws + ridge) - whole
            gain[(n < least) | (len(rows) - n < least)] = -1
            k = int(np.argmax(gain))
            if gain[k] > best:
                best, where = gain[k], (c, k)
        if where is None:
            return
        c, k = where
        goes = binned[rows, c] <= k
        tree.feature[node], tree.threshold[node] = int(c), float(edges[c][k])
        for side, part in (("left", rows[goes]), ("right", rows[~goes])):
            child = tree.add(leaf(part))
            getattr(tree, side)[node] = child
            split(child, part, level + 1)

    rows = np.arange(len(binned))
    tree.add(leaf(rows))
    split(0, rows, 0)
    return tree


def to_bins(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1) if x.shape[1] else np.zeros((len(x), 0), int)


@dataclass
class Bagged:
    """The mean of trees grown on bootstrap samples."""

    trees: list[Tree]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, count: int = 15, depth: int = 6, least: int = 5, seed: int = 1) -> Bagged:
        rng, edges = np.random.default_rng(seed), bin_edges(x)
        binned = to_bins(x, edges)
        trees = []
        for _ in range(count):
            rows = rng.integers(0, len(x), len(x))
            trees.append(grow(binned[rows], edges, y[rows].astype(float), np.ones(len(rows)), depth, least))
        return cls(trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.apply(x) for t in self.trees], axis=0) if len(x) else np.zeros(0)


@dataclass
class Boosted:
    """Gradient boosting of the log loss."""

    start: float
    rate: float
    trees: list[Tree]

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, count: int = 60, depth: int = 4, least: int = 5, rate: float = 0.2) -> Boosted:
        edges = bin_edges(x)
        binned, mean = to_bins(x, edges), float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        start = float(np.log(mean / (1 - mean)))
        score, trees = np.full(len(x), start), []
        for _ in range(count if len(y) else 0):
            p = 1 / (1 + np.exp(-score))
            tree = grow(binned, edges, y - p, p * (1 - p), depth, least, 1.0)
            trees.append(tree)
            score += rate * tree.apply(x)
        return cls(start, rate, trees)

    def predict(self, x: np.ndarray) -> np.ndarray:
        score = np.full(len(x), self.start)
        for tree in self.trees:
            score += self.rate * tree.apply(x)
        return 1 / (1 + np.exp(-score))

    def above(self, columns: np.ndarray, least: np.ndarray, fixed: dict[int, float], step: int = 4) -> np.ndarray:
        """Places of the rows, given by columns, that predict puts above `least`; features in `fixed` have that value in all rows.

        A row is left out as soon as the highest values of the trees left can't lift it there, so most see a few trees only."""
        rest = np.append(np.cumsum([self.rate * t.most(fixed) for t in self.trees][::-1])[::-1], 0.0)
        with np.errstate(divide="ignore"):
            goal = np.log(least) - np.log1p(-least) - 1e-6  # well above what rounding may cost
        rows, score, some = np.arange(len(least)), np.full(len(least), self.start), columns
        for k in range(0, len(self.trees), step):
            can = score + rest[k] >= goal[rows]
            rows, score, some = rows[can], score[can], some[:, can]
            for tree in self.trees[k : k + step]:
                score = score + self.rate * tree.spread(some)
        return rows[self.predict(columns[:, rows].T) > least[rows]]
