"""Regression trees, forests and boosting in NumPy, for the small fits that run inside a group or on the driver."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class RegressionTree:
    """Binary tree grown by variance reduction, thresholds midway between neighbouring values."""

    max_depth: int | None = None
    min_samples_leaf: int = 1
    max_features: int | None = None
    rng: np.random.Generator | None = None
    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> RegressionTree:
        x, y = np.asarray(x, float), np.asarray(y, float)
        todo = [(self._node(y), np.arange(len(y)), 0)]
        while todo:
            at, rows, depth = todo.pop()
            if self.max_depth is not None and depth >= self.max_depth:
                continue
            best = self._split(x, y, rows)
            if best is None:
                continue
            column, cut = best
            low = x[rows, column] <= cut
            sides = [rows[low], rows[~low]]
            made = [self._node(y[s]) for s in sides]
            self.feature[at], self.threshold[at], self.children[at] = column, cut, (made[0], made[1])
            todo += [(n, s, depth + 1) for n, s in zip(made, sides, strict=True)]
        return self

    def _node(self, y: np.ndarray) -> int:
        self.feature.append(-1)
        self.threshold.append(0.0)
        self.children.append((-1, -1))
        self.value.append(float(y.mean()))
        return len(self.value) - 1

    def _split(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
        n, part = len(rows), y[rows]
        if n < 2 * self.min_samples_leaf or n < 2 or np.ptp(part) == 0:
            return None
        columns = np.arange(x.shape[1])
        if self.rng is not None and self.max_features is not None and self.max_features < len(columns):
            columns = self.rng.permutation(columns)
        best, gain, tried = None, part.sum() ** 2 / n + 1e-12 * (1 + part @ part), 0
        left_n = np.arange(1, n)
        inside = (left_n >= self.min_samples_leaf) & (n - left_n >= self.min_samples_leaf)
        for c in columns:
            if self.max_features is not None and tried >= self.max_features and best is not None:
                break
            tried += 1
            order = np.argsort(x[rows, c], kind="stable")
            xs, left = x[rows, c][order], np.cumsum(part[order])[:-1]
            ok = inside & (xs[1:] > xs[:-1])
            if not ok.any():
                continue
            score = np.where(ok, left**2 / left_n + (part.sum() - left) ** 2 / (n - left_n), -np.inf)
            k = int(np.argmax(score))
            if score[k] > gain:
                mid = (xs[k] + xs[k + 1]) / 2
                best, gain = (int(c), float(mid if mid < xs[k + 1] else xs[k])), score[k]
        return best

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        feature, cut, value, kids = np.array(self.feature), np.array(self.threshold), np.array(self.value), np.array(self.children)
        at, rows = np.zeros(len(x), int), np.arange(len(x))
        while len(rows := rows[feature[at[rows]] >= 0]):
            node = at[rows]
            at[rows] = kids[node, (x[rows, feature[node]] > cut[node]).astype(int)]
        return value[at]


@dataclass
class RandomForest:
    n_estimators: int = 200
    max_depth: int | None = None
    min_samples_leaf: int = 1
    max_features: str | None = None
    bootstrap: bool = True
    random_state: int = 0
    trees: list[RegressionTree] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> RandomForest:
        x, y = np.asarray(x, float), np.asarray(y, float)
        some = max(1, int(np.sqrt(x.shape[1]))) if self.max_features == "sqrt" else None
        self.trees = []
        for rng in map(np.random.default_rng, np.random.SeedSequence(self.random_state).spawn(self.n_estimators)):
            rows = rng.integers(0, len(y), len(y)) if self.bootstrap else np.arange(len(y))
            self.trees.append(RegressionTree(self.max_depth, self.min_samples_leaf, some, rng).fit(x[rows], y[rows]))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.predict(x) for t in self.trees], axis=0)


@dataclass
class Boosting:
    """Squared-error boosting with row and column samples for each tree."""

    n_estimators: int = 300
    max_depth: int = 4
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    random_state: int = 0
    base: float = 0.0
    trees: list[tuple[np.ndarray, RegressionTree]] = field(default_factory=list)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosting:
        x, y = np.asarray(x, float), np.asarray(y, float)
        rng = np.random.default_rng(self.random_state)
        self.base, self.trees = float(y.mean()), []
        fitted = np.full(len(y), self.base)
        for _ in range(self.n_estimators):
            rows = np.flatnonzero(rng.random(len(y)) < self.subsample)
            rows = rows if len(rows) else np.arange(len(y))
            cols = np.sort(rng.permutation(x.shape[1])[: max(1, round(self.colsample_bytree * x.shape[1]))])
            tree = RegressionTree(self.max_depth).fit(x[np.ix_(rows, cols)], y[rows] - fitted[rows])
            fitted += self.learning_rate * tree.predict(x[:, cols])
            self.trees.append((cols, tree))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, float)
        return self.base + self.learning_rate * np.sum([t.predict(x[:, c]) for c, t in self.trees], axis=0)
