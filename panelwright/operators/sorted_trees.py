"""Regression trees over rows that are all at hand, cut between any two neighbouring values.

Rows are sorted by each feature once; a level keeps them sorted within its nodes, so that every cut of every node is scored
from running sums. Several trees are grown together: their nodes are segments of the same arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np

#: Rows of trees that are grown together.
TOGETHER = 1 << 15
#: Cuts whose gains differ by less than this share of them are equal: the first feature's is taken.
EQUAL = 1e-10


@dataclass(frozen=True)
class SortedTree:
    """Of each node the feature (-1: a leaf), the cut, the first child (the other follows it) and the mean of its rows."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    value: np.ndarray

    def said(self, x: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Values of the leaves that rows fall into; x has a feature a line."""
        flat, n, at, going = x.reshape(-1), x.shape[1], np.zeros(len(rows), np.int32), np.arange(len(rows))
        while len(going):
            node = at[going]
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.all():
                going, node, feature = going[inner], node[inner], feature[inner]
            at[going] = self.left[node] + (flat[feature.astype(np.int64) * n + rows[going]] > self.cut[node])
        return self.value[at]


class Sorted:
    """Rows as they are sorted by each feature. x: a feature a line."""

    def __init__(self, x: np.ndarray):
        self.x, self.n = np.ascontiguousarray(x, float), x.shape[1]
        self.order = np.argsort(self.x, axis=1, kind="stable").astype(np.int32)
        self.rank = np.empty_like(self.order)
        self.ties = np.zeros(len(x), bool)
        for f, o in enumerate(self.order):
            v = self.x[f, o]
            new = v[1:] != v[:-1]
            self.ties[f] = not new.all()
            self.rank[f, o] = np.concatenate([[0], np.cumsum(new)]) if self.n else 0

    def grow(self, y: np.ndarray, weights: Sequence[np.ndarray], max_depth: int | None, least: int, tried: Callable[[int, np.ndarray], np.ndarray] | None = None) -> tuple[list[SortedTree], list[np.ndarray]]:
        """A tree for each array of weights of the rows, and what each says of its own rows (NaN: of others).

        tried(tree, nodes): features tried at each node, a line each; without it all are.
        """
        many, trees = len(self.x), len(weights)
        inside = [w > 0 for w in weights]
        own = [np.flatnonzero(i) for i in inside]
        sizes = np.array([len(o) for o in own])
        row = np.concatenate(own) if trees else np.zeros(0, np.int64)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        order = np.empty((many, len(row)), np.int64)
        for t, i in enumerate(inside):
            place = np.cumsum(i) + (starts[t] - 1)
            for f in range(many):
                o = self.order[f]
                order[f, starts[t] : starts[t + 1]] = place[o[i[o]]]
        w = np.concatenate([v[o] for v, o in zip(weights, own, strict=True)]).astype(float) if trees else np.zeros(0)
        plain = bool((w == 1).all())
        found = y[row]
        rank = self.rank[:, row] if self.ties.any() else None
        said = np.full(len(row), np.nan)

        tree = np.flatnonzero(sizes)
        node, length, counts = np.zeros(len(tree), np.int64), sizes[tree], np.ones(trees, np.int64)
        splits, values = [], []
        depth = 0
        while True:
            n, s, q = self._sums(order[0], w, found, length)
            values.append((tree, node, s / np.maximum(n, 1e-300)))
            ends = (length < 2) | (n < 2 * least - 0.5) if max_depth is None or depth < max_depth else np.ones(len(n), bool)
            # Rows of nodes that go no deeper are done.
            order, length = self._without(order, length, ends, said, values[-1][2])
            tree, node, n, s, q = (v[~ends] for v in (tree, node, n, s, q))
            if not len(tree):
                break
            start = np.cumsum(length) - length
            best, pos, feature = self._cuts(order, w, found, s / n, n, start, length, plain, least, rank, tried and self._tried(tried, tree, node))
            good = best > 1e-12 * (1 + q)
            if not good.all():
                said[order[0][np.repeat(~good, length)]] = np.repeat((s / n)[~good], length[~good])
                if not good.any():
                    break
            at, f = pos[good], feature[good]
            low, high = (self.x[f, row[order[f, p]]] for p in (at, at + 1))
            middle = (low + high) / 2
            first = counts[tree[good]] + 2 * self._places(tree[good], node[good])
            counts += 2 * np.bincount(tree[good], minlength=trees)
            splits.append((tree[good], node[good], f, np.where(middle < high, middle, low), first))
            order = self._parted(order, feature, pos, length, good)
            below = (pos - start + 1)[good]
            length = np.concatenate([below, length[good] - below])
            tree, node = np.tile(tree[good], 2), np.concatenate([first, first + 1])
            depth += 1

        offset = np.concatenate([[0], np.cumsum(counts)])
        flat = SortedTree(np.full(offset[-1], -1, np.int16), np.zeros(offset[-1]), np.zeros(offset[-1], np.int32), np.full(offset[-1], np.nan))
        for t, k, f, c, l in splits:
            at = offset[t] + k
            flat.feature[at], flat.cut[at], flat.left[at] = f, c, l
        for t, k, v in values:
            flat.value[offset[t] + k] = v
        every = [SortedTree(*(v[a:b] for v in (flat.feature, flat.cut, flat.left, flat.value))) for a, b in zip(offset, offset[1:])]
        each = []
        for t in range(trees):
            told = np.full(self.n, np.nan)
            told[own[t]] = said[starts[t] : starts[t + 1]]
            each.append(told)
        return every, each

    @staticmethod
    def _sums(here: np.ndarray, w: np.ndarray, y: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Weight, sum and sum of squares of each node."""
        if not len(here):
            return np.zeros(0), np.zeros(0), np.zeros(0)
        start = np.cumsum(length) - length
        w, y = w[here], y[here]
        return tuple(np.add.reduceat(v, start) for v in (w, w * y, w * y * y))

    @staticmethod
    def _without(order: np.ndarray, length: np.ndarray, ends: np.ndarray, said: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not ends.any():
            return order, length
        out = np.repeat(ends, length)
        said[order[0][out]] = np.repeat(value[ends], length[ends])
        gone = np.zeros(len(said), bool)
        gone[order[0][out]] = True
        many, left = len(order), int(length[~ends].sum())
        kept = np.empty((many, left), order.dtype)
        for f in range(many):
            np.compress(~gone[order[f]], order[f], out=kept[f])
        return kept, length[~ends]

    @staticmethod
    def _places(tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Of each node its place among the nodes of its tree."""
        by = np.lexsort((node, tree))
        out = np.empty(len(by), np.int64)
        out[by] = np.arange(len(by)) - np.searchsorted(tree[by], tree[by])
        return out

    def _tried(self, tried: Callable[[int, np.ndarray], np.ndarray], tree: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Features by nodes: whether they are left out."""
        out = np.ones((len(node), len(self.x)), bool)
        for t in np.unique(tree):
            at = np.flatnonzero(tree == t)
            out[at[:, None], tried(int(t), node[at])] = False
        return out.T

    def _cuts(self, order, w, y, mean, n, start, length, plain, least, rank, untried):
        """Of each node the gain of its best cut, the place of the last row below it, and its feature."""
        many, size = order.shape
        left = np.empty(len(w))
        left[order[0]] = y[order[0]] - np.repeat(mean, length)
        if not plain:
            left *= w
        last, all_n = start + length - 1, np.repeat(n, length)
        # Weights before each node are the same for every feature.
        before = np.repeat(np.cumsum(n) - n, length)
        used = range(many) if untried is None else np.flatnonzero(~untried.all(axis=1))
        gains, every = np.zeros((many, len(start))), np.empty((many, size))
        shares = self._shares(np.arange(1.0, size + 1) - before, all_n, last, least) if plain else None
        for f in used:
            o, g = order[f], every[f]
            np.cumsum(left[o], out=g)
            g *= g
            g *= shares if plain else self._shares(np.cumsum(w[o]) - before, all_n, last, least)
            if rank is not None and self.ties[f]:
                r = rank[f][o]
                g[:-1][r[1:] == r[:-1]] = 0.0
            np.maximum.reduceat(g, start, out=gains[f])
        if untried is not None:
            gains[untried] = 0.0
        best = gains.max(axis=0)
        feature = np.argmax(gains >= best * (1 - EQUAL), axis=0)
        idx = np.arange(size)
        equal = every[np.repeat(feature, length), idx] >= np.repeat(best * (1 - EQUAL), length)
        return best, np.minimum.reduceat(np.where(equal, idx, size), start), feature

    @staticmethod
    def _shares(below: np.ndarray, n: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
        """n / (rows below x rows above), none where a side has too few rows."""
        above = n - below
        above[last] = np.inf
        few = (below < least - 0.5) | (above < least - 0.5) if least > 1 else None
        above *= below
        np.divide(n, above, out=above)
        if few is not None:
            above[few] = 0.0
        return above

    @staticmethod
    def _parted(order: np.ndarray, feature: np.ndarray, pos: np.ndarray, length: np.ndarray, good: np.ndarray) -> np.ndarray:
        """Rows of the lower children and then of the upper ones of the nodes that are cut, still sorted within each."""
        many, size = order.shape
        idx = np.arange(size)
        chosen = order[np.repeat(feature, length), idx]
        down = idx <= np.repeat(pos, length)
        side = np.zeros(int(chosen.max()) + 1, np.int8)
        side[chosen] = np.where(down, 1, 2)
        if not good.all():
            side[chosen[np.repeat(~good, length)]] = 0
        n = int(length[good].sum())
        lower = int((side == 1).sum())
        out = np.empty((many, n), order.dtype)
        for f in range(many):
            o = order[f]
            of = side[o]
            np.compress(of == 1, o, out=out[f, :lower])
            np.compress(of == 2, o, out=out[f, lower:])
        return out


def forest_said(data: Sorted, train: np.ndarray, y: np.ndarray, numbers: range, weigh: Callable[[int], np.ndarray], max_depth: int | None, least: int, tried: Callable | None) -> tuple[np.ndarray, int]:
    """Sums of what the trees of these numbers say of each row, and the number of trees that have rows."""
    total, n = np.zeros(data.n), 0
    together = max(1, TOGETHER // max(1, int(train.sum())))
    for a in range(numbers.start, numbers.stop, together):
        some = range(a, min(a + together, numbers.stop))
        weights = [np.where(train, weigh(t), 0.0) for t in some]
        trees, told = data.grow(y, weights, max_depth, least, None if tried is None else lambda k, nodes, some=some: tried(some[k], nodes))
        for tree, own in zip(trees, told, strict=True):
            if np.isnan(tree.value[0]):
                continue
            others = np.flatnonzero(np.isnan(own))
            own[others] = tree.said(data.x, others)
            total += own
            n += 1
    return total, n


def boosted_said(data: Sorted, train: np.ndarray, y: np.ndarray, trees: int, weigh: Callable[[int], np.ndarray], rate: float, max_depth: int | None, least: int, tried: Callable | None) -> np.ndarray:
    """What a constant and trees on what is left, each worth rate, say of each row."""
    said = np.full(data.n, y[train].mean())
    for number in range(trees):
        w = np.where(train, weigh(number), 0.0)
        if not w.any():
            w = train.astype(float)
        (tree,), (own,) = data.grow(y - said, [w], max_depth, least, None if tried is None else lambda _, nodes, number=number: tried(number, nodes))
        others = np.flatnonzero(np.isnan(own))
        own[others] = tree.said(data.x, others)
        said += rate * own
    return said
