"""Least squares from centred moments: counts, means and co-moments that are merged pairwise.

Moments of two sets of rows give those of both without going back to raw sums of products, so that columns far from zero
lose nothing. Over rows in order, blocks of 1, 2, 4, ... rows end at each row, each the merge of two of half its length; a
window of any length is the merge of a few of these.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Least share of a scaled column's variance that the columns before it may leave, for full rank.
FULL_RANK = 1e-9
#: Variances below this share of the squared mean are rounding.
CONSTANT = 1e-28


class Moments(NamedTuple):
    """For each of many sets: n (m), mean (m, d), and co (m, d, d), the sums of products of deviations from the mean."""

    n: np.ndarray
    mean: np.ndarray
    co: np.ndarray

    @staticmethod
    def of_rows(x: np.ndarray, complete: np.ndarray) -> Moments:
        """A set of one row for each row of x, or of none where it isn't complete."""
        return Moments(complete.astype(float), np.where(complete[:, None], x, 0.0), np.zeros((*x.shape, x.shape[1])))

    def take(self, at: np.ndarray) -> Moments:
        return Moments(self.n[at], self.mean[at], self.co[at])

    def shifted(self, back: int, start: np.ndarray) -> Moments:
        """At each place the moments `back` places before, those of no rows before its start."""
        at = np.arange(len(self.n)) - back
        there = at >= start
        out = self.take(np.maximum(at, 0))
        return Moments(np.where(there, out.n, 0.0), np.where(there[:, None], out.mean, 0.0), np.where(there[:, None, None], out.co, 0.0))

    def merged(self, other: Moments) -> Moments:
        n = self.n + other.n
        share = np.divide(other.n, n, out=np.zeros_like(n), where=n > 0)
        step = np.where((self.n > 0)[:, None], other.mean - self.mean, 0.0)
        mean = np.where((self.n > 0)[:, None], self.mean + step * share[:, None], other.mean)
        return Moments(n, mean, self.co + other.co + step[:, :, None] * step[:, None, :] * (self.n * share)[:, None, None])


def window_moments(each: Moments, start: np.ndarray, length: int | None) -> Moments:
    """Moments over the last `length` places (None: all) up to each one; start: of each place the first of its group."""
    longest = int((np.arange(len(start)) - start).max(initial=0)) + 1
    length = longest if length is None else min(length, longest)
    block, whole, reach = each, None, 0
    for bit in range(max(1, length.bit_length())):
        if length >> bit & 1:
            last = block.shifted(reach, start) if reach else block
            whole = last if whole is None else last.merged(whole)
            reach += 1 << bit
        if length >> (bit + 1):
            block = block.shifted(1 << bit, start).merged(block)
    return whole


def coefficients(m: Moments) -> np.ndarray:
    """Intercept and slopes of the last column on the others, for each set: least squares, of minimum norm where the
    columns depend on one another."""
    mx, my = m.mean[:, :-1], m.mean[:, -1]
    gram, q = m.co[:, :-1, :-1], m.co[:, :-1, -1]
    k = gram.shape[1]
    square = np.einsum("nii->ni", gram)
    flat = square <= CONSTANT * m.n[:, None] * mx * mx
    size = np.sqrt(np.where(flat, 1.0, square))
    scaled = np.where(flat[:, :, None] | flat[:, None, :], 0.0, gram / size[:, :, None] / size[:, None, :])
    right = np.where(flat, 0.0, q / size)
    left, rest, full = scaled.copy(), right.copy(), ~flat.any(axis=1)
    for i in range(k):  # elimination over all sets at once; pivots are what earlier columns leave
        full &= left[:, i, i] > FULL_RANK
        pivot = np.where(full, left[:, i, i], 1.0)
        for j in range(i + 1, k):
            f = left[:, j, i] / pivot
            left[:, j, i:] -= f[:, None] * left[:, i, i:]
            rest[:, j] -= f * rest[:, i]
    slopes = np.zeros_like(q)
    for i in range(k - 1, -1, -1):
        pivot = np.where(full, left[:, i, i], 1.0)
        slopes[:, i] = (rest[:, i] - np.einsum("nj,nj->n", left[:, i, i + 1 :], slopes[:, i + 1 :])) / pivot
    slopes /= size
    intercept = my - np.einsum("nj,nj->n", mx, slopes)
    for r in np.flatnonzero(~full):
        intercept[r], slopes[r] = _least_norm(scaled[r], right[r], size[r], mx[r], my[r])
    return np.column_stack([intercept, slopes])


def _least_norm(scaled: np.ndarray, right: np.ndarray, size: np.ndarray, mx: np.ndarray, my: float) -> tuple[float, np.ndarray]:
    """The solution with the least sum of squares, the intercept's included."""
    values, vectors = np.linalg.eigh(scaled)
    free = values <= FULL_RANK * max(1.0, values[-1])
    slopes = vectors[:, ~free] @ ((vectors[:, ~free].T @ right) / values[~free]) / size
    basis, _ = np.linalg.qr(vectors[:, free] / size[:, None])
    slopes = slopes - basis @ (basis.T @ slopes)
    pull = basis.T @ mx
    slopes = slopes + basis @ (pull * (my - mx @ slopes) / (1 + pull @ pull))
    return float(my - mx @ slopes), slopes


def unpacked(n: np.ndarray, means: np.ndarray, spreads: np.ndarray) -> Moments:
    """From counts, means and population covariances (pairs in the order of upper triangles); nulls are of no rows."""
    n = np.nan_to_num(n)
    d = means.shape[1]
    co = np.zeros((len(n), d, d))
    for c, (i, j) in zip(np.nan_to_num(spreads).T, ((i, j) for i in range(d) for j in range(i, d)), strict=True):
        co[:, i, j] = co[:, j, i] = c * n
    return Moments(n, np.nan_to_num(means), co)


def matrix(batch: pa.RecordBatch | pa.Table, columns: Sequence[str]) -> np.ndarray:
    """Columns as doubles, NaN for null."""
    parts = [batch.column(c) for c in columns]
    return np.column_stack([np.asarray((p.combine_chunks() if isinstance(p, pa.ChunkedArray) else p).cast(pa.float64()).to_numpy(zero_copy_only=False), float) for p in parts]) if len(batch) else np.zeros((0, len(columns)))


def group_starts(tickers: pa.Array) -> np.ndarray:
    """Of each row the first of its run of equal values; nulls are equal."""
    codes = tickers.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    new = np.r_[True, codes[1:] != codes[:-1]] if len(codes) else np.zeros(0, bool)
    return np.maximum.accumulate(np.where(new, np.arange(len(codes)), 0)) if len(codes) else codes


def trailing_fits(batches: Iterable[pa.RecordBatch], columns: Sequence[str], length: int, least: int, names: Sequence[str], chunk: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Coefficients for each row from the rows of its ticker before it.

    Rows (ticker, date, *columns) come by ticker and date. A row gets the coefficients of the latest earlier row whose
    last `length` rows have `least` complete ones; rows of too few complete ones, and rows without an earlier one that
    has enough, are left out. Of rows that are through, only what later windows need is held.
    """
    held: list[pa.RecordBatch] = []
    size, seen, last = 0, 0, None  # rows of held that are through; the ticker's latest coefficients

    def work(final: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, size, seen, last
        rows = pa.Table.from_batches(held).combine_chunks()
        tickers = rows.column("ticker").chunk(0)
        start = group_starts(tickers)
        x = matrix(rows, columns)
        complete = ~np.isnan(x).any(axis=1)
        found = window_moments(Moments.of_rows(np.nan_to_num(x), complete), start, length)
        enough = np.flatnonzero((found.n >= least) & (np.arange(len(x)) >= seen))
        b = coefficients(found.take(enough))
        before = np.vstack([np.full((1, b.shape[1]), np.nan), b[:-1]]) if len(b) else b
        if len(b):
            new = np.r_[True, start[enough][1:] != start[enough][:-1]]
            before[new] = np.nan
            if seen and last is not None and start[enough[0]] < seen:  # the ticker goes on from the rows before
                before[0] = last
        if len(x):
            of_last = enough[start[enough] == start[-1]] if len(enough) else enough
            last = b[-1] if len(of_last) else (last if seen and start[-1] < seen else None)
        keep = np.flatnonzero(~np.isnan(before).all(axis=1)) if len(b) else np.zeros(0, np.int64)
        at = pa.array(enough[keep])
        yield pa.RecordBatch.from_arrays([tickers.take(at), rows.column("date").chunk(0).take(at), *(pa.array(before[keep, i], mask=np.isnan(before[keep, i])) for i in range(len(names)))], names=["ticker", "date", *names])
        tail = max(int(start[-1]), len(x) - length + 1) if len(x) else 0
        held = rows.slice(tail).to_batches() if not final else []
        seen = size = len(x) - tail

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size - seen >= chunk:
            yield from work(False)
    if held and size > seen:
        yield from work(True)
