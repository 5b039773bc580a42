"""Vectorised work on Arrow string columns: words, lines and their 64-bit hashes, a bounded slice at a time.

A slice of a column is seen as one byte array with document offsets. Words are maximal runs of word bytes that do not
cross a document's end. Hashes are polynomial over randomised byte codes, modulo 2**64, and then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held as arrays at a time; one longer document makes a slice of its own.
SLICE_BYTES = 1 << 20

_SEED = np.random.default_rng(20240229)
_CODES = _SEED.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers(dict):
    """Tables of powers by base; they are made anew where they are sent."""

    def __reduce__(self):
        return _Powers, ()


_powers = _Powers()


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_sums(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values[i] * base**i with a leading zero; see span_hash."""
    out = np.empty(len(values) + 1, dtype=np.uint64)
    out[0] = 0
    np.cumsum(values * powers(_BASE, len(values)), out=out[1:])
    return out


def span_hash(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal content wherever it stands."""
    at = powers(_INVERSE, len(sums))[starts]
    return mix((sums[ends] - sums[starts]) * at + (ends - starts).astype(np.uint64))


def byte_table(chars: str | bytes, *, invert: bool = False) -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return ~table if invert else table


#: Words of the patterns [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (the latter after A-Z are lowered).
SPACED = byte_table(b" \t\n\x0b\x0c\r", invert=True)
ALNUM = byte_table(bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    if pa.types.is_string_view(column.type):
        column = column.cast(pa.large_string())
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, off


class Slice:
    """Documents first..last-1 of a column: their bytes, offsets from 0, and row numbers."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, last: int):
        self.first, self.last = first, last
        self.data = data[offsets[first] : offsets[last]]
        self.bounds = offsets[first : last + 1] - offsets[first]

    def __len__(self) -> int:
        return self.last - self.first

    def lowered(self) -> np.ndarray:
        return LOWER[self.data]

    def words(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and, for each document, the number of its first word (one more entry than documents)."""
        inside = table[self.data]
        if not len(inside):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self) + 1, np.int64)
        full = self.bounds[:-1] < self.bounds[1:]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[self.bounds[:-1][full]] = False
        after = np.empty_like(inside)
        after[-1], after[:-1] = False, inside[1:]
        after[self.bounds[1:][full] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.bounds)

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the newline-separated lines, and the document of each."""
        breaks = np.flatnonzero(self.data == 10)
        starts = np.sort(np.concatenate([self.bounds[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([self.bounds[1:], breaks]))
        number = np.diff(np.searchsorted(breaks, self.bounds)) + 1
        return starts, ends, np.repeat(np.arange(len(self)), number)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, *, lower: bool = False) -> np.ndarray:
        return span_hash(window_sums(_CODES[self.lowered() if lower else self.data]), starts, ends)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[Slice]:
    """The whole column in slices of about size bytes."""
    data, offsets = utf8(column)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), len(column))
        yield Slice(data, offsets, first, last)
        first = last


def tally(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of flags[bounds[i]:bounds[i+1]] for each i."""
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return np.diff(sums[bounds])
