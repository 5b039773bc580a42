"""Benchmark decontamination with an FM-index for each training shard.

A shard is a slice of a partition of documents. Its words are numbered by the benchmark's vocabulary; every other word ends
a run, and runs too short for the shortest phrase are left out. Over the runs stands an FM-index: Burrows-Wheeler
transform, wavelet tree of its symbols, suffix positions sampled at run starts and every few symbols. All phrases are
searched backward at once; occurrences are located by walking to a sampled position, and merged to removal spans.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import textops as X
from .shared import apart, remove, written

WINDOW = 13
SAMPLED_EVERY = 16
#: Bytes of benchmark text that are searched for in one pass; a larger benchmark takes several. A pass holds about 80
#: bytes for each word on the driver and on every worker.
BENCHMARK_BYTES = 8 << 20


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array of runs that each end with a 0, by prefix doubling. Zeros are distinct, ordered by place."""
    n = len(symbols)
    zero = symbols == 0
    base = np.where(zero, np.cumsum(zero) - 1, symbols.astype(np.int64) + n)
    order = np.argsort(base, kind="stable")
    head = np.r_[True, base[order][1:] != base[order][:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    size = np.bincount(rank, minlength=n)
    open_ = np.flatnonzero(size[rank] > 1)
    step = 1
    while len(open_):
        key = rank[open_] * (n + 1) + rank[np.minimum(open_ + step, n - 1)]
        order = np.argsort(key)
        open_, key = open_[order], key[order]
        group = key // (n + 1)
        place = np.arange(len(key))
        start = np.maximum.accumulate(np.where(np.r_[True, group[1:] != group[:-1]], place, 0))
        new = np.r_[True, key[1:] != key[:-1]]
        rank[open_] = group + np.maximum.accumulate(np.where(new, place, 0)) - start
        alone = new & np.r_[new[1:], True]
        open_ = open_[~alone]
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletTree:
    """Ranks of symbols, a bit of them a level; zeros of a level stand before its ones."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            bit = (symbols >> b) & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        self.start = self._down(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _down(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        for level, (ones, zeros) in enumerate(zip(self.ones, self.zeros, strict=True)):
            before = ones[place]
            one = (symbol >> (self.bits - 1 - level)) & 1
            place = np.where(one == 1, zeros + before, place - before)
        return place

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        """How often each symbol stands before the place."""
        return self._down(symbol, place) - self.start[symbol]


class FMIndex:
    """Of runs of symbols 1..n_symbols-1 that each end with a 0."""

    def __init__(self, symbols: np.ndarray, n_symbols: int, every: int = SAMPLED_EVERY):
        order = suffix_order(symbols)
        self.bwt = symbols[order - 1]
        self.tree = WaveletTree(self.bwt, n_symbols)
        self.counts = np.bincount(symbols, minlength=n_symbols)
        self.before = np.cumsum(self.counts) - self.counts
        begins = np.r_[True, symbols[:-1] == 0]
        start = np.maximum.accumulate(np.where(begins, np.arange(len(symbols)), 0))
        kept = ((np.arange(len(symbols)) - start) % every == 0)[order]
        self.kept, self.kept_rank, self.samples = kept, np.cumsum(kept) - 1, order[kept]

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each phrase (a row, padded at the right)."""
        last = phrases[np.arange(len(phrases)), lengths - 1]
        low, high = self.before[last], self.before[last] + self.counts[last]
        for back in range(1, phrases.shape[1]):
            at = np.flatnonzero((lengths > back) & (low < high))
            if not len(at):
                break
            symbol = phrases[at, lengths[at] - 1 - back]
            low[at] = self.before[symbol] + self.tree.rank(symbol, low[at])
            high[at] = self.before[symbol] + self.tree.rank(symbol, high[at])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of suffixes by their place in the order."""
        at, steps = rows.copy(), np.zeros(len(rows), np.int64)
        while len(todo := np.flatnonzero(~self.kept[at])):
            symbol = self.bwt[at[todo]]
            at[todo] = self.before[symbol] + self.tree.rank(symbol, at[todo])
            steps[todo] += 1
        return self.samples[self.kept_rank[at]] + steps


@dataclass
class Phrases:
    """Windows of the benchmark over a vocabulary of word digests.

    Phrase k is rows[k, :lengths[k]]; its items are names[owners[first[k] : first[k + 1]]], sorted.
    """

    vocabulary: np.ndarray
    rows: np.ndarray
    lengths: np.ndarray
    names: np.ndarray
    owners: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, benchmark: list[tuple[str, str]], window: int = WINDOW) -> Phrases:
        names, owner = np.unique(np.array([i for i, _ in benchmark], object), return_inverse=True)
        digests, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for part in X.slices(pa.array([t for _, t in benchmark], pa.string())):
            begins, ends, bounds = part.words(X.ALNUM)
            digests.append(part.hashes(begins, ends, lower=True))
            counts.append(np.diff(bounds))
        vocabulary, symbol = np.unique(np.concatenate(digests), return_inverse=True)
        words = np.concatenate(counts)
        windows = np.where(words > 0, np.maximum(words - window + 1, 1), 0)
        start = np.repeat(np.cumsum(words) - words - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
        size = np.repeat(np.minimum(words, window), windows)
        rows = np.zeros((len(start), window), np.int32)
        for k in range(window):
            long = size > k
            rows[long, k] = symbol[start[long] + k] + 1
        _, at, phrase = np.unique(rows.view(f"V{rows.itemsize * window}").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(phrase * max(1, len(names)) + np.repeat(owner, windows))
        phrase, owners = np.divmod(pairs, max(1, len(names)))
        return cls(vocabulary, rows[at], size[at], names, owners, np.searchsorted(phrase, np.arange(len(at) + 1)))

    def items(self, phrase: int) -> list[str]:
        return self.names[self.owners[self.first[phrase] : self.first[phrase + 1]]].tolist()

    def hits(self, part: X.Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple]:
        """First word and length of each occurrence in a slice, its phrase, and the slice's words."""
        spoken = part.words(X.ALNUM)
        none = np.zeros(0, np.int64)
        if not len(self.rows) or not len(spoken[0]):
            return none, none, none, spoken
        begins, ends, first = spoken
        words = part.hashes(begins, ends, lower=True)
        slot = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        symbol = np.where(self.vocabulary[slot] == words, slot + 1, 0)
        # A run ends before an unknown word and at the end of its document.
        known = symbol > 0
        begin = known & ~np.r_[False, known[:-1]]
        begin[first[:-1][first[:-1] < len(words)]] |= known[first[:-1][first[:-1] < len(words)]]
        run = np.cumsum(begin) - 1
        run[~known] = -1
        long = np.bincount(run[known], minlength=1) >= self.lengths.min()
        keep = np.flatnonzero(known & long[run])
        if not len(keep):
            return none, none, none, spoken
        last = np.r_[run[keep][1:] != run[keep][:-1], True]
        shift = np.cumsum(last) - last  # zeros before each kept word
        symbols, word = np.zeros(len(keep) + int(last.sum()), np.int64), np.zeros(len(keep) + int(last.sum()), np.int64)
        place = np.arange(len(keep)) + shift
        symbols[place], word[place] = symbol[keep], keep
        index = FMIndex(symbols, len(self.vocabulary) + 1)
        low, high = index.search(self.rows, self.lengths)
        phrase = np.repeat(np.arange(len(low)), np.maximum(high - low, 0))
        some = np.flatnonzero(high > low)
        rows = np.concatenate([np.arange(low[i], high[i]) for i in some]) if len(some) else none
        return word[index.locate(rows)], self.lengths[phrase], phrase, spoken


HIT_FIELDS = [T.StructField(n, T.LongType()) for n in ("n_words", "n_hit")] + [
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("removal_spans", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")]))),
]
_HIT_NAMES = [f.name for f in HIT_FIELDS]
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _searched(text_col: str, load: Callable[[], Phrases]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds HIT_FIELDS; where they are there already, of an earlier part of the benchmark, hits are added to those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = load()
        for batch in batches:
            names = [n for n in batch.schema.names if n not in _HIT_NAMES]
            for part in X.slices(batch.column(batch.schema.get_field_index(text_col))):
                rows = batch.slice(part.first, len(part))
                start, length, phrase, (begins, ends, first) = phrases.hits(part)
                items: list[set[str]] = [set() for _ in range(len(part))]
                edges = np.zeros(len(begins) + 1, np.int64)
                np.add.at(edges, start, 1)
                np.add.at(edges, start + length, -1)
                hit = np.cumsum(edges[:-1]) > 0
                doc = np.searchsorted(first, start, side="right") - 1
                for d, p in set(zip(doc.tolist(), phrase.tolist(), strict=True)):
                    items[d].update(phrases.items(p))
                if "removal_spans" in batch.schema.names:
                    for d, (old, spans) in enumerate(zip(rows.column("items").to_pylist(), rows.column("removal_spans").to_pylist(), strict=True)):
                        items[d].update(old)
                        for s in spans:
                            a, b = np.searchsorted(begins, [s["start"] + part.bounds[d], s["end"] + part.bounds[d]])
                            hit[a:b] = True
                step = np.diff(np.r_[0, hit.astype(np.int8), 0])
                on, off = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
                spans: list[list[dict]] = [[] for _ in range(len(part))]
                for a, b in zip(on.tolist(), off.tolist(), strict=True):
                    cuts = [a, *first[(first > a) & (first < b)].tolist(), b]  # a run of hits may go over documents' ends
                    for x, y in zip(cuts, cuts[1:], strict=False):
                        if x < y:
                            d = int(np.searchsorted(first, x, side="right")) - 1
                            spans[d].append({"start": int(begins[x] - part.bounds[d]), "end": int(ends[y - 1] - part.bounds[d])})
                added = [pa.array(np.diff(first)), pa.array(X.tally(hit, first)), pa.array([sorted(s) for s in items], pa.list_(pa.string())), pa.array(spans, _SPANS)]
                yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), *added], names=[*names, *_HIT_NAMES])

    return run


def benchmark_blocks(benchmark: DataFrame, *, id_col: str, text_col: str, limit: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks that reach limit bytes of text with their last item; one block is on the driver at a time."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    block: list[tuple[str, str]] = []
    size = number = 0
    for item, text in items.toLocalIterator():
        block.append((item, text))
        size += len(text.encode())
        if size >= limit:
            yield block
            block, size, number = [], 0, number + 1
    if block or not number:
        yield block


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, benchmark_bytes: int = BENCHMARK_BYTES) -> DataFrame:
    """docs with n_words, n_hit (words inside occurrences), items (ids as strings, sorted) and removal_spans (UTF-8 bytes).

    Words are runs of letters, digits and non-ASCII characters, A-Z lowered; a phrase is `window` consecutive words of an
    item, or all of a shorter one. Null texts have no words and no hits. Items that share an id are one item; items without
    words are never found, those without id have the empty id. Repeated rows are each searched. Empty tables give empty
    ones; an empty benchmark hits nothing. Columns of docs with the names of the added ones are replaced. One narrow pass
    for each block of the benchmark: a block's phrases are sent to the workers, and no block exceeds benchmark_bytes by
    more than an item. Between blocks rows are written with what was found so far, so that a worker holds one block.
    """
    spark = docs.sparkSession
    out = docs.select([c for c in docs.columns if c not in _HIT_NAMES])
    schema = T.StructType([*out.schema.fields, *HIT_FIELDS])
    path = sent = None
    for block in benchmark_blocks(benchmark, id_col=item_col, text_col=item_text_col, limit=benchmark_bytes):
        if sent is not None:  # what the block before found is written, and that block given up
            last = path
            out, path = written(out, "contamination")
            sent.destroy()
            if last:
                remove(spark, last)
        found = Phrases.of(block, window)
        sent = spark.sparkContext.broadcast(tuple(vars(found).values()))
        out = out.mapInArrow(_searched(text_col, lambda sent=sent: Phrases(*sent.value)), schema)
    return out


def contaminated(n_hit, n_words):
    """At least a twentieth of the words lies inside benchmark phrases."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", **kw) -> DataFrame:
    """The rows of docs that are not contaminated, with all their own columns, whatever their names.

    Null and empty texts are clean; repeated rows stay or go alike; an empty table gives an empty one, and an empty
    benchmark takes nothing.
    """
    own, name, back = apart(docs)
    found = find_contamination(own, benchmark, text_col=name(text_col), **kw)
    return back(found.filter(~contaminated(F.col("n_hit"), F.col("n_words"))))
