"""Repeated passages by sparse suffix arrays.

Every window of min_words words has an anchor: the position of the smallest digest among its first `window` k-grams. Equal
windows have equal anchors, so only the suffixes at anchors are kept, about 2 / (window + 1) of all. Any window goes on for
at least min_words - window + 1 words to the right of its anchor; suffixes that share these with no other are dropped.
The others are sorted, neighbours are compared, and matches are extended: right by the common prefix of neighbours, left
by the words before the anchor. Where that makes min_words words, the window is repeated; covered windows are merged.

Suffixes are told by their next min_words words and the words before the anchor: what is kept of one is bounded however
long its document is. Runs of neighbours too large for one task are not compared there: suffixes with the
same words around them are collapsed, and the windows of the rest are hashed one by one and counted, which finds the same.
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
from .shared import hot_join, materialise


_PLACES = 4


@dataclass(frozen=True)
class Repeats:
    """min_words: least length of a repeat. log_window: the k-grams that an anchor is chosen from, as a power of two.

    large_run: documents with suffixes of equal beginnings that one task compares, of _PLACES suffixes each on average.
    """

    min_words: int = 50
    gram: int = 5
    log_window: int = 5
    large_run: int = 5000

    def __post_init__(self):
        if self.window + self.gram - 1 > self.min_words:
            raise ValueError("window + gram - 1 exceeds min_words")

    @property
    def window(self) -> int:
        return 1 << self.log_window

    @property
    def shared_prefix(self) -> int:
        return self.min_words - self.window + 1


class Anchors:
    """Anchors of a slice: of window number i (starting at word starts[i]) the word at[i], and the words' digests."""

    def __init__(self, part: X.Slice, how: Repeats):
        begins, ends, self.first = part.words(X.SPACED)
        self.words = part.hashes(begins, ends, lower=True)
        self.sums = X.window_sums(self.words)
        n = len(self.words)
        doc_end = np.repeat(self.first[1:], np.diff(self.first))
        self.starts = np.flatnonzero(np.arange(n) + how.min_words <= doc_end)
        if not len(self.starts):
            self.at = self.anchors = self.keys = self.starts
            return
        grams = np.arange(n - how.gram + 1)
        place = np.uint64((1 << max(1, n.bit_length())) - 1)
        low = (X.span_hash(self.sums, grams, grams + how.gram) & ~place) | grams.astype(np.uint64)
        for k in range(how.log_window):
            low = np.minimum(low[: -(1 << k)], low[1 << k :])
        self.at = (low[self.starts] & place).astype(np.int64)
        self.anchors = np.unique(self.at)
        self.keys = X.span_hash(self.sums, self.anchors, self.anchors + how.shared_prefix)

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1


def _anchor_keys(how: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in X.slices(batch.column(1)):
                found = Anchors(part, how)
                keys, of = found.keys.astype(np.uint64), found.doc_of(found.anchors)
                _, once, places = np.unique(keys ^ X.mix(of.astype(np.uint64) + np.uint64(1)), return_index=True, return_counts=True)  # a row for each document
                rows = pa.array(of[once] + part.first)
                own = [batch.column(i).take(rows) for i in (0, 2, 3)]
                yield pa.RecordBatch.from_arrays([pa.array(keys[once].view(np.int64)), *own, pa.array(places.astype(np.int64))], names=["key", "id", "text_a", "text_b", "places"])

    return run


def _suffixes(how: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (id, text, keys) the suffixes at anchors with these keys: 32-bit digests of the words right and left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            for part in X.slices(batch.column(1)):
                found = Anchors(part, how)
                rows = lists.slice(part.first, len(part))
                wanted, doc = rows.flatten(), np.repeat(np.arange(len(part)), np.diff(rows.offsets.to_numpy()))
                pairs = (wanted.field("key").to_numpy(zero_copy_only=False).view(np.uint64) ^ X.mix(doc.astype(np.uint64) + np.uint64(1)))
                of = found.doc_of(found.anchors)
                mine = found.keys.astype(np.uint64) ^ X.mix(of.astype(np.uint64) + np.uint64(1))
                order = np.argsort(pairs)
                slot = np.minimum(np.searchsorted(pairs[order], mine), max(len(order) - 1, 0))
                keep = np.flatnonzero(pairs[order][slot] == mine) if len(order) else np.zeros(0, np.int64)
                at, of = found.anchors[keep], of[keep]
                # Windows of an anchor start at consecutive words.
                low = found.starts[np.searchsorted(found.at, at, side="left")]
                high = found.starts[np.searchsorted(found.at, at, side="right") - 1]
                short = np.append(found.words, np.uint64(0)).astype(np.uint32)
                end, begin, n = found.first[of + 1], found.first[of], len(found.words)
                right = at[:, None] + np.arange(how.min_words)
                right = np.where(right < end[:, None], short[np.minimum(right, n)], 0).astype(np.uint32)
                left = at[:, None] - 1 - np.arange(how.window - 1)
                left = np.where(left >= begin[:, None], short[np.maximum(left, 0)], 0).astype(np.uint32)
                binary = lambda a: pa.Array.from_buffers(pa.binary(a.shape[1] * 4), len(a), [None, pa.py_buffer(np.ascontiguousarray(a).tobytes())]).cast(pa.binary())
                # Suffixes of a document with the same words around them are one row with several places.
                kind = left_digests(right)[:, -1] ^ X.mix(left_digests(left)[:, -1]) ^ X.mix(mine[keep] + (at - low).astype(np.uint64) * np.uint64(64) + (at - high).astype(np.uint64))
                _, once, which = np.unique(kind, return_index=True, return_inverse=True)
                places = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(which, minlength=len(once)))].astype(np.int32)), pa.array((at - begin)[np.argsort(which, kind="stable")].astype(np.int64)))
                sizes = wanted.field("n").take(pa.array(order[slot[keep[once]]])) if len(order) else pa.array([], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.keys[keep[once]].astype(np.uint64).view(np.int64)), sizes, batch.column(0).take(pa.array(of[once] + part.first)), places, pa.array((at - high)[once].astype(np.int32)), pa.array((at - low)[once].astype(np.int32)), binary(right[once]), binary(left[once])],
                    names=["key", "n", "id", "at", "least", "most", "right", "left"],
                )

    return run


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(-1, width)


def left_digests(left: np.ndarray) -> np.ndarray:
    """Column d: digest of the d words before the anchor."""
    out = np.zeros((len(left), left.shape[1] + 1), np.uint64)
    for d in range(left.shape[1]):
        out[:, d + 1] = X.mix(out[:, d] + left[:, d].astype(np.uint64) + np.uint64(1))
    return out


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first and last column of each run of true in a matrix."""
    padded = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    padded[:, 1:-1] = flags
    step = np.diff(padded, axis=1)
    row, first = np.nonzero(step == 1)
    _, last = np.nonzero(step == -1)
    return row, first, last - 1


def compare_neighbours(key: np.ndarray, doc: np.ndarray, least: np.ndarray, most: np.ndarray, right: np.ndarray, left: np.ndarray, how: Repeats) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix and each d (its window that starts d words before the anchor): is it in several documents, and in
    an earlier one. doc is a number for each document, in the order in which copies are kept.
    """
    order = np.lexsort([*right.T[::-1], key])
    key, doc, least, most, right, left = key[order], doc[order], least[order], most[order], right[order], left[order]
    n = len(key)
    differ = np.ones((n, how.min_words + 1), bool)
    differ[1:, :-1] = right[1:] != right[:-1]
    common = np.argmax(differ, axis=1)  # words shared with the neighbour above
    common[0] = 0
    common[1:][key[1:] != key[:-1]] = 0
    before = left_digests(left)
    several, later = np.zeros((n, how.window), bool), np.zeros((n, how.window), bool)
    for d in range(how.window):
        rows = np.flatnonzero((least <= d) & (d <= most))
        if len(rows) < 2:
            continue
        stretch = np.cumsum(common < how.min_words - d)[rows]
        by = np.lexsort([doc[rows], before[rows, d], stretch])
        rows, stretch = rows[by], stretch[by]
        new = np.r_[True, (stretch[1:] != stretch[:-1]) | (before[rows[1:], d] != before[rows[:-1], d])]
        first = np.flatnonzero(new)
        size = np.diff(np.r_[first, len(rows)])
        low, high = np.repeat(doc[rows[first]], size), np.repeat(doc[rows[first + size - 1]], size)
        several[rows, d] = low != high
        later[rows, d] = doc[rows] != low
    back = np.empty(n, np.int64)
    back[order] = np.arange(n)
    return several[back], later[back]


def _spans(ids: pa.Array, places: pa.Array, flags: np.ndarray, removable: bool, how: Repeats) -> pa.RecordBatch:
    """The covered words of each row's places. What is removable is repeated too, and needs no second span for that."""
    row, first, last = runs(flags)
    number = places.value_lengths().to_numpy(zero_copy_only=False)[row]
    at = places.take(pa.array(row)).flatten().to_numpy()
    row, first, last = (np.repeat(x, number) for x in (row, first, last))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(at - last), pa.array(at - first + how.min_words), pa.array(np.full(len(row), removable))], names=["id", "start", "end", "removable"])


def _neighbours(how: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From suffixes sorted by key, whole runs at a time."""

    def settle(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        if not len(rows):
            return
        col = {n: rows.column(n).chunk(0) for n in rows.column_names}
        num = lambda n: col[n].to_numpy(zero_copy_only=False)
        ids = col["id"].field("id").dictionary_encode()
        names = ids.dictionary.to_pylist()
        rank = np.empty(len(names) + 1, np.int64)
        rank[sorted(range(len(names)), key=lambda i: names[i])] = np.arange(len(names))
        rank[-1] = len(names)  # null ids are the last
        rank = rank[ids.indices.fill_null(len(names)).to_numpy(zero_copy_only=False)]
        digests = [col["id"].field(n).to_numpy(zero_copy_only=False) for n in ("text_a", "text_b")]
        doc = np.unique(np.column_stack([rank, *digests]), axis=0, return_inverse=True)[1].reshape(-1)
        several, later = compare_neighbours(num("key"), doc, num("least"), num("most"), _matrix(col["right"], how.min_words), _matrix(col["left"], how.window - 1), how)
        yield _spans(col["id"], col["at"], several & ~later, False, how)
        yield _spans(col["id"], col["at"], later, True, how)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += len(batch)
            if size < 4 * how.large_run:
                continue
            rows = pa.Table.from_batches(held)
            keys = rows.column("key").to_numpy()
            cut = int(np.searchsorted(keys, keys[-1]))
            yield from settle(rows.slice(0, cut))
            held, size = rows.slice(cut).to_batches(), len(rows) - cut
        if held:
            yield from settle(pa.Table.from_batches(held))

    return run


def _windows(how: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each window of each kind of suffix, with a digest of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                some = batch.slice(at, 4096)
                col = {n: some.column(i) for i, n in enumerate(some.schema.names)}
                left = left_digests(_matrix(col["left"], how.window - 1))
                right = left_digests(_matrix(col["right"], how.min_words))
                d = np.arange(how.window)
                digest = X.mix(left[:, : how.window] + X.mix(right[:, how.min_words - d] + d.astype(np.uint64)))
                least, most = (col[n].to_numpy(zero_copy_only=False)[:, None] for n in ("least", "most"))
                row, shift = np.nonzero((least <= d) & (d <= most))
                rows = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(digest[row, shift].view(np.int64)), *(col[n].take(rows) for n in ("key", "kind", "low", "high")), pa.array(shift.astype(np.int32))], names=["digest", "key", "kind", "low", "high", "shift"])

    return run


def _members(how: Repeats) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Spans of suffixes (id, at, met) by the repeated windows of their kind; met: shift and the document that keeps it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for begin in range(0, len(whole), 1024):
                batch = whole.slice(begin, 1024)
                ids, met = batch.column(0), batch.column(2)
                flat, row = met.flatten(), np.repeat(np.arange(len(batch)), met.value_lengths().to_numpy(zero_copy_only=False))
                shift, keeper = flat.field("shift").to_numpy(zero_copy_only=False), flat.field("keeper").to_pylist()
                own = ids.take(pa.array(row)).to_pylist()
                several, later = np.zeros((len(batch), how.window), bool), np.zeros((len(batch), how.window), bool)
                several[row, shift] = True
                later[row, shift] = [a != b for a, b in zip(own, keeper, strict=True)]
                yield _spans(ids, batch.column(1), several & ~later, False, how)
                yield _spans(ids, batch.column(1), later, True, how)

    return run


def _large_runs(large: DataFrame, kind: T.DataType, found: T.StructType, how: Repeats) -> DataFrame:
    """Spans of suffixes in runs too large to compare in one task.

    Suffixes with the same words around them are one kind: copies of a document are collapsed before windows are made. A
    kind's repeated windows, at most `window` of them, then go to each of its members.
    """
    named = large.withColumn("kind", F.xxhash64("right", "left", "least", "most"))
    kinds = named.groupBy("key", "kind").agg(*(F.first(c).alias(c) for c in ("right", "left", "least", "most")), F.min("id").alias("low"), F.max("id").alias("high"))
    fields = [T.StructField(c, T.LongType()) for c in ("digest", "key", "kind")] + [T.StructField("low", kind), T.StructField("high", kind), T.StructField("shift", T.IntegerType())]
    windows = materialise(kinds.mapInArrow(_windows(how), T.StructType(fields)), "suffix-windows")
    often = windows.groupBy("digest").agg(F.min("low").alias("keeper"), F.max("high").alias("last")).filter("NOT (keeper <=> last)").select("digest", "keeper")
    met = windows.join(often, "digest").groupBy("key", "kind").agg(F.collect_list(F.struct("shift", "keeper")).alias("met"))
    sizes = named.groupBy("key", "kind").agg(F.count("*").alias("members"))
    met = materialise(met.join(sizes, ["key", "kind"]), "suffix-met")
    return hot_join(named.select("key", "kind", "id", "at"), met, ["key", "kind"], "members").filter("met IS NOT NULL").select("id", "at", "met").mapInArrow(_members(how), found)


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans; touching spans are joined."""
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    cut = np.flatnonzero(starts[1:] > reach[:-1])
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), reach[np.r_[cut, len(reach) - 1]].tolist(), strict=True)) if len(starts) else []


SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end")]))
_SPAN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for spans in batch.column(1).to_pylist():
            both = []
            for only in (False, True):
                chosen = np.array([(s["start"], s["end"]) for s in spans if s["removable"] or not only], np.int64).reshape(-1, 2)
                both.append(merged(chosen[:, 0], chosen[:, 1]))
            out.append(both)
        words = [pa.array([sum(e - s for s, e in o[k]) for o in out], pa.int64()) for k in (0, 1)]
        lists = [pa.array([[{"start": s, "end": e} for s, e in o[k]] for o in out], _SPAN_TYPE) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *words, *lists], names=[batch.schema.names[0], "n_repeated", "n_removable", "repeated", "removable"])


def repeated_passages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", how: Repeats = Repeats()) -> DataFrame:
    """One row for each document with a passage of min_words or more words that other documents have too.

    id, n_repeated and n_removable (words), repeated and removable (spans of word numbers, end excluded). Words are split
    at ASCII white space, A-Z lowered. Of each repeated window the document with the smallest id keeps it; elsewhere it is
    removable. Documents without a repeat, null and short texts give no row; an empty table gives an empty one. Rows equal in
    id and text are one document; different texts under one id, or without any, are documents of their own, each with its
    own row, kept in the order of their digests. Repeats within one document alone don't count. Only the two named columns
    are read.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).select("id", "text", F.xxhash64("id", "text").alias("text_a"), F.xxhash64(F.lit(1), "id", "text").alias("text_b"))
    read = read.withColumn("id", F.struct(F.col("id").isNull().alias("none"), "id", "text_a", "text_b"))  # a document
    kind = read.schema["id"].dataType
    key_fields = [T.StructField("key", T.LongType()), T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("text_a", "text_b", "places"))]
    keys = materialise(read.mapInArrow(_anchor_keys(how), T.StructType(key_fields)), "suffix-keys")
    shared = keys.groupBy("key").agg(F.greatest(F.count("*"), F.ceil(F.sum("places") / _PLACES)).alias("n"), F.count("*").alias("uses"), F.min("id").alias("low"), F.max("id").alias("high"))
    shared = materialise(shared.filter("NOT (low <=> high)").select("key", "n", "uses"), "suffix-shared")
    # Keys are gathered by text, not by id, so that a list is bounded by a text, and rows without id have lists of their own.
    wanted = hot_join(keys, shared, ["key"], "uses").filter("n IS NOT NULL").groupBy("text_a", "text_b").agg(F.collect_set(F.struct("key", "n")).alias("keys"))
    texts = read.join(wanted, ["text_a", "text_b"]).select("id", "text", "keys")
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("id", kind), T.StructField("at", T.ArrayType(T.LongType())), *(T.StructField(c, T.IntegerType()) for c in ("least", "most")), *(T.StructField(c, T.BinaryType()) for c in ("right", "left"))])
    suffixes = materialise(texts.mapInArrow(_suffixes(how), schema), "suffixes")

    found = T.StructType([T.StructField("id", kind), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("removable", T.BooleanType())])
    small = suffixes.filter(F.col("n") <= how.large_run).repartition(parts, "key").sortWithinPartitions("key").mapInArrow(_neighbours(how), found)
    met = _large_runs(suffixes.filter(F.col("n") > how.large_run), kind, found, how)
    spans = small.unionByName(met).groupBy("id").agg(F.collect_set(F.struct("start", "end", "removable")).alias("spans"))
    counts = [T.StructField(n, T.LongType()) for n in ("n_repeated", "n_removable")]
    return spans.select(F.col("id.id").alias(id_col), "spans").mapInArrow(_merge, T.StructType([docs.schema[id_col], *counts, T.StructField("repeated", SPANS), T.StructField("removable", SPANS)]))
