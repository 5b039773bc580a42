"""Importance resampling towards a target distribution.

A document's weight is the mean gain of its features: hashed words and pairs of neighbouring words that are more frequent
in the target than in the corpus gain, others lose. Gumbel noise by id makes a draw without replacement of the documents
with the highest scores. Buckets of features are scored as arrays. The draw is an external merge: each task sorts its
eligible rows into runs and cuts these into blocks; a task for each range of scores lets the blocks' heads play a
tournament, whose winners get consecutive ranks until all draws are made.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import textops as X
from .shared import hot_join, materialise

Batches = Iterator[pa.RecordBatch]

_ONES = np.uint32(0xFFFFFFFF)
#: Words of more bytes than this are hashed one by one.
_SHORT = 48


@dataclass(frozen=True)
class Draw:
    """Hashed features, the share of eligible documents to draw, and the sizes of the merge.

    run_rows: rows that a task sorts at a time. block_rows: rows of a run that travel and are held together; a merging
    task holds one block of each run at a time. range_rows: rows that a merging task takes, about; the rows of one score
    stay together, which by the noise are a few of ten thousand rows, whatever the texts.
    """

    buckets: int = 10_000
    percent: int = 25
    min_words: int = 20
    seed: int = 7
    run_rows: int = 1 << 20
    block_rows: int = 2048
    range_rows: int = 1 << 20

    def __post_init__(self):
        if not 0 <= self.percent <= 100 or min(self.buckets, self.run_rows, self.block_rows, self.range_rows) < 1:
            raise ValueError("a share lies in 0 to 100 per cent, sizes are 1 or more")


class _Crc:
    """CRC-32 of many words at once, and of two words joined by a space from their own."""

    def __init__(self):
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = (step >> np.uint32(1)) ^ np.where(step & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
        self.step = step
        # A state run over n zero bytes is linear in its bits: one table for each n and byte of the state.
        shifts = np.empty((_SHORT + 1, 4, 256), np.uint32)
        shifts[0] = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
        for n in range(_SHORT):
            shifts[n + 1] = self.over(shifts[n], np.uint8(0))
        self.shifts = shifts.reshape(-1)

    def over(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return self.step[(state ^ byte) & np.uint32(255)] ^ (state >> np.uint32(8))

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state after each word; its complement is the checksum."""
        size = ends - starts
        order = np.argsort(-np.minimum(size, _SHORT + 1), kind="stable")
        at, have = starts[order], -np.minimum(size, _SHORT + 1)[order]
        long = int(np.searchsorted(have, -_SHORT))
        state = np.full(len(order), _ONES)
        for i in range(long):
            state[i] = zlib.crc32(data[at[i] : ends[order[i]]]) ^ 0xFFFFFFFF
        for j in range(_SHORT):
            more = int(np.searchsorted(have, -j))
            if more <= long:
                break
            state[long:more] = self.over(state[long:more], data[at[long:more] + j])
        out = np.empty_like(state)
        out[order] = state
        return out

    def pairs(self, state: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The state after each word, a space and the next word."""
        lead, size = self.over(state[:-1], np.uint8(32)) ^ _ONES, (ends - starts)[1:]
        base = np.minimum(size, _SHORT) * 1024
        out = state[1:].copy()
        for k in range(4):
            out ^= self.shifts[base + 256 * k + ((lead >> np.uint32(8 * k)) & np.uint32(255))]
        for i in np.flatnonzero(size > _SHORT):
            out[i] = zlib.crc32(data[starts[i + 1] : ends[i + 1]], int(lead[i])) ^ 0xFFFFFFFF
        return out


def _buckets(part: X.Slice, crc: _Crc, many: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of words and of pairs, which pairs lie in one document, and the first word of each document."""
    data = part.lowered()
    starts, ends, first = part.words(X.ALNUM)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), first
    state = crc.words(data, starts, ends)
    inside = np.ones(len(starts) - 1, bool)
    edge = first[1:-1]
    inside[edge[(edge > 0) & (edge < len(starts))] - 1] = False
    both = crc.pairs(state, data, starts, ends) if len(starts) > 1 else np.zeros(0, np.uint32)
    return ((state ^ _ONES) % np.uint32(many)).astype(np.int64), ((both ^ _ONES) % np.uint32(many)).astype(np.int64), inside, first


def _count(many: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        crc, counts = _Crc(), np.zeros(many, np.int64)
        for batch in batches:
            for part in X.slices(batch.column(0)):
                words, pairs, inside, _ = _buckets(part, crc, many)
                counts += np.bincount(words, minlength=many) + np.bincount(pairs[inside], minlength=many)
        found = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[found])], names=["bucket", "n"])

    return run


def feature_counts(docs: DataFrame, *, text_col: str = "text", how: Draw = Draw()) -> DataFrame:
    """bucket and n, the features of all texts in it. Null texts have none; an empty table gives no rows. Each task sends
    its sums, a row for each bucket at most."""
    counts = docs.select(F.col(text_col).cast("string")).mapInArrow(_count(how.buckets), "bucket long, n long")
    return counts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: dict[int, int], target: dict[int, int], buckets: int) -> list[int]:
    """Thousandths of the log ratio of a bucket's smoothed share in the target and in the corpus."""
    s_all, t_all = float(sum(corpus.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1.0) * s_all / ((corpus.get(b, 0) + 1.0) * t_all))) for b in range(buckets)]


def _weigh(gains: np.ndarray, many: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        crc = _Crc()
        for batch in batches:
            rows = []
            for part in X.slices(batch.column(1)):
                words, pairs, inside, first = _buckets(part, crc, many)
                n = np.diff(first)
                total = X.tally(gains[words], first) + X.tally(np.r_[np.where(inside, gains[pairs], 0), 0][: len(words)], first)
                features = np.maximum(2 * n - 1, 0)
                rows.append((n, features, np.where(n > 0, total // np.maximum(features, 1), 0)))
            made = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in zip(*rows, strict=True)] if rows else [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["id", "n_words", "n_features", "weight"])

    return run


def noise(id_col: str | Column, seed: int) -> Column:
    """Thousandths of a Gumbel variable, fixed by seed and id; null counts as an empty id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(id_col) if isinstance(id_col, str) else id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0)))).cast("long")


def scored(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", how: Draw = Draw()) -> DataFrame:
    """id, n_words, n_features, weight and score of each row of docs. Two passes over the texts; what the driver gets is a
    row for each bucket."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    both = feature_counts(read, how=how).withColumn("of", F.lit("corpus")).unionByName(feature_counts(target, text_col=target_text_col, how=how).withColumn("of", F.lit("target")))
    counts: dict[str, dict[int, int]] = {"corpus": {}, "target": {}}
    for r in both.collect():
        counts[r["of"]][r["bucket"]] = r["n"]
    gains = np.array(bucket_gains(counts["corpus"], counts["target"], how.buckets), np.int64)
    schema = T.StructType([read.schema["id"], *(T.StructField(n, T.LongType()) for n in ("n_words", "n_features", "weight"))])
    return read.mapInArrow(_weigh(gains, how.buckets), schema).withColumn("score", F.col("weight") + noise("id", how.seed))


_END = (math.inf,)


class Tournament:
    """A winner tree over the heads of open blocks; places are added and reused as blocks come and end."""

    def __init__(self):
        self.heads: list[tuple] = [_END]
        self.won, self.free = [0, 0], [0]

    def _play(self, node: int) -> None:
        heads, won = self.heads, self.won
        while node:
            a, b = won[2 * node], won[2 * node + 1]
            won[node] = a if heads[a] <= heads[b] else b
            node >>= 1

    def enter(self, head: tuple) -> int:
        if not self.free:
            n = len(self.heads)
            self.heads += [_END] * n
            self.won = [0] * (2 * n) + list(range(2 * n))
            for node in range(2 * n - 1, 0, -1):
                a, b = self.won[2 * node], self.won[2 * node + 1]
                self.won[node] = a if self.heads[a] <= self.heads[b] else b
            self.free = list(range(2 * n - 1, n - 1, -1))
        place = self.free.pop()
        self.replace(place, head)
        return place

    def replace(self, place: int, head: tuple) -> None:
        self.heads[place] = head
        self._play((len(self.heads) + place) >> 1)

    def leave(self, place: int) -> None:
        self.replace(place, _END)
        self.free.append(place)

    @property
    def winner(self) -> int:
        return self.won[1] if len(self.heads) > 1 else 0


_VALUES = ("score", "id", "n_words", "n_features", "weight")


def _runs(lows: np.ndarray, how: Draw) -> Callable[[Batches], Batches]:
    """Sorted runs of a task's rows as blocks: the range that a block is in, its first score and id, and its rows."""
    order = [("score", "descending"), ("id", "ascending"), ("n_features", "ascending"), ("n_words", "ascending")]

    def blocks(held: list[pa.RecordBatch]) -> Batches:
        rows = pa.Table.from_batches(held)
        rows = rows.take(pc.sort_indices(rows, sort_keys=order, null_placement="at_end")).combine_chunks()
        ranges = np.searchsorted(-lows, -rows["score"].to_numpy())
        cuts = np.unique(np.concatenate([np.arange(0, len(ranges), how.block_rows), np.flatnonzero(np.diff(ranges)) + 1]))
        ends = np.r_[cuts, len(ranges)].astype(np.int32)
        columns = {c: rows[c].combine_chunks() for c in _VALUES}
        lists = [pa.ListArray.from_arrays(pa.array(ends), columns[c]) for c in _VALUES]
        heads = [columns[c].take(pa.array(cuts)) for c in ("score", "id")]
        yield pa.RecordBatch.from_arrays([pa.array(ranges[cuts].astype(np.int32)), *heads, *lists], names=["range_no", "head_score", "head_id", *_VALUES])

    def run(batches: Batches) -> Batches:
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch.select(list(_VALUES)))
                n += batch.num_rows
            if n >= how.run_rows:
                yield from blocks(held)
                held, n = [], 0
        if held:
            yield from blocks(held)

    return run


def _merge(before: list[int], draws: int, schema: pa.Schema) -> Callable[[Batches], Batches]:
    """Rows of sorted blocks in one order, ranked from what the ranges before hold; no rank beyond the draws.

    Blocks come by range and by their first row. A block is opened when its first row would win, so that one block of each
    run is open at a time.
    """

    def keys(block: dict) -> list[tuple]:
        return [(-s, i is None, i if i is not None else 0, f, n) for s, i, f, n in zip(block["score"], block["id"], block["n_features"], block["n_words"], strict=True)]

    def opened(batches: Batches) -> Iterator[dict]:
        for batch in batches:
            for k in range(batch.num_rows):
                yield batch.slice(k, 1).to_pylist()[0]

    def ranked(batches: Batches) -> Iterator[tuple]:
        stream = opened(batches)
        block = next(stream, None)
        while block is not None:
            number, tree, held = block["range_no"], Tournament(), {}
            rank, own = before[number], keys(block)
            while rank < draws:
                while block is not None and block["range_no"] == number and own[0] <= tree.heads[tree.winner]:
                    held[tree.enter(own[0])] = [block, own, 0]
                    block = next(stream, None)
                    own = keys(block) if block is not None else None
                if not held:
                    break
                place = tree.winner
                rows, order, at = held[place]
                rank += 1
                yield (*(rows[c][at] for c in _VALUES), rank)
                if at + 1 < len(order):
                    held[place][2] = at + 1
                    tree.replace(place, order[at + 1])
                else:
                    del held[place]
                    tree.leave(place)
            for rows, order, at in held.values():  # all draws are made
                for k in range(at, len(order)):
                    yield (*(rows[c][k] for c in _VALUES), None)
            while block is not None and block["range_no"] == number:
                for k in range(len(block["score"])):
                    yield (*(block[c][k] for c in _VALUES), None)
                block = next(stream, None)

    def run(batches: Batches) -> Batches:
        rows: list[tuple] = []
        for row in ranked(batches):
            rows.append(row)
            if len(rows) == 8192:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def resample(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", how: Draw = Draw()) -> DataFrame:
    """A row for each row of docs: id_col, n_words, n_features, weight, score and rank (1, 2, ... ; null if not drawn).

    Of the rows with at least how.min_words words, how.percent per cent (rounded down) with the highest scores are drawn,
    of equal scores those with smaller ids, then fewer features and words. Null and empty texts have no features, weight 0
    and are not eligible. Rows without id share one noise and come last among equals. Repeated rows are rows of their own,
    with ranks of their own. Empty docs give no rows, an empty target gives weights all the same. Other columns of docs
    are not read.

    The driver gets counts by bucket and by score: scores lie within 115,000 whole numbers, since gains are below
    1000 ln(2^63) and the noise between -3,100 and 22,900.
    """
    spark = docs.sparkSession
    found = materialise(scored(docs, target, id_col=id_col, text_col=text_col, target_text_col=target_text_col, how=how), "resample-scores")
    names = [F.col("id").alias(id_col), "n_words", "n_features", "weight", "score"]
    unranked = lambda df: df.select(*names, F.lit(None).cast("long").alias("rank"))
    eligible = F.col("n_words") >= how.min_words
    by_score = sorted(((r["score"], r["n"]) for r in found.filter(eligible).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)
    draws = sum(n for _, n in by_score) * how.percent // 100
    if not draws:
        return unranked(found)
    upto = np.cumsum([n for _, n in by_score])
    last = int(np.searchsorted(upto, draws))
    cut, taken = by_score[last][0], int(upto[last])
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-taken // how.range_rows))
    # Whole scores, so many that each range has its share of the rows.
    share = np.minimum((upto[: last + 1] - 1) * tasks // taken, tasks - 1)
    closes = np.flatnonzero(np.r_[share[1:] != share[:-1], True])
    lows = np.array([by_score[i][0] for i in closes], np.int64)
    before = [0, *(int(upto[i]) for i in closes[:-1])]
    rows = found.filter(eligible & (F.col("score") >= cut)).select(*_VALUES)
    kind = found.schema["id"].dataType
    block = T.StructType([T.StructField("range_no", T.IntegerType()), T.StructField("head_score", T.LongType()), T.StructField("head_id", kind), *(T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in _VALUES)])
    made = T.StructType([*(rows.schema[c] for c in _VALUES), T.StructField("rank", T.LongType())])
    blocks = rows.mapInArrow(_runs(lows, how), block)
    dealt = blocks.repartitionById(len(lows), F.col("range_no")).sortWithinPartitions("range_no", F.col("head_score").desc(), F.col("head_id").asc_nulls_last())
    drawn = dealt.mapInArrow(_merge(before, draws, to_arrow_schema(made)), made).select(*names, "rank")
    return drawn.unionByName(unranked(found.filter(~eligible | (F.col("score") < cut))))


def drawn_rows(docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text", how: Draw = Draw()) -> DataFrame:
    """The rows of docs that are drawn, with all their columns and rank, for ids that are unique.

    Of rows that share an id all are returned with the smallest of their ranks; rows without id are not. A column of docs
    named rank is replaced. An empty table gives an empty one.
    """
    ranks = resample(docs, target, id_col=id_col, text_col=text_col, target_text_col=target_text_col, how=how).filter("rank IS NOT NULL")
    one = materialise(ranks.groupBy(id_col).agg(F.min("rank").alias("rank"), F.count("*").alias("resample_rows")), "resample-ranks")
    return hot_join(docs.drop("rank"), one, [id_col], "resample_rows").filter("rank IS NOT NULL")
