"""Centroid clustering of whole-number vectors by partial-distance search.

Lloyd's rounds over a written table of integer vectors: tasks assign their vectors and send sums by cluster, the driver
holds the centroids, k times dims numbers. A vector's squared distance to a centroid is summed over the dimensions of high
variance first; a centroid is abandoned for it as soon as its sum is strictly above the best distance so far.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialise

Batches = Iterator[pa.RecordBatch]

#: Largest size of a scaled component: squared distances over 64 dimensions stay within 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Clustering:
    """block: dimensions that are added before centroids are given up."""

    k: int = 8
    dims: int = 64
    rounds: int = 10
    scale: int = 1024
    seed: int = 3
    block: int = 8

    def __post_init__(self):
        if min(self.k, self.dims, self.block) < 1 or self.rounds < 0 or self.dims > 64:
            raise ValueError("k, dims (64 at most) and block are 1 or more")


def whole_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", how: Clustering = Clustering()) -> DataFrame:
    """id and v: floor(scale * x) of each component, of the rows whose vector has how.dims components, all finite.

    A component beyond 131,072 (at scale 1024) is an error: distances would not fit into 64 bits.
    """
    x = F.col(vector_col).cast("array<double>")
    usable = (F.size(x) == how.dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    floor = F.transform(x, lambda c: F.floor(F.lit(float(how.scale)) * c))
    small = F.forall(floor, lambda c: F.abs(c) <= LARGEST)
    kept = vectors.filter(F.coalesce(usable, F.lit(False)))
    return kept.select(F.col(id_col).alias("id"), F.when(small, floor.cast("array<int>")).otherwise(F.raise_error(F.lit("a vector's component is too large for distances of 64 bits")).cast("array<int>")).alias("v"))


def _matrix(column: pa.Array, order: np.ndarray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(-1, len(order))[:, order].astype(np.int64)


def nearest(v: np.ndarray, centroids: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of and squared distance to the nearest centroid of each row, smaller numbers first.

    The centroid that leads after the first block sets a row's best distance; each other one is followed, block by block,
    for the rows where it isn't above the best yet.
    """
    n, dims = v.shape
    step = v[:, None, :block] - centroids[None, :, :block]
    lead = np.einsum("nkd,nkd->nk", step, step)
    which = lead.argmin(axis=1)
    step = v - centroids[which]
    best = np.einsum("nd,nd->n", step, step)
    first = which.copy()
    for c in range(len(centroids)):
        rows = np.flatnonzero((first != c) & (lead[:, c] <= best))
        part = lead[rows, c]
        for at in range(block, dims, block):
            if not len(rows):
                break
            step = v[rows, at : at + block] - centroids[c, at : at + block]
            part = part + np.einsum("nd,nd->n", step, step)
            on = part <= best[rows]
            rows, part = rows[on], part[on]
        better = (part < best[rows]) | (c < which[rows])  # part is at most best
        best[rows[better]], which[rows[better]] = part[better], c
    return which, best


def _exact_sum(x: np.ndarray) -> int:
    """The sum of non-negative 64-bit numbers, of any size."""
    return (int((x >> 32).sum()) << 32) + int((x & 0xFFFFFFFF).sum())


def _spread(dims: int) -> Callable[[Batches], Batches]:
    def run(batches: Batches) -> Batches:
        n, sums, squares = 0, np.zeros(dims), np.zeros(dims)
        for batch in batches:
            v = _matrix(batch.column(0), np.arange(dims)).astype(float)
            n, sums, squares = n + len(v), sums + v.sum(axis=0), squares + (v * v).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, n)), pa.array(sums), pa.array(squares)], names=["dim", "n", "sums", "squares"])

    return run


def _round(centroids: list[list[int]], order: list[int], block: int) -> Callable[[Batches], Batches]:
    """A task's rows, sums of components and of distances (dim -1) by cluster."""

    def run(batches: Batches) -> Batches:
        at = np.array(order)
        c = np.array(centroids, np.int64)[:, at]
        sums, rows, far = np.zeros(c.shape, np.int64), np.zeros(len(c), np.int64), [0] * len(c)
        for batch in batches:
            v = _matrix(batch.column(0), at)
            which, best = nearest(v, c, block)
            for k in range(len(c)):
                own = which == k
                sums[k] += v[own].sum(axis=0)
                rows[k] += own.sum()
                far[k] += _exact_sum(best[own])
        out = [(k, int(d), int(rows[k]), str(s)) for k in np.flatnonzero(rows).tolist() for d, s in [*zip(order, sums[k].tolist(), strict=True), (-1, far[k])]]
        cluster, dim, n, total = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(dim, pa.int32()), pa.array(n, pa.int64()), pa.array(total, pa.string())], names=["cluster", "dim", "n", "total"])

    return run


def _sums(vectors: DataFrame, centroids: list[list[int]], order: list[int], how: Clustering) -> dict[tuple[int, int], tuple[int, int]]:
    """(cluster, dim) -> rows and exact sum: k * (dims + 1) entries at most."""
    each = vectors.select("v").mapInArrow(_round(centroids, order, how.block), "cluster int, dim int, n long, total string")
    found = each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()
    return {(r["cluster"], r["dim"]): (r["n"], int(r["total"])) for r in found}


@dataclass(frozen=True)
class Fitted:
    """vectors: the written whole-number vectors. order: dimensions by falling variance."""

    vectors: DataFrame
    centroids: list[list[int]]
    order: list[int]
    inertia: list[int]


def fit(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", how: Clustering = Clustering()) -> Fitted:
    """Centroids after how.rounds rounds, from the how.k vectors (all, if there are fewer) with the smallest SHA-256 of
    seed and id; of equal ids those with smaller components. Each is replaced by the floor of its vectors' mean."""
    kept = materialise(whole_vectors(vectors, id_col=id_col, vector_col=vector_col, how=how), "cluster-vectors")
    digest = F.sha2(F.concat(F.lit(f"{how.seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary"), 256)
    centroids = [list(r["v"]) for r in kept.orderBy(digest, F.col("id").asc_nulls_last(), "v").limit(how.k).collect()]
    if not centroids:
        return Fitted(kept, [], list(range(how.dims)), [])
    stats = kept.select("v").mapInArrow(_spread(how.dims), "dim int, n long, sums double, squares double").groupBy("dim").agg(*(F.sum(c).alias(c) for c in ("n", "sums", "squares"))).collect()
    spread = {r["dim"]: r["squares"] / r["n"] - (r["sums"] / r["n"]) ** 2 for r in stats}
    order = sorted(range(how.dims), key=lambda d: (-spread[d], d))
    for _ in range(how.rounds):
        sums = _sums(kept, centroids, order, how)
        centroids = [[sums[k, d][1] // sums[k, d][0] if (k, d) in sums else x for d, x in enumerate(c)] for k, c in enumerate(centroids)]
    sums = _sums(kept, centroids, order, how)
    return Fitted(kept, centroids, order, [sums.get((k, -1), (0, 0))[1] for k in range(len(centroids))])


def centroid_digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


_MOST = (1 << 63) - 1


def clusters(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", how: Clustering = Clustering()) -> DataFrame:
    """A row for each usable vector: id_col, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors that are null, of another length, or with a null, NaN or infinite component are left out. Equally near
    centroids: the smaller number. Repeated rows each count and each get a row; rows without id count as an empty id when
    the first centroids are chosen. A cluster that loses all its vectors keeps its centroid. No usable vectors, no rows.
    Sums of distances beyond 64 bits are given as the largest long. Other columns are not read.
    """
    done = fit(vectors, id_col=id_col, vector_col=vector_col, how=how)
    schema = T.StructType([done.vectors.schema["id"], T.StructField("cluster", T.IntegerType()), *(T.StructField(n, T.LongType()) for n in ("distance", "cluster_inertia", "inertia")), T.StructField("centroid_sha256", T.StringType())])
    centroids, order, block = done.centroids, done.order, how.block
    inertia, whole, digests = [min(i, _MOST) for i in done.inertia], min(sum(done.inertia), _MOST), [centroid_digest(c) for c in done.centroids]

    def assign(batches: Batches) -> Batches:
        at = np.array(order)
        c = np.array(centroids, np.int64).reshape(-1, len(order))[:, at]
        for batch in batches:
            if not batch.num_rows:
                continue
            which, best = nearest(_matrix(batch.column(1), at), c, block)
            number = pa.array(which.astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), number, pa.array(best), pc.take(pa.array(inertia, pa.int64()), number), pa.array(np.full(len(best), whole)), pc.take(pa.array(digests, pa.string()), number)], names=[f.name for f in schema])

    return done.vectors.select("id", "v").mapInArrow(assign, schema).withColumnRenamed("id", id_col)
