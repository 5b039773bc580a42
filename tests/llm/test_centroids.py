"""Centroids by partial distances against whole ones in plain Python."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

from panelwright.llm import centroids


def brute(rows, k=8, dims=64, rounds=10):
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    digest = lambda i: hashlib.sha256(f"3:{'' if i is None else i}".encode()).hexdigest()
    middles = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[0] is None, r[0] or 0, r[1]))[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(middles)) for _, v in kept]
    for _ in range(rounds):
        which = assign()
        for j in range(len(middles)):
            own = [v for (_, v), (_, c) in zip(kept, which, strict=True) if c == j]
            if own:
                middles[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    which = assign()
    inertia = [sum(d for d, c in which if c == j) for j in range(len(middles))]
    return sorted(((i, c, d, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, middles[c])).encode()).hexdigest()) for (i, _), (d, c) in zip(kept, which, strict=True)), key=str)


def frame(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x") for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster string").repartition(3)


def test_clusters(spark):
    rng = random.Random(3)
    middles = [[rng.gauss(0, 2) for _ in range(64)] for _ in range(5)]
    rows = [(k, [float(np.float32(x + rng.gauss(0, 0.5) * (1 + d % 3))) for d, x in enumerate(rng.choice(middles))]) for k in range(120)]
    rows += [rows[5]] * 4 + [(900 + k, [0.25] * 64) for k in range(9)] + [(None, rows[7][1]), (None, rows[8][1])]
    rows += [(1000, None), (1001, []), (1002, [1.0] * 63), (1003, [1.0] * 63 + [None]), (1004, [float("nan")] + [1.0] * 63), (1005, [float("-inf")] * 64), (1006, [1.0] * 65)]
    assert sorted(map(tuple, centroids.clusters(frame(spark, rows)).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    rows = [(k, [float(k)] * 64) for k in range(n)] + [(77, None)]
    assert sorted(map(tuple, centroids.clusters(frame(spark, rows)).collect()), key=str) == brute(rows)


def test_large_components(spark):
    rows = [(k, [131072.0 * (-1) ** (k + d) for d in range(64)]) for k in range(12)]
    assert sorted(map(tuple, centroids.clusters(frame(spark, rows, "double"), how=centroids.Clustering(rounds=2)).collect()), key=str) == brute(rows, rounds=2)
    with pytest.raises(Exception, match="too large"):
        centroids.clusters(frame(spark, [(1, [131073.0] * 64)], "double")).collect()


def test_partial_distances():
    rng = np.random.default_rng(1)
    v, c = rng.integers(-3, 4, (500, 16)), rng.integers(-3, 4, (9, 16))
    c[4] = c[2]
    far = ((v[:, None] - c) ** 2).sum(axis=2)
    for block in (1, 3, 8, 16):
        which, best = centroids.nearest(v, c, block)
        assert (which == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()
