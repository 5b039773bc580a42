"""Importance resampling against plain Python."""

from __future__ import annotations

import collections
import hashlib
import math
import random
import re
import zlib
from itertools import pairwise

import pytest

from panelwright.llm import resampling

from .texts import SCHEMA, documents, prose

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = ALNUM.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return len(words), [zlib.crc32(f.encode()) % 10_000 for f in [*words, *(f"{a} {b}" for a, b in pairwise(words))]]


def brute(docs, target, percent=25, least=20):
    """Sorted (id, n_features, weight, score, rank) of rows (id, text)."""
    corpus, wanted = (collections.Counter(b for _, t in rows for b in features(t)[1]) for rows in (docs, target))
    s_all, t_all = corpus.total(), wanted.total()
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + 10_000) / ((corpus[b] + 1) * (t_all + 10_000))))
    rows = []
    for i, text in docs:
        n, buckets = features(text)
        weight = sum(map(gain, buckets)) // len(buckets) if buckets else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(buckets), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    can = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[1]))
    draws = len(can) * percent // 100
    ranked = [(r[0], *r[2:], k + 1) for k, r in enumerate(can[:draws])] + [(r[0], *r[2:], None) for r in can[draws:]] + [(r[0], *r[2:], None) for r in rows if r[1] < least]
    return sorted(ranked, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = [(d[0], d[1]) for d in documents()]
    rows += [(5000 + k, prose(rng, rng.randint(15, 60))) for k in range(150)]
    rows += [(6000 + k, rows[-1][1]) for k in range(40)] + [(7000, "w" * 400 + " " + "x" * 49 + " tail " * 30), (7001, "é" * 24 + " ß" * 40), (None, rows[60][1])]
    rows += [rows[70]] * 3
    return rows


@pytest.mark.parametrize(("run_rows", "block_rows", "range_rows", "percent"), [(1 << 20, 2048, 1 << 20, 25), (7, 2, 5, 60), (3, 1, 1, 100), (50, 4, 9, 0)])
def test_scores_and_ranks(spark, corpus, run_rows, block_rows, range_rows, percent):
    rng = random.Random(12)
    target = [(k, prose(rng, 40)) for k in range(9)] + [(10, corpus[30][1]), (11, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in corpus], "doc_id long, text string, score string, rank int").repartition(6)
    how = resampling.Draw(percent=percent, run_rows=run_rows, block_rows=block_rows, range_rows=range_rows)
    assert got(resampling.resample(docs, spark.createDataFrame(target, "item long, text string"), how=how)) == brute(corpus, target, percent)


def test_no_documents_and_no_target(spark, corpus):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame(corpus, "doc_id long, text string")
    assert resampling.resample(none, some).count() == 0 and resampling.resample(none, none).count() == 0
    assert got(resampling.resample(some, none)) == brute(corpus, [])
    with pytest.raises(ValueError):
        resampling.Draw(percent=101)


def test_drawn_rows_keep_their_columns(spark):
    docs = spark.createDataFrame(documents(), SCHEMA)
    kept = resampling.drawn_rows(docs, docs.limit(5)).collect()
    ranks = {r.doc_id: r.rank for r in resampling.resample(docs, docs.limit(5)).filter("rank IS NOT NULL AND doc_id IS NOT NULL").orderBy("rank", ascending=False).collect()}
    assert {r.doc_id: r.rank for r in kept} == ranks
    assert {tuple(r)[:-1] for r in kept} <= set(documents())


def test_a_long_text_in_little_time(spark):
    text = "word " * 700_000 + "z" * 3_000_000
    docs = spark.createDataFrame([(1, text), (2, "a b c " * 9)], "doc_id long, text string")
    found = {r.doc_id: r.n_features for r in resampling.resample(docs, docs).collect()}
    assert found == {1: 2 * 700_001 - 1, 2: 53}


def test_tournament():
    rng = random.Random(5)
    runs = [sorted((rng.randint(0, 40),) for _ in range(rng.randint(1, 30))) for _ in range(23)]
    tree, at, out = resampling.Tournament(), {}, []
    for run in runs:
        at[tree.enter(run[0])] = [run, 0]
    while at:
        place = tree.winner
        run, k = at[place]
        out.append(run[k])
        if k + 1 < len(run):
            at[place][1] += 1
            tree.replace(place, run[k + 1])
        else:
            tree.leave(place)
            del at[place]
    assert out == sorted(x for r in runs for x in r)
