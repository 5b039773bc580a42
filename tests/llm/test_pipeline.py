"""The pipeline against a plain version of its stages."""

from __future__ import annotations

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelwright.llm import compression_rules, secret_scan
from panelwright.llm import textops as X

from .test_bands import many_labels
from .test_rows import brute_components, brute_fingerprint, water_fill
from .test_search import ALNUM, lowered
from .texts import SCHEMA, documents, prose

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def plain_pipeline(rows, items):
    """(doc_id, text) of what the first four stages keep."""
    rules = compression_rules.CompressionRules()
    packer = compression_rules.zstandard.ZstdCompressor(level=rules.level)
    kept = []
    for i, t in rows:
        words = SPACED.findall(t or "")
        grams = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        often = collections.Counter(grams)
        hit = {k + j for k, g in enumerate(grams) if often[g] > 1 for j in range(3)}
        if len(words) >= 50 and 100 * len(hit) <= 50 * len(words) and compression_rules.band_verdict(memoryview(t.encode()), rules, packer)[2]:
            kept.append((i, t))
    component = brute_components([(i, brute_fingerprint(t)) for i, t in kept])
    kept = list(dict((i, t) for (i, t), c in zip(kept, component, strict=True) if i is not None and i == c).items())
    windows = set()
    for t in items:
        w = ALNUM.findall(lowered(t))
        windows |= {tuple(w[s : s + 13]) for s in range(max(1, len(w) - 12) if w else 0)}
    clean = []
    for i, t in kept:
        w = ALNUM.findall(lowered(t))
        hit = {k for n in {len(x) for x in windows} for s in range(len(w) - n + 1) if tuple(w[s : s + n]) in windows for k in range(s, s + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean.append((i, t))
    often = collections.Counter(w for _, t in clean for w in set(re.findall(r"(?<![a-z0-9_])[a-z]{4,20}(?![a-z0-9_])", t.lower())))
    model = secret_scan.train(words=sorted((w for w, n in often.items() if n >= 3), key=lambda w: (-often[w], w))[:20_000])
    out = []
    for i, t in clean:
        raw = t.encode()
        for s in reversed(secret_scan.judged(next(X.slices(pa.array([t]))), model)[1][0]):
            raw = raw[: s["start"]] + secret_scan.MASK + raw[s["end"] :]
        out.append((i, raw.decode()))
    return out


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    items = [prose(rng, 30) for _ in range(4)]
    rows = [r for r in documents() if r[0] is not None]
    for k in range(6):
        rows.append((6000 + k, prose(rng, 90) + items[k % 4] + prose(rng, 60), "en", "a", 5, None, None, None, None))
        rows.append((7000 + k, prose(rng, 90) + f' token = "{rng.getrandbits(160):040x}" ' + prose(rng, 60), "en", "b", 5, None, None, None, None))
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, left, str(tmp_path))
        assert left.columns == docs.columns
    want = plain_pipeline([r[:2] for r in rows], items)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted(want)

    mix = corpus_pipeline.run(spark, str(tmp_path)).collect()
    size = {i: len(SPACED.findall(t)) for i, t in want}
    assert {r.doc_id: r.size for r in mix} == size and len(mix) == len(want)
    source, per, taken = {r[0]: r[3] for r in rows}, collections.Counter(), collections.Counter()
    for i, n in size.items():
        per[source[i]] += n
    names = sorted((s for s in per if s is not None), key=str.encode) + [None] * (None in per)
    targets = dict(zip(names, water_fill([per[s] for s in names]), strict=True))
    for r in mix:
        taken[r.source] += r.taken
        assert r.target == pytest.approx(targets[r.source]) and r.taken <= 2 * r.size
    assert all(abs(taken[s] - targets[s]) <= 0.5 for s in names)
    assert np.isfinite([p for r in mix for p in r.positions]).all()


def test_pipeline_of_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_stage_fits_every_label(spark, tmp_path):
    last = many_labels(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, docs, str(tmp_path)).select("doc_id").collect()}
    assert last <= kept and len(kept) == 20_040


def test_pipeline_keeps_documents_that_the_last_labels_speak_for(spark, tmp_path):
    last = many_labels(spark, f"{tmp_path}/made")
    docs = spark.read.parquet(f"{tmp_path}/made/documents.parquet")
    docs.selectExpr("doc_id", "text", "'en' lang", "'a' source", "cast(length(text) as int) n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{tmp_path}/made/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "no phrase of these texts")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    mix = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").collect()]
    assert last <= set(mix) and len(mix) == len(set(mix))
