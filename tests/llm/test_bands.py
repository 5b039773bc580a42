"""Compression bands on valid text: noise is rejected at every length, prose is kept."""

from __future__ import annotations

import base64
import random
import string

import pytest
import zstandard
from pyspark.sql import functions as F

from panelwright.llm import compression_rules, queries

RULES = compression_rules.CompressionRules()
PACKER = compression_rules.zstandard.ZstdCompressor(level=RULES.level)
SOUNDS = ["ba", "con", "de", "er", "for", "ing", "ka", "lo", "men", "ne", "or", "pre", "st", "tion", "un", "ver", "wa", "y"]


def noise(rng: random.Random, kind: str, n: int) -> str:
    if kind == "base64":
        return base64.encodebytes(rng.randbytes(n)).decode()[:n]
    return " ".join("".join(rng.choices(string.ascii_letters + string.digits, k=rng.randint(3, 10))) for _ in range(n // 4))[:n]


def prose(rng: random.Random, n: int) -> str:
    words = ["".join(rng.choices(SOUNDS, k=rng.randint(1, 3))) for _ in range(400)]
    return " ".join(words[min(int(rng.expovariate(0.015)), 399)] for _ in range(n))[:n]


def verdict(text: str):
    return compression_rules.band_verdict(memoryview(text.encode()), RULES, PACKER)


@pytest.mark.parametrize("n", [350, 500, 900, 1500, 3000, 5000, 9000, 60_000])
def test_text_noise_is_rejected_and_prose_kept(n):
    rng = random.Random(n)
    for kind in ("base64", "words"):
        assert verdict(noise(rng, kind, n))[1:] == (1.0, False), kind
    assert verdict(prose(rng, n))[1:] == (0.0, True)


@pytest.mark.parametrize("tail", [1024, 2000, 4096])
def test_last_and_inner_chunks_are_judged(tail):
    rng = random.Random(tail)
    assert verdict(prose(rng, 4096) + noise(rng, "base64", tail))[1] == 0.5
    assert verdict(noise(rng, "words", 4096) + prose(rng, 4096 * 2) + noise(rng, "base64", 4096 + tail))[1] == pytest.approx(3 / 5)


def test_a_short_remainder_belongs_to_the_chunk_before():
    rng = random.Random(2)
    assert verdict(prose(rng, 4096) + noise(rng, "base64", 4096) + noise(rng, "words", 500))[1] == 0.5
    assert verdict(prose(rng, 8192) + prose(rng, 4096)[:100])[1] == 0.0


def plain_verdict(text: str, limits, slack: float) -> bool:
    """The bands stated anew: limits are (largest size or None, low, high)."""
    raw = text.encode()
    if not raw:
        return True
    ratio = lambda b: len(zstandard.ZstdCompressor(level=3).compress(b)) / len(b)
    of = lambda b: next((low, high) for end, low, high in limits if end is None or len(b) <= end)
    chunks = [raw[i : i + 4096] for i in range(0, len(raw), 4096)]
    if len(chunks) > 1 and len(chunks[-1]) < 1024:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    outside = sum(not of(c)[0] * slack <= ratio(c) <= of(c)[1] for c in chunks)
    return of(raw)[0] <= ratio(raw) <= of(raw)[1] and 2 * outside <= len(chunks)


LIMITS = [(512, 0.25, 0.78), (1024, 0.20, 0.73), (2048, 0.20, 0.67), (4096, 0.18, 0.63), (8192, 0.18, 0.61), (None, 0.15, 0.60)]


def test_verdicts_are_those_of_a_plain_version(spark):
    rng = random.Random(11)
    texts = [noise(rng, kind, n) for kind in ("base64", "words") for n in (400, 5000, 20_000)] + [prose(rng, n) for n in (300, 700, 4096, 5119, 5120, 9000, 50_000)]
    texts += [prose(rng, a) + noise(rng, "words", b) for a, b in ((4096, 4096), (3000, 9000), (9000, 3000), (4096, 1023), (4096, 1024))]
    texts += ["again and " * n for n in (10, 60, 900)] + [prose(rng, 5000) + "dull line\n" * 2000, "", "x", prose(rng, 3000) + "ab " * 300]
    rows = compression_rules.quality_rules(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(rows) == len(texts) and 3 < sum(r.kept for r in rows) < len(texts) - 3
    for r in rows:
        assert r.kept == (not r.base_failed and plain_verdict(texts[r.doc_id], LIMITS, 0.85)), texts[r.doc_id][:60]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert compression_rules.quality_rules(empty).collect() == [] and compression_rules.kept_rows(empty).collect() == []


def test_low_limits_are_fitted_to_labels(spark):
    """Junk with symbols at its words compresses better than prose of its length, and is told by the fitted limits."""
    rng = random.Random(12)
    good = [prose(rng, rng.randint(1100, 6000)) for _ in range(400)]
    junk = [" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, rng.randint(900, 4000)).split()) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(good + junk)]
    docs = spark.createDataFrame([*rows, (None, "x"), (9000, None), (9001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 400)) for i in range(0, 480, 2)] + [(9000, 1), (9001, 1), (None, 1)], "doc_id long, quality int")
    rules = compression_rules.fitted_rules(docs, labels)
    kept = {r.doc_id for r in compression_rules.quality_rules(docs, rules=rules).filter("kept").collect()}
    assert len(kept & set(range(400))) >= 398 and {i for i in range(0, 400, 2)} <= kept
    assert len(kept & set(range(400, 480))) <= 40
    assert len({i for i in range(400, 480)} & {r.doc_id for r in compression_rules.quality_rules(docs).filter("kept").collect()}) >= 70
    assert compression_rules.fitted_rules(docs, labels.limit(0)).band(3000) == compression_rules.Band(3072, 0.18, 0.63)
    few = compression_rules.fitted_rules(docs, labels, least=10_000)
    assert [(few.band(n).low, few.band(n).high) for n in (1, 600, 5000, 10**7)] == [(RULES.band(n).low, RULES.band(n).high) for n in (1, 600, 5000, 10**7)]


def many_labels(spark, folder: str, n: int = 20_040) -> set[int]:
    """Writes n documents labelled good to the folder; returns the 40 ids of greatest digest, whose texts compress best."""
    rng = random.Random(13)
    plain = [prose(rng, rng.randint(1100, 1400)) for _ in range(50)]
    marked = [" ".join(w + rng.choice(["***", "$$$", "%%%"]) for w in prose(rng, 850).split()) for _ in range(40)]
    last = {r.id: t for r, t in zip(spark.range(n).orderBy(F.xxhash64("id").desc()).limit(40).collect(), marked, strict=True)}
    docs = [(i, last.get(i, plain[i % 50])) for i in range(n)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.range(n).selectExpr("id doc_id", "1 quality").write.parquet(f"{folder}/labels.parquet")
    return set(last)


def test_every_label_counts_for_the_limits(spark, tmp_path):
    last = many_labels(spark, str(tmp_path))
    rows = queries.op7_quality_rules(spark, str(tmp_path)).collect()
    assert len(rows) == 20_040 and len(last) == 40
    assert [r.doc_id for r in rows if r.doc_id in last and not r.kept] == [] and all(r.kept for r in rows)


def test_limits_are_the_smallest_ratios_by_length_of_a_plain_version(spark):
    """Repeated rows of a document count, repeated labels of it don't, and null ids have no label."""
    rng = random.Random(14)
    docs = [(i, prose(rng, rng.randint(300, 3000))) for i in range(150)] + [(None, "again " * 150)] * 30 + [(150, prose(rng, 4500))] * 25 + [(151 + i, prose(rng, 7000)) for i in range(15)]
    labels = [(i, 1) for i in range(0, 166) if i % 5] * 2 + [(150, 1), (None, 1)] + [(i, 0) for i in range(0, 150, 5)]
    rules = compression_rules.fitted_rules(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int"))
    good, seen = {i for i, q in labels if q and i is not None}, {}
    for i, t in docs:
        if i in good:
            end = next(b for b in compression_rules.FITTED_BYTES if len(t.encode()) <= b)
            seen.setdefault(end, []).append(len(zstandard.ZstdCompressor(level=3).compress(t.encode())) / len(t.encode()))
    assert len(seen[6144]) == 25 and len(seen[8192]) < 20 and sum(len(v) >= 20 for v in seen.values()) > 2
    for end in compression_rules.FITTED_BYTES:
        few, old = len(seen.get(end, [])) < 20, RULES.band(end).low
        assert rules.band(end).low == (old if few else pytest.approx(max(old, min(seen[end]) * 0.97)))
