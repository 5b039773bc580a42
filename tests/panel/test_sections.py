"""Places from ranges and their directory against those from windows."""

from __future__ import annotations

import random

import pytest

from panelwright.functions import xsec


@pytest.fixture(scope="module", params=[1, 6, 40])
def sections(spark, request):
    """Sections of one size after another; values: how many different ones there are (1: all equal)."""
    rng = random.Random(request.param)
    rows = []
    for date, n in ((1, 300), (2, 1), (3, 40), (None, 60), (4, 7)):
        for k in range(n):
            rows.append((f"T{k:04d}", date, None if rng.random() < 0.1 else float(rng.randrange(request.param)), rng.choice("ab")))
    rows += [("N", 5, None, "a"), ("O", 1, 0.0, None)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "ticker string, date int, x double, model string").repartition(5).cache()


def found(df, column):
    return sorted(((r["ticker"], r["date"], r["model"], r[column]) for r in df.collect()), key=str)


@pytest.mark.parametrize("parts", [1, 3, 23])
def test_places(sections, parts):
    by, known = ["date"], sections.filter("x IS NOT NULL")
    one, other = xsec.with_places(sections, "x", by, ["ticker"]).filter("x IS NOT NULL"), xsec.with_ranged_places(sections, "x", by, ["ticker"], parts)
    rows = lambda df: sorted(((r["ticker"], r["date"], *(r[c] for c in xsec.PLACES)) for r in df.filter("x IS NOT NULL").collect()), key=str)
    assert rows(other) == rows(one) and other.count() == sections.count() and len(rows(one)) == known.count()


@pytest.mark.parametrize("method", xsec.RANK_METHODS)
def test_ranks(sections, method):
    one, other = (xsec.with_percentile_rank(sections, "x", "r", method=method, by=["date", "model"], ranged=r) for r in (False, True))
    assert found(one, "r") == found(other, "r") and one.columns == other.columns


@pytest.mark.parametrize("buckets", [3, 10, 35])
def test_buckets(sections, buckets):
    one, other = (xsec.with_buckets(sections, "x", buckets=buckets, ranged=r) for r in (False, True))
    assert found(one, "decile") == found(other, "decile")


def test_one_date_holds_all_rows(spark):
    rows = spark.range(20_000).selectExpr("CAST(id AS STRING) AS ticker", "1 AS date", "CAST(CASE WHEN id % 3 = 0 THEN 7 ELSE pmod(xxhash64(id), 900) END AS DOUBLE) AS x", "'m' AS model")
    for method in xsec.RANK_METHODS:
        one, other = (xsec.with_percentile_rank(rows, "x", "r", method=method, ranged=r) for r in (False, True))
        assert found(one, "r") == found(other, "r")


def test_zscores_by_join(sections):
    one = sections.withColumn("x", xsec.zscore("x"))
    other = xsec.with_zscores(sections, ["x"])
    a, b = found(one, "x"), found(other, "x")
    assert [r[:3] for r in a] == [r[:3] for r in b] and [r[3] for r in a] == pytest.approx([r[3] for r in b]) and other.columns == sections.columns
