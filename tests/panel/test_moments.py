"""Least squares from merged moments against least squares on rows, near and far from zero."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from panelwright.operators import exposures, linear
from panelwright.operators import moments as M

from .frames import month, random_panel, rows, series


def straight(x, y):
    return np.linalg.lstsq(np.column_stack([np.ones(len(x)), x]), y, rcond=None)[0]


@pytest.mark.parametrize("length", [1, 5, 8, 12, None])
def test_windows_are_merges_of_blocks(length):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(70, 3)) * [1, 10, 0.1] + [0, 1e5, -4]
    complete, start = rng.random(70) > 0.2, np.repeat([0, 13, 14, 50], [13, 1, 36, 20])
    got = M.window_moments(M.Moments.of_rows(x, complete), start, length)
    for r in range(70):
        window = [k for k in range(max(start[r], 0 if length is None else r - length + 1), r + 1) if complete[k]]
        assert got.n[r] == len(window)
        if window:
            part = x[window]
            assert got.mean[r] == pytest.approx(part.mean(axis=0)) and got.co[r] == pytest.approx((part - part.mean(axis=0)).T @ (part - part.mean(axis=0)), abs=1e-7)


def test_coefficients():
    rng = np.random.default_rng(2)
    designs = [rng.normal(size=(30, 3)), rng.normal(size=(30, 3)) * [1e-6, 1, 1e6] + [1, 1e6, 0], np.repeat(rng.normal(size=(30, 1)), 3, axis=1), np.ones((30, 3)) * [2, 0, 5], np.column_stack([rng.normal(size=(30, 2)), np.full(30, 3.0)]), rng.normal(size=(2, 3))]
    for x in designs:
        y = rng.normal(size=len(x)) + x @ [1, -2, 0.5]
        each = M.Moments.of_rows(np.column_stack([x, y]), np.ones(len(x), bool))
        whole = M.window_moments(each, np.zeros(len(x), np.int64), None).take(np.array([len(x) - 1]))
        want = straight(x, y)
        if x.std(axis=0).min() < 1e-5 and x.std(axis=0).min() > 0:  # too ill-conditioned for the rows as they are
            size, middle = x.std(axis=0), x.mean(axis=0)
            slopes = straight((x - middle) / size, y)[1:] / size
            want = np.r_[y.mean() - middle @ slopes, slopes]
        assert M.coefficients(whole)[0] == pytest.approx(want, rel=1e-6, abs=1e-6 * max(1, np.abs(want).max())), x[:2]


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_chunks_of_rows_do_not_matter(chunk):
    rng = np.random.default_rng(3)
    tickers = np.repeat(["a", "b", "c", None, "d"], [40, 3, 25, 30, 1]).tolist()
    x = rng.normal(size=(99, 2))
    columns = {"ticker": pa.array(tickers, pa.string()), "date": pa.array(range(99)), "x": pa.array([None if v < -1 else v for v in x[:, 0]]), "y": pa.array(x[:, 1])}
    table = pa.table(columns)
    out = lambda batches, size: pa.Table.from_batches(list(M.trailing_fits(batches, ["x", "y"], 9, 4, ["p", "q"], size))).to_pylist()
    want = out(table.to_batches(), 1 << 16)
    assert len(want) > 60 and out(table.to_batches(max_chunksize=5), chunk) == [pytest.approx(w) for w in want]


def test_factors_far_from_zero(spark):
    """At a level of a million with a dispersion of one, sums of raw products have no digits left."""
    rng = np.random.default_rng(4)
    f = 1e6 + rng.normal(size=(40, 3))
    loads = {"A": [2.0, -1.0, 0.0], "B": [0.5, 0.0, 3.0]}
    factors = spark.createDataFrame([(month(i), *map(float, f[i]), 0.0) for i in range(40)], "date date, MKT double, SMB double, HML double, RF double")
    returns = spark.createDataFrame([(t, month(i), float((f[i] - 1e6) @ b + 0.01 * rng.normal())) for t, b in loads.items() for i in range(40)], "ticker string, date date, RET double")
    cfg = exposures.ExposureConfig(12, 20)
    fast, exact = (exposures.compute_factor_exposures(returns, factors, config=cfg, mode=m) for m in ("fast", "exact"))
    for c in ("beta_MKT", "beta_SMB", "beta_HML"):
        assert series(fast, c) == pytest.approx(series(exact, c), rel=1e-6, abs=1e-6)
    assert series(fast, "alpha_ff3") == pytest.approx(series(exact, "alpha_ff3"), rel=1e-4)
    assert fast.count() == 2 * 28
    assert all(abs(v - loads[k[0]][0]) < 0.05 for k, v in series(fast, "beta_MKT").items())


def test_rolling_and_cross_sections_far_from_zero(spark):
    panel = random_panel(spark, seed=7, tickers=15, months=12)
    far = panel.withColumns({"x0": F.col("x0") + 1e6, "x1": F.col("x1") * 1e-3 - 1e3})
    windows = linear.WindowConfig(4, 6)
    one, other = (series(linear.rolling_ols(p, ["x0", "x1", "x2"], window_config=windows), "prediction") for p in (panel, far))
    assert len(one) > 80 and other == pytest.approx(one, abs=1e-6)
    one, other = (series(linear.cross_sectional_ols(p, ["x0", "x1"]), "prediction") for p in (panel, far))
    assert len(one) > 100 and other == pytest.approx(one, abs=1e-6)


def test_nothing_to_fit(spark):
    none = rows(spark, {"x": [None] * 4, "next_return": [1, 2, 3, 4]}, tickers=["A"], months=4)
    assert linear.rolling_ols(none, ["x"], window_config=linear.WindowConfig(1, 2)).count() == 0
    assert linear.rolling_ols(none.limit(0), ["x"], window_config=linear.WindowConfig(1, 2)).count() == 0
    assert linear.cross_sectional_ols(none, ["x"]).count() == 0
