"""Bootstrap draws dealt to tasks, and tests of many models."""

from __future__ import annotations

import math

import numpy as np
import pytest

from panelwright.operators import inference

from .frames import month


def plain_bootstrap(a, b, draws, seed):
    def ratio(x):
        return x.mean() / x.std(ddof=1) * math.sqrt(12)

    rng = np.random.default_rng(seed)
    at = [rng.integers(0, len(a), size=len(a)) for _ in range(draws)]
    diffs = np.array([ratio(a[k]) - ratio(b[k]) for k in at])
    seen = ratio(a) - ratio(b)
    return ratio(a), ratio(b), seen, diffs.mean(), diffs.std(ddof=1), 2 * min((diffs >= seen).mean(), (diffs <= seen).mean()), len(a)


@pytest.mark.parametrize(("chunk", "draws"), [(1, 30), (7, 100), (64, 500), (1000, 500)])
def test_draws_are_the_same_in_any_number_of_tasks(spark, monkeypatch, chunk, draws):
    monkeypatch.setattr(inference, "DRAWS", chunk)
    rng = np.random.default_rng(1)
    a, b = rng.normal(0.01, 0.03, 37), rng.normal(0.005, 0.04, 37)
    returns = spark.createDataFrame([(month(i), m, float(v[i])) for m, v in (("x", a), ("y", b)) for i in range(37)], "date date, model string, ret double")
    got = tuple(inference.bootstrap_sharpe_ratio_difference(returns.repartition(5), model_1="x", model_2="y", n_bootstrap=draws, random_state=9).first())
    assert got == plain_bootstrap(a, b, draws, 9)  # to the last bit


def test_bootstrap_of_little(spark):
    returns = spark.createDataFrame([(month(0), "x", 0.1), (month(1), "y", 0.2), (month(2), "x", 0.1), (month(2), "y", 0.3)], "date date, model string, ret double")
    row = inference.bootstrap_sharpe_ratio_difference(returns, model_1="x", model_2="y", n_bootstrap=20, random_state=1).first()
    assert row.periods == 1 and row.sharpe_1 is None and row.bootstrap_mean is None
    assert inference.bootstrap_sharpe_ratio_difference(returns.filter("date <> '2020-03-31'"), model_1="x", model_2="y").count() == 0
    none = inference.bootstrap_sharpe_ratio_difference(returns, model_1="x", model_2="y", n_bootstrap=0).first()
    assert none.periods == 1 and none.p_value is None


def test_three_hundred_models(spark):
    many, months, tickers = 300, 4, 12
    rng = np.random.default_rng(2)
    x = rng.normal(size=(tickers * months, many))
    x[rng.random(x.shape) < 0.02] = np.nan
    x[:, 7] = np.nan
    y = rng.normal(size=tickers * months)
    names = [f"m{i:03d}" for i in range(many)]
    rows = [(f"T{k % tickers}", month(k // tickers), *(None if np.isnan(v) else float(v) for v in x[k]), float(y[k])) for k in range(len(x))]
    panel = spark.createDataFrame(rows, "ticker string, date date, " + ", ".join(f"{n} double" for n in names) + ", realized_return double")
    found = {(r.model_1, r.model_2): r for r in inference.diebold_mariano_test(panel).collect()}
    assert len(found) == many * (many - 1) // 2
    assert found["m000", "m007"].periods == 0 and found["m000", "m007"].dm_stat is None
    loss = (x - y[:, None]) ** 2
    for a, b in ((0, 1), (5, 299), (40, 41)):
        d = [np.nanmean((loss[:, a] - loss[:, b])[m * tickers : (m + 1) * tickers]) for m in range(months)]
        r = found[names[a], names[b]]
        assert r.periods == months and r.mean_loss_diff == pytest.approx(np.mean(d))
        assert r.dm_stat == pytest.approx(np.mean(d) / math.sqrt(np.var(d) / months))
