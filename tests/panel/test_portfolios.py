from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelwright.functions.xsec import with_buckets, with_percentile_rank
from panelwright.operators import forecast_eval, inference, performance, portfolios
from panelwright.plans import reports

from .frames import month, rows, series


def pandas_bucket(values: pd.Series, q: int) -> pd.Series:
    if values.nunique() < q:
        return pd.cut(values.rank(), q, labels=False, include_lowest=True) + 1
    return pd.qcut(values.rank(method="first"), q, labels=False) + 1


@pytest.mark.parametrize("q", [2, 3, 10, 25])
def test_buckets(spark, q):
    rng = np.random.default_rng(q)
    data, want = [], {}
    for i, n in enumerate([1, 2, 9, 10, 11, 12, 37, 91, 200]):
        for tied in (0, 1):
            d = month(2 * i + tied)
            v = pd.Series(np.round(rng.normal(size=n), 1 if tied else 9))
            names = [f"T{k:03d}" for k in range(n)]
            data += [(t, d, float(x)) for t, x in zip(names, v, strict=True)]
            want |= dict(zip([(t, d) for t in names], pandas_bucket(v, q), strict=True))
    df = spark.createDataFrame([*data, ("null", month(0), None)], "ticker string, date date, x double").repartition(3)
    assert series(with_buckets(df, "x", buckets=q), "decile") == want
    with pytest.raises(ValueError):
        with_buckets(df, "x", buckets=0)


@pytest.mark.parametrize("method", ["average", "min", "max", "first", "dense"])
def test_percentile_ranks(spark, method):
    v = [3, 1, 2, 2, None, 5, 2, 1]
    df = rows(spark, {"x": v}, tickers=[f"T{i}" for i in range(8)], months=1)
    got = series(with_percentile_rank(df, "x", "r", method=method), "r")
    want = pd.Series(v, dtype=float).rank(pct=True, method=method)
    assert [got[f"T{i}", month(0)] for i in range(8)] == [None if np.isnan(w) else pytest.approx(w) for w in want]


def test_tied_names_and_value_weights(spark):
    df = rows(spark, {"model_b": [1, 1, 1], "realized_return": [0.1, 0.0, -0.05], "mktcap": [1, 3, 6]}, tickers=list("ABC"), months=1)
    got = {r.bucket: r.ret for r in portfolios.compute_decile_portfolio_returns(df, weight_col="mktcap").collect()}
    assert got == {"5": pytest.approx(-0.02), "LS": None}
    assert {r.bucket: r.ret for r in portfolios.compute_decile_portfolio_returns(df.drop("mktcap")).collect()}["5"] == pytest.approx(0.05 / 3)
    zero = df.withColumn("mktcap", F.lit(0.0))
    assert {r.bucket: r.ret for r in portfolios.compute_decile_portfolio_returns(zero, weight_col="mktcap").collect()}["5"] is None
    assert [r.weight for r in portfolios.compute_decile_portfolio_weights(zero, model_cols=["model_b"], weight_col="mktcap").collect()] == pytest.approx([1 / 3] * 3)
    assert sorted(r.weight for r in portfolios.compute_decile_portfolio_weights(df, model_cols=["model_b"], weight_col="mktcap").collect()) == pytest.approx([0.1, 0.3, 0.6])
    with pytest.raises(ValueError):
        portfolios.compute_decile_portfolio_returns(df, n_deciles=0)
    with pytest.raises(KeyError):
        portfolios.compute_decile_portfolio_returns(df, model_cols=["none"])


def test_deciles_come_before_missing_returns_are_dropped(spark):
    df = rows(spark, {"m": [1, 2, 3, 4], "realized_return": [None, 0.2, 0.3, 0.4]}, tickers=list("ABCD"), months=1)
    got = {r.bucket: r.ret for r in portfolios.compute_decile_portfolio_returns(df, n_deciles=2).collect()}
    assert got == {"1": pytest.approx(0.2), "2": pytest.approx(0.35), "LS": pytest.approx(0.15)}


def test_turnover(spark):
    df = rows(spark, {"model": [1, 2, 2, 1]}, tickers=["A", "B"], months=2)
    weights = portfolios.compute_decile_portfolio_weights(df, n_deciles=2)
    got = {(r.bucket, r.date): r.turnover for r in portfolios.compute_turnover_from_weights(weights).collect()}
    assert got == {("1", month(0)): None, ("2", month(0)): None, ("1", month(1)): 1.0, ("2", month(1)): 1.0}
    gone = weights.filter(~((F.col("bucket") == "2") & (F.col("date") == month(1))))
    got = {(r.bucket, r.date): r.turnover for r in portfolios.compute_turnover_from_weights(gone).collect()}
    assert got["2", month(1)] == 0.5 and len(got) == 4  # absent on a date: sold


def long(spark, by_bucket: dict, model="model_a"):
    data = [(month(i), model, str(b), None if v is None else float(v)) for b, vals in by_bucket.items() for i, v in enumerate(vals)]
    return spark.createDataFrame(data, "date date, model string, bucket string, ret double")


def test_long_short(spark):
    returns = long(spark, {1: [0.01, 0.02], 10: [0.03, 0.01], "x": [9, 9]})
    got = {r.date: r.ret for r in portfolios.compute_long_short_returns(returns).collect()}
    assert got == {month(0): pytest.approx(0.02), month(1): pytest.approx(-0.01)}
    capped = portfolios.compute_long_short_returns(returns, bottom_decile=3, top_decile=7, cap=0.015)
    assert sorted(r.ret for r in capped.collect()) == pytest.approx([-0.01, 0.015])
    metrics = performance.summarize_portfolio_performance(long(spark, {1: [0.01, 0.03]}), periods_per_year=1).metrics.filter("bucket = '1'").first()
    assert metrics.sharpe_ratio == pytest.approx(math.sqrt(2)) and metrics.max_drawdown == 0


def test_costs(spark):
    weights = portfolios.compute_decile_portfolio_weights(rows(spark, {"model_a": [1, 2, 2, 1]}, tickers=["A", "B"], months=2), n_deciles=2)
    returns = long(spark, {1: [0.02, 0.03], 2: [0.01, 0.02]})
    found = performance.summarize_portfolio_performance(returns, turnover_weights=weights, transaction_cost_bps=10, periods_per_year=1)
    got = {r.bucket: r for r in found.metrics.collect()}
    assert got["1"].mean_return == pytest.approx((0.02 + 0.03 - 0.001) / 2) and got["1"].avg_turnover == 1.0
    c, gross = 0.001, [-0.01, -0.01]
    by_mode = {
        "reference_derived": gross[1] - 2 * c,
        "correct": gross[1] - 2 * c,
    }
    turnover = portfolios.compute_turnover_from_weights(weights)
    for mode, want in by_mode.items():
        net = performance.net_returns(performance.long_returns(returns), turnover, 10, ls_cost_mode=mode).filter("bucket = 'long_short'")
        assert {r.date: r.ret for r in net.collect()}[month(1)] == pytest.approx(want)
    uneven = turnover.withColumn("turnover", F.col("turnover") * F.when(F.col("bucket") == "2", 3.0).otherwise(1.0))
    for mode, want in (("reference_derived", gross[1] - 6 * c), ("correct", gross[1] - 4 * c)):
        net = performance.net_returns(performance.long_returns(returns), uneven, 10, ls_cost_mode=mode).filter("bucket = 'long_short'")
        assert {r.date: r.ret for r in net.collect()}[month(1)] == pytest.approx(want)
    with_ls = returns.unionByName(long(spark, {"LS": [0.5, 0.4]}))
    summary = reports.transaction_cost_stress_test(with_ls, weights, start_date="2020-02-01")
    assert [r.tc_bps for r in summary["tc_summary"].collect()] == [0, 10, 25, 50]
    assert len({r.mean_return for r in summary["tc_summary"].collect()}) == 1
    assert summary["performance"].cumulative.agg(F.min("date")).first()[0] == month(1)
    derived = reports.transaction_cost_stress_test(returns, weights)["tc_summary"].collect()
    assert [r.mean_return for r in derived] == sorted((r.mean_return for r in derived), reverse=True) and len(derived) == 4


def test_summaries_differ_in_clipping(spark):
    returns = long(spark, {1: [5.0, -0.95, 0.1, None], 2: [0.0] * 4})
    clipped = {r.bucket: r for r in performance.summarize_portfolio_performance(returns, periods_per_year=1).metrics.collect()}
    basic = {r.bucket: r for r in performance.summarize_returns_basic(returns, periods_per_year=1).metrics.collect()}
    assert clipped["1"].mean_return == pytest.approx((2.0 - 0.9 + 0.1) / 3) and basic["1"].mean_return == pytest.approx((5 - 0.95 + 0.1) / 3)
    assert basic["1"].max_drawdown == pytest.approx(0.05 - 1) and basic["2"].sharpe_ratio is None
    ruin = performance.summarize_returns_basic(long(spark, {1: [-1.0, -1.0]})).metrics.first()
    assert ruin.max_drawdown is None and ruin.mean_return == -12


A, B = [0.02, 0.01, 0.015, 0.005, 0.018, 0.0], [0.01, 0.0, 0.005, 0.002, 0.006, -0.002]


@pytest.fixture(scope="module")
def two(spark):
    return spark.createDataFrame([(month(i), m, float(v)) for m, vals in (("model_a", A), ("model_b", B)) for i, v in enumerate(vals)], "date date, model string, ret double")


def test_sharpe_tests(two):
    r = inference.jobson_korkie_test(two, model_1="model_a", model_2="model_b", memmel_correction=False).first()
    assert (r.sharpe_diff, r.jk_stat, r.p_value, r.periods) == (pytest.approx(2.2662684197995935), pytest.approx(1.2718862228771095), pytest.approx(0.20341354758736774), 6)
    short = inference.sharpe_tests(two.filter(F.col("date") == month(0)), ["model_a", "model_b"]).first()
    assert short.periods == 1 and short.sharpe_1 is None and short.p_value is None
    with pytest.raises(KeyError):
        inference.jobson_korkie_test(two, model_1="model_a", model_2="none")
    table = inference.compute_sharpe_significance_table(two)
    assert [(r.model_1, r.model_2) for r in table.collect()] == [("model_a", "model_b")]


def test_bootstrap(two):
    got = [inference.bootstrap_sharpe_ratio_difference(two, model_1="model_a", model_2="model_b", n_bootstrap=500, random_state=123).first() for _ in range(2)]
    assert got[0] == got[1]
    a, b, rng = np.array(A), np.array(B), np.random.default_rng(123)
    ratio = lambda x: x.mean() / x.std(ddof=1) * math.sqrt(12) if x.std(ddof=1) > 0 else np.nan
    diffs = []
    for _ in range(500):
        at = rng.integers(0, 6, size=6)
        diffs.append(ratio(a[at]) - ratio(b[at]))
    diffs, seen = np.array(diffs), ratio(a) - ratio(b)
    assert got[0].p_value == pytest.approx(2 * min(np.mean(diffs >= seen), np.mean(diffs <= seen))) and got[0].sharpe_diff == pytest.approx(seen)


def test_forecasts(spark):
    df = rows(spark, {"model_a": [0.09, 0.22, -0.12, 0.04], "model_b": [0.2, 0, -0.05, -0.3], "realized": [0.1, 0.2, -0.1, 0.05]}, tickers=["AAA", "BBB"], months=2)
    summary, monthly = forecast_eval.evaluate_forecasting_accuracy(df, realized_col="realized")
    got = {r.model: r for r in summary.collect()}
    e = np.array([0.01, -0.02, 0.02, 0.01])
    y = np.array([0.1, 0.2, -0.1, 0.05])
    spread = np.array([0.1, 0.075, -0.1, -0.075])
    assert got["model_a"].mae == pytest.approx(np.abs(e).mean()) and got["model_a"].mse == pytest.approx((e**2).mean())
    assert got["model_a"].oos_r2 == pytest.approx(1 - (e**2).sum() / (spread**2).sum()) and got["model_a"].spearman_rank_corr == pytest.approx(1)
    assert monthly.count() == 4
    assert forecast_eval.compute_oos_r2(df, "realized", "model_a").first()[0] == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())
    with pytest.raises(KeyError):
        forecast_eval.evaluate_forecasting_accuracy(df, realized_col="none")


@pytest.mark.parametrize("loss,horizon", [("squared_error", 1), ("absolute_error", 3), ("squared_error", 9)])
def test_diebold_mariano(spark, loss, horizon):
    rng = np.random.default_rng(7)
    n, months = 5, 6
    v = {c: rng.normal(size=n * months) for c in ("a", "b", "y")}
    df = rows(spark, v, tickers=[f"T{i}" for i in range(n)], months=months)
    r = inference.diebold_mariano_test(df, realized_col="y", loss=loss, horizon=horizon).first()
    cost = (lambda e: e**2) if loss == "squared_error" else np.abs
    d = (cost(v["a"] - v["y"]) - cost(v["b"] - v["y"])).reshape(n, months).mean(axis=0)
    u, lags = d - d.mean(), min(horizon - 1, months - 1)
    var = u @ u / months + sum(2 * (1 - k / (lags + 1)) * (u[k:] @ u[:-k]) / months for k in range(1, lags + 1))
    assert r.periods == months and r.mean_loss_diff == pytest.approx(d.mean())
    if var > 0:
        z = d.mean() / math.sqrt(var / months)
        assert r.dm_stat == pytest.approx(z) and r.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))
        assert inference.diebold_mariano_test(df, realized_col="y", loss=loss, horizon=horizon, test_mode=True).first().dm_stat == pytest.approx(2 * z)
    with pytest.raises(ValueError):
        inference.diebold_mariano_test(df, realized_col="y", loss="x")


def test_reports(spark, tmp_path):
    returns = long(spark, {1: [0.01, 0.02, -0.03], 2: [0.02, -0.01, 0.04]}).unionByName(long(spark, {1: [0.0, 0.01, 0.02], 2: [0.03, 0.02, 0.01]}, "model_b"))
    df = rows(spark, {"model_a": [1, 2, 3, 4, 5, 6], "model_b": [2, 1, 2, 1, 2, 1], "realized_return": [None, -5, 0.1, 10, 0, 0]}, tickers=["A", "B"], months=3)
    report = reports.generate_comparison_report(decile_returns=returns, prediction_panel=df, output_dir=f"{tmp_path}/r", make_ls_only_plot=True)
    assert report["performance_metrics"].count() == 4 and report["sharpe_table"].count() == 1 and report["dm_table"].count() == 1
    assert report["rolling_sharpe"] is None and report["cumulative_plot"].count() == 6 and (tmp_path / "r" / "drawdowns").exists()
    clean = reports.clip_realized_returns(df)
    assert sorted(r.realized_return for r in clean.collect()) == [-0.9, 0.0, 0.0, 0.1, 2.0]
    weights = portfolios.compute_decile_portfolio_weights(df.drop("realized_return"), n_deciles=2)
    suite = reports.run_plot_suite(predictions=df, decile_returns=returns, decile_weights=weights, model_cols=["model_a", "model_b"], plot_ls_models=["model_a"], output_dir=f"{tmp_path}/s")
    assert suite["decile_cum_plot"].count() == 6 and suite["long_short_plot"].count() == 6 and (tmp_path / "s" / "tc_summary").exists()
    both = reports.long_short_rank_vs_raw(decile_returns_raw=returns, decile_returns_rank=returns, raw_model="model_a", rank_model="model_b").collect()
    assert len(both) == 3 and all(r.cum_raw is not None and r.cum_rank is not None for r in both)
    with pytest.raises(KeyError):
        reports.decile_cumulative_for_model(returns, model="none")
    with pytest.raises(KeyError):
        reports.long_short_rank_vs_raw(decile_returns_raw=returns, decile_returns_rank=returns, raw_model="none", rank_model="model_b")
    with pytest.raises(ValueError):
        reports.long_short_cumulative(returns.limit(0))
    assert reports.plot_title(" Growth ", subject="x", start_date="1995-01-31", log_scale=True, extra="y") == "Growth — x (from 1995-01-31, log scale, y)"
    assert reports.plot_title("Growth") == "Growth" and reports.y_label(log_scale=False) == "Growth of $1" and reports.column_label("m", "1") == "m - 1"
    order = [(r.model, r.bucket) for r in portfolios.in_display_order(returns.unionByName(long(spark, {"LS": [0], 10: [0]})).filter(F.col("date") == month(0)).drop("date")).collect()]
    assert order == [("model_a", "1"), ("model_a", "2"), ("model_a", "10"), ("model_a", "LS"), ("model_b", "1"), ("model_b", "2")]
    wide = {r.model: r for r in portfolios.pivoted(returns.filter(F.col("date") == month(0)), 2).collect()}
    assert wide["model_b"]["2"] == 0.03
