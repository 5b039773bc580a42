"""The study from raw files to tables, each step as it is when called by itself."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from panelwright.operators import exposures, features, linear, portfolios, rolling
from panelwright.plans import study
from panelwright.sources.readers import read_daily_csv, read_factors

from .frames import month, series

CONFIG = study.StudyConfig(
    features=features.FeatureConfig(volatility_window_days=40, volatility_min_days=10), exposures=exposures.ExposureConfig(6, 12), windows=linear.WindowConfig(4, 6),
    models=rolling.AllModels(trees=6, min_samples_leaf=2), n_deciles=3, start_date="2020-01-31",
)


def test_from_files_to_tables(spark, tmp_path):
    rng = np.random.default_rng(3)
    stocks = tmp_path / "stocks"
    stocks.mkdir()
    days = [date(2020, 1, 1) + timedelta(i) for i in range(0, 1100, 2)]
    for t in range(14):
        price = 50 * np.exp(np.cumsum(rng.normal(0.0005, 0.02, len(days))))
        lines = [f"{d},{p:.4f},{int(v)}" for d, p, v in zip(days, price, rng.integers(100, 900, len(days)), strict=True)]
        (stocks / f"T{t:02d}.csv").write_text("\n".join(["date,adj_close,volume", *lines]) + "\n")
    (stocks / "BAD.csv").write_text("nothing\n1\n")
    (tmp_path / "meta.csv").write_text("Symbol\n" + "".join(f"T{t:02d}\n" for t in range(12)) + "GONE\nBAD\n")
    factors = ["date,MKT,SMB,HML,RF"] + [f"{month(i)},{','.join(f'{v:.5f}' for v in rng.normal(0, 0.03, 3))},0.001" for i in range(37)]
    (tmp_path / "factors.csv").write_text("\n".join(factors) + "\n")
    done = study.study_from_files(spark, str(stocks), f"{tmp_path}/factors.csv", [f"{tmp_path}/meta.csv"], max_rows=500, config=CONFIG, output_dir=f"{tmp_path}/out")
    panel, predictions = done.panel.toPandas(), done.predictions.toPandas()
    assert set(panel["ticker"]) == {f"T{t:02d}" for t in range(12)} and len(panel) > 100
    assert list(predictions.columns) == ["ticker", "date", *rolling.MODEL_COLUMNS, "realized_return"] and predictions[list(rolling.MODEL_COLUMNS)].notna().all().all()
    columns = [c for c in panel.columns if c not in ("ticker", "date", "next_return")]
    assert len(columns) == 10
    ols = series(linear.rolling_ols(done.panel, columns, window_config=CONFIG.windows), "prediction")
    assert series(done.predictions, "ols_pred") == pytest.approx(ols)
    daily = read_daily_csv(spark, str(stocks))
    loads = exposures.compute_factor_exposures(features.monthly_returns(daily.filter("ticker = 'T03'")), read_factors(spark, f"{tmp_path}/factors.csv"), config=CONFIG.exposures)
    want = series(loads, "beta_MKT")
    assert all(v == pytest.approx(want[k]) for k, v in series(done.panel.filter("ticker = 'T03'"), "beta_MKT").items() if k[1] > month(16))
    spread = portfolios.compute_decile_portfolio_returns(done.predictions, model_cols=["ridge_pred"], n_deciles=3).filter("bucket = 'LS'")
    raw = {r.date: r.raw for r in done.rank_vs_raw.filter("raw IS NOT NULL").collect()}
    assert raw == pytest.approx({r.date: r.ret for r in spread.filter("ret IS NOT NULL").collect()})
    metrics = done.performance_rank.metrics.toPandas()
    assert set(metrics["model"]) == {"ridge_rank", "ols_pred"} and set(metrics["bucket"]) == {"1", "2", "3", "LS"}
    assert done.report["dm_table"].count() == 10 and done.report["sharpe_table"].count() == 10
    for name in ("panel_sample", "predictions_sample", "performance_metrics", "dm_table", "sharpe_table", "tc_summary", "ls_rank_vs_raw_ridge"):
        assert spark.read.option("header", True).csv(f"{tmp_path}/out/{name}").count() > 0
