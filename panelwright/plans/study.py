"""The whole study in one call: daily rows to panel, predictions, portfolios, rankings and tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panel import clip
from ..functions.stored import stored, stored_by_ticker
from ..operators import dataset, exposures, features, linear, performance, portfolios, ranking, rolling
from ..sources.readers import factors_from_panel, read_daily_csv, read_factors, read_symbols, sample_tickers, tail_rows, write_csv
from . import reports


@dataclass(frozen=True)
class StudyConfig:
    """What the steps are called with. ranked: the model whose ranks are traded beside its raw predictions, against
    benchmark. realized_cap bounds the returns that ranked portfolios earn."""

    features: features.FeatureConfig = field(default_factory=features.FeatureConfig)
    exposures: exposures.ExposureConfig = field(default_factory=exposures.ExposureConfig)
    windows: linear.WindowConfig = field(default_factory=linear.WindowConfig)
    models: rolling.AllModels = field(default_factory=rolling.AllModels)
    standardize: str = "zscore"
    n_deciles: int = 10
    weight_col: str | None = None
    ranked: str = "ridge_pred"
    benchmark: str = "ols_pred"
    realized_cap: float = 1.0
    cost_bps: float = 25.0
    cost_bps_list: tuple[float, ...] = (0, 10, 25, 50)
    start_date: str = reports.START


@dataclass
class Study:
    """Frames of a study. panel and predictions are written tables, the rest are plans over them."""

    panel: DataFrame
    predictions: DataFrame
    decile_returns: DataFrame
    decile_weights: DataFrame
    report: dict[str, DataFrame | None]
    panel_ranked: DataFrame
    decile_returns_rank: DataFrame
    decile_weights_rank: DataFrame
    performance_rank: performance.Performance
    plots: dict[str, DataFrame | None]
    rank_vs_raw: DataFrame


def study(daily: DataFrame, factors: DataFrame | None = None, *, config: StudyConfig | None = None, output_dir: str | None = None) -> Study:
    """From daily rows (ticker, date, price, volume) and monthly factors to tables; without factors, those of the panel
    itself. With output_dir, panel, predictions and tables are also written there as CSV."""
    cfg = config or StudyConfig()
    at = lambda name: None if output_dir is None else f"{output_dir}/{name}"
    # One pass over the daily rows; what follows meets by ticker without a shuffle.
    months = stored_by_ticker(features.monthly_panel(daily, config=cfg.features), "months")
    returns = months.filter("RET IS NOT NULL").select("ticker", "date", "RET")
    characteristics = months.na.drop("all", subset=list(features.FEATURES)).select("ticker", "date", *features.FEATURES)
    series = factors if factors is not None else factors_from_panel(months.filter("RET IS NOT NULL"))
    loadings = exposures.compute_factor_exposures(returns, series, config=cfg.exposures)
    panel = stored_by_ticker(dataset.assemble_modeling_dataset(returns, characteristics, loadings, standardize=cfg.standardize), "panel")
    columns = [c for c in panel.columns if c not in ("ticker", "date", "next_return")]
    predictions = stored(rolling.generate_oos_predictions_all_models(panel, columns, window_config=cfg.windows, models=cfg.models), "predictions")
    models = list(rolling.MODEL_COLUMNS)
    weighted = {"weight_col": cfg.weight_col, "n_deciles": cfg.n_deciles}
    if cfg.weight_col is not None:
        predictions = predictions.join(panel.select("ticker", "date", cfg.weight_col), ["ticker", "date"], "left")
    deciles = portfolios.compute_decile_portfolio_returns(predictions, model_cols=models, **weighted)
    weights = portfolios.compute_decile_portfolio_weights(predictions, model_cols=models, **weighted)
    scored = predictions.select("ticker", "date", *models, "realized_return")
    report = reports.generate_comparison_report(decile_returns=deciles, prediction_panel=scored, portfolio_weights=weights, factor_loadings=loadings, feature_panel=panel, feature_cols=columns, output_dir=output_dir)

    rank_col = f"{cfg.ranked.removesuffix('_pred')}_rank"
    joined = panel.withColumnRenamed("next_return", "realized_return").join(scored.drop("realized_return"), ["ticker", "date"], "left")
    joined = joined.withColumn("realized_return", clip("realized_return", -cfg.realized_cap, cfg.realized_cap))
    ranks = ranking.convert_predictions_to_rankings(joined.select("ticker", "date", cfg.ranked), config=ranking.RankingConfig(prediction_col=cfg.ranked, output_col=rank_col, basis="zscore"))
    ranked = joined.join(ranks, ["ticker", "date"], "left")
    traded = [rank_col, cfg.benchmark]
    deciles_rank = portfolios.compute_decile_portfolio_returns(ranked, model_cols=traded, n_deciles=cfg.n_deciles)
    weights_rank = portfolios.compute_decile_portfolio_weights(ranked, model_cols=traded, n_deciles=cfg.n_deciles)
    summary = performance.summarize_portfolio_performance(deciles_rank, turnover_weights=weights_rank, transaction_cost_bps=cfg.cost_bps, ls_cost_mode="reference_precomputed")
    plots = reports.run_plot_suite(predictions=scored, decile_returns=deciles_rank, decile_weights=weights_rank, model_cols=models, start_date=cfg.start_date, cost_bps_list=cfg.cost_bps_list, example_model=cfg.benchmark, output_dir=output_dir)
    versus = reports.long_short_rank_vs_raw(decile_returns_raw=deciles, decile_returns_rank=deciles_rank, raw_model=cfg.ranked, rank_model=rank_col, start_date=cfg.start_date, output_path=at(f"ls_rank_vs_raw_{cfg.ranked.removesuffix('_pred')}"))
    if output_dir is not None:
        write_csv(panel, at("panel_sample"))
        write_csv(scored, at("predictions_sample"))
    return Study(panel, predictions, deciles, weights, report, ranked, deciles_rank, weights_rank, summary, plots, versus)


def study_from_files(spark: SparkSession, stock_folder: str, factors_path: str, metadata: Sequence[str] = (), *, share: float = 1.0, max_rows: int | None = 1500, factor_scale: float = 1.0, config: StudyConfig | None = None, output_dir: str | None = None) -> Study:
    """As study, from a folder of CSV files by ticker, a factor file, and files with the symbols to take (none: all)."""
    cfg = config or StudyConfig()
    price, volume = cfg.features.price_col, cfg.features.volume_col
    daily = read_daily_csv(spark, stock_folder, columns=(price, volume))
    if metadata:
        daily = daily.join(read_symbols(spark, *metadata), "ticker", "left_semi")
    if share < 1:
        daily = sample_tickers(daily, share)
    if max_rows is not None:
        daily = tail_rows(daily, max_rows)
    return study(daily.filter(F.col("ticker").isNotNull()), read_factors(spark, factors_path, scale=factor_scale), config=cfg, output_dir=output_dir)
