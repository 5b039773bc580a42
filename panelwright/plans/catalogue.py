"""Queries over the panel adapter, one or more for each operator, with the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.panel import is_after
from ..functions.stored import fresh_path, gone_at_exit, stored_by_ticker
from ..functions.xsec import with_buckets, with_percentile_rank, zscore
from ..operators import dataset, exposures, features, forecast_eval, inference, linear, performance, portfolios, ranking, rolling, tree_models
from ..sources.readers import Adapter, factors_from_panel, numbers, read_daily_csv, read_factors, read_symbols, sample_tickers, tail_rows, write_csv, write_daily_csv
from . import reports, study
from .panel_sql import FALLBACK, ORACLES, TRAIN_MAX, TRAIN_MIN, TREE_LEAF

Query = Callable[[SparkSession, str], DataFrame]
MODELS = ("momentum", "value")
FEATURES = list(features.FEATURES)
WINDOWS = linear.WindowConfig(TRAIN_MIN, TRAIN_MAX)
EXPOSURES = exposures.ExposureConfig(TRAIN_MIN, TRAIN_MAX)
#: What models are fitted on: every column of the modelling panel but its target.
COLUMNS = [*FEATURES, *EXPOSURES.columns]
ONE_FACTOR = exposures.ExposureConfig(TRAIN_MIN, TRAIN_MAX, factor_cols=("MKT",))


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(f.name, digits).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


def significant(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many significant digits, for values of very different sizes."""
    return df.select(*(F.format_string(f"%.{digits - 1}e", f.name).cast("double").alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name) for f in df.schema.fields))


class Panel:
    """Frames of one folder; each is a plan, computed when a query runs. Only `monthly` and `modeling` are written,
    for queries that read these panels more than once: daily rows are put together once in each of them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.source = spark, Adapter(folder)
        self.daily = self.source.daily(spark)

    @cached_property
    def monthly(self) -> DataFrame:
        """All characteristics, the return and the next one of every month, in buckets by ticker."""
        return stored_by_ticker(features.monthly_panel(self.daily), "monthly")

    def months(self, **config) -> DataFrame:
        cfg = features.FeatureConfig(**config)
        return features.with_lags(features.monthly(features.with_daily_volatility(self.daily, cfg), cfg))

    def features(self, **config) -> DataFrame:
        return features.compute_features(self.daily, config=features.FeatureConfig(**config))

    def returns(self) -> DataFrame:
        return self.monthly.filter("RET IS NOT NULL").select("ticker", "date", "RET")

    def factors(self) -> DataFrame:
        return factors_from_panel(self.monthly.filter("RET IS NOT NULL"))

    def loadings(self, config: exposures.ExposureConfig, **kw) -> DataFrame:
        return exposures.compute_factor_exposures(self.returns(), self.factors(), config=config, **kw)

    @staticmethod
    def _signals(months: DataFrame) -> DataFrame:
        known = months.na.drop("all", subset=FEATURES)
        return known.select("ticker", "date", *MODELS, "volatility", "dollar_volume", F.col("next_return").alias("realized_return"))

    def signals(self) -> DataFrame:
        """Two characteristics as signals, with next month's return."""
        return self._signals(self.monthly)

    def signals_once(self) -> DataFrame:
        """The same without a written table, for queries that read it once."""
        return self._signals(features.monthly_panel(self.daily))

    def model_panel(self) -> DataFrame:
        return self.monthly.na.drop("all", subset=FEATURES).drop("RET")

    def full_panel(self, **kw) -> DataFrame:
        """The modelling panel with all characteristics and loadings."""
        characteristics = self.monthly.na.drop("all", subset=FEATURES).select("ticker", "date", *FEATURES)
        return dataset.assemble_modeling_dataset(self.returns(), characteristics, self.loadings(EXPOSURES), **kw)

    @cached_property
    def modeling(self) -> DataFrame:
        """full_panel() written, for models whose plans read it several times."""
        return stored_by_ticker(self.full_panel(), "modeling")

    def deciles(self, *, once: bool = False, **kw) -> DataFrame:
        return portfolios.compute_decile_portfolio_returns(self.signals_once() if once else self.signals(), model_cols=MODELS, **kw)

    def weights(self, *, once: bool = False, **kw) -> DataFrame:
        return portfolios.compute_decile_portfolio_weights(self.signals_once() if once else self.signals(), model_cols=MODELS, **kw)

    def spreads(self) -> DataFrame:
        return portfolios.compute_long_short_returns(self.deciles())


def _feature(name: str, out: str, **config) -> Callable[[Panel], DataFrame]:
    return lambda p: p.features(**config).select("ticker", "date", F.col(name).alias(out)).filter(F.col(out).isNotNull())


def _ranks(method: str) -> Callable[[Panel], DataFrame]:
    return lambda p: with_percentile_rank(p.features(), "momentum", "momentum_rank", method=method).select("ticker", "date", "momentum_rank")


def _buckets(n: int) -> Callable[[Panel], DataFrame]:
    return lambda p: with_buckets(portfolios.long_signals(p.signals_once(), MODELS, {}), "signal", buckets=n, by=("date", "model")).select("ticker", "date", "model", "decile")


def _net(mode: str) -> Callable[[Panel], DataFrame]:
    def made(p: Panel) -> DataFrame:
        returns = p.deciles()
        if mode != "reference_precomputed":
            returns = returns.filter(~portfolios.is_spread())
        net = performance.net_returns(performance.long_returns(returns), portfolios.compute_turnover_from_weights(p.weights()), 25.0, ls_cost_mode=mode)
        return net if mode == "reference_precomputed" else net.filter(portfolios.is_spread())

    return made


def _summary(p: Panel) -> performance.Performance:
    return performance.summarize_portfolio_performance(p.deciles(), turnover_weights=p.weights(), transaction_cost_bps=25, ls_cost_mode="reference_precomputed")


def _gross(p: Panel) -> performance.Performance:
    return performance.summarize_portfolio_performance(p.deciles(), ls_cost_mode="reference_precomputed")


def _regularized(kind: str, **kw) -> Callable[[Panel], DataFrame]:
    how = rolling.RegularizedModelConfig(model_type=kind, cv_folds=3, **kw)
    return lambda p: rolling.rolling_regularized_predictions(p.modeling, COLUMNS, window_config=WINDOWS, model_config=how)


def _candidates() -> list[rolling.CandidateModel]:
    ridge = lambda a: rolling.Regularized(rolling.RegularizedModelConfig(alphas=(a,), cv_folds=3))
    return [rolling.CandidateModel("light", lambda: ridge(0.1)), rolling.CandidateModel("heavy", lambda: ridge(1000.0))]


def _all_models(p: Panel) -> DataFrame:
    return rolling.generate_oos_predictions_all_models(p.modeling, COLUMNS, window_config=WINDOWS)


def _csv_panel(p: Panel) -> DataFrame:
    """The daily panel written as a file for each ticker and read back."""
    path = fresh_path(p.spark, "csv-panel")
    write_daily_csv(p.daily, path)
    gone_at_exit(p.spark, path)
    return read_daily_csv(p.spark, path).withColumn("ticker", F.col("ticker").cast(p.daily.schema["ticker"].dataType))


def _csv_factors(p: Panel) -> DataFrame:
    """The factor series written as one CSV table and read back as factors in percent are."""
    path = fresh_path(p.spark, "csv-factors")
    write_csv(p.factors().select("date", *((100 * F.col(c)).alias(c) for c in ("MKT", "SMB", "HML", "RF"))), path, single=True)
    gone_at_exit(p.spark, path)
    return read_factors(p.spark, path, scale=0.01)


def _csv_symbols(p: Panel) -> DataFrame:
    """Symbols of two lists of tickers that overlap, written and read back."""
    paths = [fresh_path(p.spark, "csv-symbols") for _ in range(2)]
    for k, path in enumerate(paths):
        write_csv(p.daily.filter(F.col("ticker") % 3 != k).select(F.col("ticker").alias("Symbol"), F.lit("x, y").alias("Name")), path)
        gone_at_exit(p.spark, path)
    return read_symbols(p.spark, *paths)


def _study(p: Panel) -> DataFrame:
    """The whole study over the adapter's daily rows: what portfolios of ranks and of least squares earn after costs."""
    return study.study(p.daily, config=study.StudyConfig(exposures=EXPOSURES, windows=WINDOWS)).performance_rank.metrics


def _rank_vs_raw(p: Panel) -> DataFrame:
    signals = p.signals()
    ranks = ranking.convert_predictions_to_rankings(signals, config=ranking.RankingConfig(prediction_col="momentum", output_col="momentum_rank", basis="zscore"))
    both = signals.join(ranks, ["ticker", "date"], "left")
    raw, rank = (portfolios.compute_decile_portfolio_returns(both, model_cols=[m]) for m in ("momentum", "momentum_rank"))
    return reports.long_short_rank_vs_raw(decile_returns_raw=raw, decile_returns_rank=rank, raw_model="momentum", rank_model="momentum_rank")


def _accuracy(p: Panel) -> DataFrame:
    panel = p.signals_once().select("ticker", "date", *MODELS, "realized_return")
    found = forecast_eval.evaluate_forecasting_accuracy(panel)[0]
    return found.select("model", "oos_r2", "mae", "mse")


def _decile_pivot(p: Panel) -> DataFrame:
    wide = portfolios.pivoted(p.deciles()).drop("long_short")
    return wide.select("date", "model", *(F.col(f"`{c}`").alias(f"b_{c}") for c in wide.columns[2:]))


def _report(p: Panel, part: str) -> DataFrame:
    return reports.generate_comparison_report(decile_returns=p.deciles(), prediction_panel=p.signals().select("ticker", "date", *MODELS, "realized_return"))[part]


PANEL: dict[str, Callable[[Panel], DataFrame]] = {
    "daily_panel": lambda p: p.daily,
    "ticker_sample": lambda p: sample_tickers(p.daily, 0.5),
    "tail_rows": lambda p: tail_rows(p.daily, 100).select("ticker", "date", "adj_close"),
    "csv_panel": _csv_panel,
    "csv_factors": _csv_factors,
    "csv_symbols": _csv_symbols,
    "daily_return": lambda p: features.with_daily_volatility(p.daily, features.FeatureConfig()).select("ticker", "date", "ret"),
    "realized_vol": lambda p: features.with_daily_volatility(p.daily, features.FeatureConfig()).select("ticker", "date", F.col("realized_vol").alias("rvol")),
    "monthly_resample_last": lambda p: p.months().filter("price IS NOT NULL").select("ticker", "date", "price", "volume", "vol"),
    "month_spine": lambda p: p.months().select("ticker", "date", F.col("price").isNull().alias("is_gap")),
    "monthly_return": lambda p: features.monthly_returns(p.daily).withColumnRenamed("RET", "ret"),
    "dollar_volume": _feature("dollar_volume", "dollar_volume"),
    "value_ma": _feature("value", "value_ma"),
    "value_reversal": lambda p: p.features(value_method="long_term_reversal").filter("value IS NOT NULL").select("ticker", "date", F.col("value").alias("value_reversal")),
    "momentum_reference": _feature("momentum", "momentum_reference"),
    "momentum_standard": _feature("momentum", "momentum_standard", compounding="standard"),
    "volatility": _feature("volatility", "volatility"),
    "investment": _feature("investment", "investment"),
    "profitability_sharpe": _feature("profitability", "profitability_sharpe"),
    "profitability_rov": _feature("profitability", "profitability_rov", profitability_method="return_over_volatility"),
    "features_all": lambda p: p.features(),
    "factor_series": lambda p: p.factors(),
    "next_return": lambda p: dataset.next_return(features.monthly_returns(p.daily)),
    "zscore_char": lambda p: p.features().select("ticker", "date", zscore("momentum").alias("momentum")),
    **{f"pct_rank_{m}": _ranks(m) for m in ("average", "min", "max", "first", "dense")},
    "pct_rank_ranged": lambda p: with_percentile_rank(p.features(), "momentum", "momentum_rank", ranged=True).select("ticker", "date", "momentum_rank"),
    "decile_ranged": lambda p: with_buckets(portfolios.long_signals(p.signals_once(), MODELS, {}), "signal", by=("date", "model"), ranged=True).select("ticker", "date", "model", "decile"),
    "modeling_panel": lambda p: p.full_panel(),
    "modeling_panel_ranged": lambda p: p.full_panel(ranged=True),
    "modeling_panel_ranks": lambda p: p.full_panel(standardize="rank"),
    "decile_qcut": _buckets(10),
    "decile_cut_fallback": _buckets(FALLBACK),
    "decile_returns_ew": lambda p: p.deciles(once=True),
    "decile_returns_vw": lambda p: p.deciles(once=True, weight_col="dollar_volume").filter(~portfolios.is_spread()),
    "decile_pivot": _decile_pivot,
    "long_short": lambda p: p.spreads(),
    "long_short_capped": lambda p: portfolios.compute_long_short_returns(p.deciles(), cap=0.05),
    "decile_weights_ew": lambda p: p.weights(once=True),
    "decile_weights_vw": lambda p: p.weights(once=True, weight_col="dollar_volume"),
    "turnover": lambda p: portfolios.compute_turnover_from_weights(p.weights()),
    "net_returns": _net("reference_precomputed"),
    "ls_cost_correct": _net("correct"),
    "ls_cost_derived": _net("reference_derived"),
    "perf_summary": lambda p: _summary(p).metrics,
    "basic_summary": lambda p: performance.summarize_returns_basic(p.deciles()).metrics,
    "cumulative": lambda p: _gross(p).cumulative.select("date", "model", "bucket", "cum"),
    "drawdown": lambda p: _gross(p).drawdowns,
    "tc_stress": lambda p: reports.transaction_cost_stress_test(p.deciles(), p.weights(), ls_cost_mode="reference_precomputed")["tc_summary"],
    "clip_realized": lambda p: reports.clip_realized_returns(p.signals_once(), lower=-0.1, upper=0.2).select("ticker", "date", "realized_return"),
    "oos_r2": lambda p: forecast_eval.compute_oos_r2(p.signals_once(), "realized_return", "momentum"),
    "forecast_accuracy": _accuracy,
    "spearman_by_date": lambda p: forecast_eval.evaluate_forecasting_accuracy(p.signals_once().select("ticker", "date", *MODELS, "realized_return"))[1],
    "dm_stat": lambda p: inference.diebold_mariano_test(p.signals_once().select("ticker", "date", *MODELS, "realized_return"), horizon=3).select("model_1", "model_2", F.round("dm_stat", 6).alias("dm_stat"), "mean_loss_diff", "periods"),
    "jk_stat": lambda p: inference.jobson_korkie_test(p.spreads(), model_1="momentum", model_2="value").drop("model_1", "model_2", "p_value"),
    "pred_rank_riskadj": lambda p: ranking.convert_predictions_to_rankings(p.features(), config=ranking.RankingConfig(prediction_col="momentum", risk_adjust="volatility", volatility_col="volatility")),
    "pred_rank_zscore": lambda p: ranking.convert_predictions_to_rankings(p.features(), config=ranking.RankingConfig(prediction_col="momentum", basis="zscore")),
    "exposures_1factor": lambda p: p.loadings(ONE_FACTOR),
    "xs_ols_1feature": lambda p: linear.cross_sectional_ols(p.model_panel(), ["momentum"]),
    "rolling_ols_1feature": lambda p: linear.rolling_ols(p.model_panel(), ["momentum"], window_config=WINDOWS),
    "ridge_1feature": lambda p: rolling.rolling_regularized_predictions(p.model_panel(), ["momentum"], window_config=WINDOWS, model_config=rolling.RegularizedModelConfig(alphas=(10.0,))),
    "lasso_1feature": lambda p: rolling.rolling_regularized_predictions(p.model_panel(), ["momentum"], window_config=WINDOWS, model_config=rolling.RegularizedModelConfig(model_type="lasso", alphas=(0.001,))),
    "elasticnet_1feature": lambda p: rolling.rolling_regularized_predictions(p.model_panel(), ["momentum"], window_config=WINDOWS, model_config=rolling.RegularizedModelConfig(model_type="elasticnet", alphas=(0.002,), l1_ratios=(0.5,))),
    "expanding_ols_1feature": lambda p: linear.rolling_ols(p.model_panel(), ["momentum"], window_config=linear.WindowConfig(TRAIN_MIN, expanding=True)),
    "xs_ols_2features": lambda p: linear.cross_sectional_ols(p.model_panel(), list(MODELS)),
    "xs_ols_2features_ranks": lambda p: linear.cross_sectional_ols(p.model_panel(), list(MODELS), config=linear.CrossSectionalOLSConfig(prediction_type="rank")),
    "rolling_ols_2features": lambda p: linear.rolling_ols(p.model_panel(), list(MODELS), window_config=WINDOWS),
    "exposures_ff3": lambda p: p.loadings(EXPOSURES),
    "exposures_ff3_exact": lambda p: p.loadings(EXPOSURES, mode="exact"),
    "xs_ols": lambda p: linear.cross_sectional_ols(p.full_panel(), COLUMNS),
    "xs_ols_ranks": lambda p: linear.cross_sectional_ols(p.full_panel(), COLUMNS, config=linear.CrossSectionalOLSConfig(prediction_type="rank")),
    "rolling_ols": lambda p: linear.rolling_ols(p.full_panel(), COLUMNS, window_config=WINDOWS),
    "expanding_ols": lambda p: linear.rolling_ols(p.full_panel(), COLUMNS, window_config=linear.WindowConfig(TRAIN_MIN, expanding=True)),
    "rolling_ridge": _regularized("ridge"),
    "rolling_lasso": _regularized("lasso"),
    "rolling_elasticnet": _regularized("elasticnet", l1_ratios=(0.5, 0.9)),
    "rolling_forest": lambda p: rolling.rolling_forest_predictions(p.modeling, COLUMNS, window_config=WINDOWS),
    "rolling_tuning": lambda p: rolling.rolling_time_series_tuning(p.modeling, COLUMNS, candidates=_candidates(), window_config=WINDOWS).best_models,
    "all_models_oos": _all_models,
    "xs_forest": lambda p: tree_models.cross_sectional_random_forest(p.modeling, COLUMNS),
    "xs_tree": lambda p: tree_models.cross_sectional_random_forest(p.model_panel(), list(MODELS), config=tree_models.RandomForestConfig(n_estimators=1, max_depth=2, min_samples_leaf=TREE_LEAF, bootstrap=False)),
    "xs_boosting": lambda p: tree_models.cross_sectional_gradient_boosting(p.modeling, COLUMNS),
    "bootstrap_sharpe": lambda p: inference.bootstrap_sharpe_ratio_difference(p.spreads(), model_1="momentum", model_2="value", random_state=123),
    "sharpe_table": lambda p: _report(p, "sharpe_table").drop("p_value"),
    "dm_table": lambda p: _report(p, "dm_table").drop("p_value"),
    "decile_growth": lambda p: reports.decile_cumulative_for_model(p.deciles(), model="momentum"),
    "long_short_growth": lambda p: reports.long_short_cumulative(p.deciles()),
    "rank_vs_raw": _rank_vs_raw,
    "plot_suite_costs": lambda p: reports.run_plot_suite(predictions=p.signals(), decile_returns=p.deciles(), decile_weights=p.weights(), model_cols=MODELS, plot_ls_models=MODELS)["tc_plot"],
    "study": _study,
    "user_day_ranks": lambda p: with_percentile_rank(p.source.user_days(p.spark), "value", "value_rank").select("ticker", "date", "value_rank"),
    "late_rows": lambda p: features.monthly_returns(p.daily).filter(is_after("date", "2000-01-31")).withColumnRenamed("RET", "ret"),
}


#: Queries whose values differ much in size.
SIGNIFICANT = {"value_reversal", "cumulative", "oos_r2", "forecast_accuracy", "dm_stat", "decile_growth", "long_short_growth", "rank_vs_raw", "plot_suite_costs", "dm_table"}


def _over_panel(name: str, make: Callable[[Panel], DataFrame]) -> Query:
    kept = significant if name in SIGNIFICANT else rounded
    return lambda spark, folder: kept(make(Panel(spark, folder)))


def safe_cast(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers, junk, blanks and what is no finite number, as text: only finite numbers stay."""
    orders = spark.read.parquet(f"{folder}/orders.parquet")
    key = F.col("o_orderkey")
    kinds = [F.col("o_totalprice").cast("string"), F.concat(F.lit(" "), key.cast("string"), F.lit(" ")), *map(F.lit, ("n/a", "", "nan", "1e400", "-1.5e3"))]
    text = F.col("o_orderstatus").cast("string")
    for k, kind in enumerate(kinds):
        text = F.when(key % 8 == k, kind).otherwise(text)
    return orders.select("o_orderkey", numbers(text).alias("x"))


QUERIES: dict[str, Query] = {name: _over_panel(name, make) for name, make in PANEL.items()} | {"safe_cast": safe_cast}
