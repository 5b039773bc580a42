"""Reports: tables and the data of plots. Plots are frames (and CSV folders where a path is given), not pictures."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel import clip, is_after, numeric_columns
from ..operators.inference import compute_sharpe_significance_table, diebold_mariano_test
from ..operators.performance import RUIN, long_returns, summarize_returns_basic, transaction_cost_stress, wealth
from ..operators.portfolios import compute_long_short_returns, is_spread, quantile
from ..sources.readers import write_csv

START = "1995-01-31"


def plot_title(kind: str, *, subject: str | None = None, start_date: str | date | None = None, log_scale: bool | None = None, extra: str | None = None) -> str:
    """kind — subject (from date, scale, extra), leaving out what is not given."""
    head = " — ".join(part.strip() for part in (kind, subject) if part)
    if start_date is not None:
        start_date = (start_date if isinstance(start_date, (date, datetime)) else datetime.fromisoformat(str(start_date))).strftime("%Y-%m-%d")
    scale = None if log_scale is None else "log scale" if log_scale else "linear scale"
    notes = [note for note in (start_date and f"from {start_date}", scale, extra and extra.strip()) if note]
    return f"{head} ({', '.join(notes)})" if notes else head


def y_label(*, log_scale: bool) -> str:
    return "Growth of $1 (log)" if log_scale else "Growth of $1"


def column_label(model: str, bucket: str) -> str:
    return f"{model} - {bucket}"


def _saved(df: DataFrame, path: str | None) -> DataFrame:
    if path is not None:
        write_csv(df, str(path), single=True)
    return df


def clip_realized_returns(predictions: DataFrame, *, realized_col: str = "realized_return", lower: float = -0.9, upper: float = 2.0) -> DataFrame:
    """Rows with an outcome, the outcome bounded; unchanged where there is no such column."""
    if realized_col not in predictions.columns:
        return predictions
    return predictions.withColumn(realized_col, clip(realized_col, lower, upper)).filter(F.col(realized_col).isNotNull())


def _growth(returns: DataFrame, floor: float) -> DataFrame:
    usable = returns.withColumn("ret", F.when(F.col("ret") > floor, F.col("ret")))
    return wealth(usable).select("date", "model", "bucket", "ret", "cum")


def decile_cumulative_for_model(decile_returns: DataFrame, *, model: str, n_deciles: int = 10, start_date: str | None = None, clip_floor: float = RUIN, output_path: str | None = None) -> DataFrame:
    """Wealth of a model's deciles; KeyError where it has none."""
    rows = long_returns(decile_returns).filter((F.col("model") == model) & quantile().between(1, n_deciles))
    if rows.isEmpty():
        raise KeyError(f"no decile returns of model {model!r}")
    return _saved(_growth(rows.filter(is_after("date", start_date)), clip_floor), output_path)


def long_short_cumulative(decile_returns: DataFrame, *, start_date: str | None = START, bottom_decile: int = 1, top_decile: int | None = None, clip_floor: float = RUIN, output_path: str | None = None) -> DataFrame:
    """Wealth of every model's spread; ValueError where there are no spreads."""
    spreads = compute_long_short_returns(long_returns(decile_returns), bottom_decile=bottom_decile, top_decile=top_decile)
    if spreads.isEmpty():
        raise ValueError("no long-short returns can be made of decile_returns")
    return _saved(_growth(spreads.filter(is_after("date", start_date)), clip_floor), output_path)


def transaction_cost_stress_test(decile_returns: DataFrame, decile_weights: DataFrame, *, start_date: str = START, cost_bps_list: Sequence[float] = (0, 10, 25, 50), periods_per_year: int = 12, output_dir: str | None = None, plot_ls_models: Sequence[str] | None = None, ls_cost_mode: str | None = None) -> dict:
    """tc_summary, performance (frames with a tc_bps column) and plot: wealth of the spreads, of plot_ls_models if given."""
    summary, found = transaction_cost_stress(decile_returns, decile_weights, start_date=start_date, cost_bps_list=cost_bps_list, periods_per_year=periods_per_year, ls_cost_mode=ls_cost_mode)
    plot = found.cumulative.filter(is_spread())
    if plot_ls_models is not None:
        plot = plot.filter(F.col("model").isin(*map(str, plot_ls_models)))
    suffix = "all_models" if not plot_ls_models else "_vs_".join(map(str, plot_ls_models))
    if output_dir is not None:
        write_csv(plot, f"{output_dir}/ls_with_costs_log__{suffix}", single=True)
    return {"tc_summary": summary, "performance": found, "plot": plot}


def generate_comparison_report(*, decile_returns: DataFrame, prediction_panel: DataFrame | None = None, portfolio_weights: DataFrame | None = None, factor_loadings: DataFrame | None = None, feature_panel: DataFrame | None = None, feature_cols: Sequence[str] | None = None, transaction_cost_bps: float | None = None, realized_col: str = "realized_return", risk_free_rate: float = 0.0, periods_per_year: int = 12, rolling_sharpe_window: int = 12, output_dir: str | None = None, make_all_cumulative_plot: bool = False, make_ls_only_plot: bool = False) -> dict:
    """Performance, wealth and drawdowns of all portfolios, loss tests of forecasts and Sharpe tests of spreads.

    Weights, loadings, features, costs and the rolling window are accepted and not used, and the entries that would need
    them are None.
    """
    basic = summarize_returns_basic(decile_returns, risk_free_rate=risk_free_rate, periods_per_year=periods_per_year)
    spreads = compute_long_short_returns(long_returns(decile_returns))
    none = spreads.isEmpty()
    plot = basic.cumulative if make_all_cumulative_plot else None
    if make_ls_only_plot and not none:
        plot = _growth(spreads, RUIN).select("date", "model", "bucket", "cum")
    report = {
        "performance_metrics": basic.metrics,
        "cumulative_returns": basic.cumulative,
        "drawdowns": basic.drawdowns,
        "cumulative_plot": plot,
        "dm_table": None if prediction_panel is None else diebold_mariano_test(prediction_panel, realized_col=realized_col),
        "sharpe_table": None if none else compute_sharpe_significance_table(spreads, risk_free_rate=risk_free_rate, periods_per_year=periods_per_year),
    }
    if output_dir is not None:
        for name, df in report.items():
            if df is not None:
                write_csv(df, f"{output_dir}/{name}", single=True)
    return report | dict.fromkeys(("rolling_sharpe", "rolling_sharpe_plot", "factor_exposures", "factor_exposures_plot", "feature_importances", "feature_importance_plot"))


def long_short_rank_vs_raw(*, decile_returns_raw: DataFrame, decile_returns_rank: DataFrame, raw_model: str = "ridge_pred", rank_model: str = "ridge_rank", start_date: str | None = START, bottom_decile: int = 1, top_decile: int | None = None, clip_floor: float = RUIN, cap: float = 1.0, output_path: str | None = None) -> DataFrame:
    """(date, raw, rank, cum_raw, cum_rank): spreads of a prediction and of its ranks, capped, and their wealth."""
    sides = []
    for name, frame, model in (("raw", decile_returns_raw, raw_model), ("rank", decile_returns_rank, rank_model)):
        spreads = compute_long_short_returns(long_returns(frame), bottom_decile=bottom_decile, top_decile=top_decile)
        if spreads.isEmpty():
            raise ValueError(f"no long-short returns of {name} deciles")
        own = spreads.filter(F.col("model") == model)
        if own.isEmpty():
            raise KeyError(f"no long-short returns of {name} model {model!r}")
        usable = own.filter(is_after("date", start_date)).withColumn("ret", clip(F.when(F.col("ret") > clip_floor, F.col("ret")), -cap, cap)).filter("ret IS NOT NULL")
        sides.append(wealth(usable).select("date", F.col("ret").alias(name), F.col("cum").alias(f"cum_{name}")))
    out = sides[0].join(sides[1], "date", "full").select("date", "raw", "rank", "cum_raw", "cum_rank")
    return _saved(out, output_path)


def run_plot_suite(*, predictions: DataFrame, decile_returns: DataFrame, decile_weights: DataFrame, realized_col: str = "realized_return", model_cols: Sequence[str] | None = None, clip_lower: float = -0.9, clip_upper: float = 2.0, start_date: str = START, cost_bps_list: Sequence[float] = (0, 10, 25, 50), example_model: str | None = None, plot_ls_models: Sequence[str] = ("ols_pred", "ridge_rank"), output_dir: str | None = None) -> dict:
    """The usual set: one model's deciles, all spreads, spreads under costs, and the cleaned predictions."""
    clean = clip_realized_returns(predictions, realized_col=realized_col, lower=clip_lower, upper=clip_upper)
    models = list(model_cols) if model_cols is not None else numeric_columns(clean, ("ticker", "date", realized_col))
    example = example_model or (models[0] if models else None)
    at = lambda name: None if output_dir is None else f"{output_dir}/{name}"
    costs = transaction_cost_stress_test(decile_returns, decile_weights, start_date=start_date, cost_bps_list=cost_bps_list, output_dir=output_dir, plot_ls_models=plot_ls_models)
    if output_dir is not None:
        write_csv(costs["tc_summary"], f"{output_dir}/tc_summary", single=True)
    return {
        "predictions_clean": clean,
        "decile_cum_plot": None if example is None else decile_cumulative_for_model(decile_returns, model=example, start_date=start_date, output_path=at(f"cumulative_returns_{example}")),
        "long_short_plot": long_short_cumulative(decile_returns, start_date=start_date, output_path=at("ls_cumulative_log__all_models")),
        "tc_summary": costs["tc_summary"],
        "tc_plot": costs["plot"],
    }
