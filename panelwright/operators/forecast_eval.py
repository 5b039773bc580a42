"""Accuracy of forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.panel import finite, require_columns, require_panel
from ..functions.xsec import with_percentile_rank
from .portfolios import long_signals, model_columns


def aligned(panel: DataFrame, realized_col: str, model_cols: Sequence[str] | None) -> tuple[DataFrame, list[str]]:
    """(ticker, date, y, model, signal) where both are known, and the models."""
    require_panel(panel)
    require_columns(panel, (realized_col,), "realized column")
    models = model_columns(panel, None, (realized_col,))
    if model_cols is not None:
        models = [m for m in models if m in set(model_cols)]
    return long_signals(panel, models, {"y": finite(realized_col)}).filter("y IS NOT NULL"), models


def explained(error: str = "error", spread: str = "spread"):
    """1 - sum of squared errors by sum of squared spreads, null without spread."""
    return 1 - F.try_divide(F.sum(F.col(error) * F.col(error)), F.nullif(F.sum(F.col(spread) * F.col(spread)), F.lit(0.0)))


def compute_oos_r2(rows: DataFrame, y: str, pred: str) -> DataFrame:
    """One row, oos_r2: against the mean of all outcomes. Rows where either is missing are left out."""
    known = rows.select(finite(y).alias("y"), finite(pred).alias("p")).filter("y IS NOT NULL AND p IS NOT NULL")
    error = F.sum((F.col("y") - F.col("p")) * (F.col("y") - F.col("p")))
    return known.agg((1 - F.try_divide(error, F.nullif(F.var_pop("y") * F.count("y"), F.lit(0.0)))).alias("oos_r2"))


def spearman_by_date(rows: DataFrame) -> DataFrame:
    """(date, model, spearman) from aligned rows: correlation of ranks, null for constant ranks; dates with one name left out."""
    by = ("date", "model")
    ranked = with_percentile_rank(with_percentile_rank(rows, "signal", "rank_p", by=by), "y", "rank_y", by=by)
    both = F.stddev_pop("rank_p") * F.stddev_pop("rank_y")
    found = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.try_divide(F.covar_pop("rank_p", "rank_y"), F.nullif(both, F.lit(0.0))).alias("spearman"))
    return found.filter("n >= 2").select("date", "model", "spearman")


def evaluate_forecasting_accuracy(panel: DataFrame, *, realized_col: str = "realized_return", model_cols: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, spearman by date). summary: model, oos_r2 (against each date's mean), mae, mse, spearman_rank_corr; a model
    without any pair of forecast and outcome has nulls."""
    rows, models = aligned(panel, realized_col, model_cols)
    e = F.col("y") - F.col("signal")
    spread = F.col("y") - F.avg("y").over(Window.partitionBy("date", "model"))
    errors = rows.select("model", e.alias("error"), spread.alias("spread"))
    losses = errors.groupBy("model").agg(explained().alias("oos_r2"), F.avg(F.abs("error")).alias("mae"), F.avg(F.col("error") * F.col("error")).alias("mse"))
    monthly = spearman_by_date(rows)
    mean = monthly.groupBy("model").agg(F.avg("spearman").alias("spearman_rank_corr"))
    names = panel.sparkSession.createDataFrame([(m,) for m in models], "model string")
    return names.join(losses, "model", "left").join(mean, "model", "left"), monthly
