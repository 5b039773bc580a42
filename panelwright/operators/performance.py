"""Performance of portfolios, net of costs of turnover."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.panel import clip, finite, is_after, require_columns
from .portfolios import compute_long_short_returns, compute_turnover_from_weights, is_spread, quantile

KEY = ("model", "bucket")
RETURN_BOUNDS = (-0.9, 2.0)
RUIN = -0.999
#: How costs reach spreads. precomputed: spreads that are in the frame bear none. derived: spreads made here are the net
#: top less the net bottom, charged with the turnover of both ends once more. correct: the gross spread less the costs of
#: both ends, wherever it comes from.
LS_COST_MODES = ("reference_precomputed", "reference_derived", "correct")


@dataclass
class Performance:
    """metrics: model, bucket, mean_return, volatility, sharpe_ratio, t_stat_mean, max_drawdown, avg_turnover.
    cumulative: date, model, bucket, cum. drawdowns: date, model, bucket, drawdown."""

    metrics: DataFrame
    cumulative: DataFrame
    drawdowns: DataFrame


def long_returns(returns: DataFrame) -> DataFrame:
    require_columns(returns, ("date", "model", "bucket", "ret"))
    return returns.select(F.to_date("date").alias("date"), "model", "bucket", finite("ret").alias("ret"))


def wealth(returns: DataFrame, by: Sequence[str] = KEY) -> DataFrame:
    """returns with cum (product of 1 + ret so far) and drawdown (below the highest cum so far); null where ret is."""
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = returns.withColumn("cum", F.when(F.col("ret").isNotNull(), F.product(1 + F.col("ret")).over(w)))
    return df.withColumn("drawdown", F.col("cum") / F.max("cum").over(w) - 1)


def sharpe_ratio(mean: Column, deviation: Column, risk_free_rate: float, periods_per_year: int) -> Column:
    return F.try_divide(mean - F.lit(risk_free_rate / periods_per_year), F.nullif(deviation, F.lit(0.0))) * F.sqrt(F.lit(float(periods_per_year)))


def _statistics(returns: DataFrame, by: Sequence[str], risk_free_rate: float, periods_per_year: int, *more: Column) -> DataFrame:
    """Statistics of the rows with a return, and more aggregates of these rows."""
    mean, dev, n = F.avg("ret"), F.stddev_samp("ret"), F.count("ret")
    return returns.filter("ret IS NOT NULL").groupBy(*by).agg(
        (mean * periods_per_year).alias("mean_return"),
        (dev * F.sqrt(F.lit(float(periods_per_year)))).alias("volatility"),
        sharpe_ratio(mean, dev, risk_free_rate, periods_per_year).alias("sharpe_ratio"),
        F.when(n > 1, F.try_divide(mean, F.nullif(dev / F.sqrt(n), F.lit(0.0)))).alias("t_stat_mean"),
        *more,
    )


def net_returns(returns: DataFrame, turnover: DataFrame | None, bps: Column | float | None, *, ls_cost_mode: str) -> DataFrame:
    """Returns less turnover by bps, with spreads as ls_cost_mode says; extra columns of returns are kept as keys."""
    if ls_cost_mode not in LS_COST_MODES:
        raise ValueError(f"ls_cost_mode must be one of {', '.join(LS_COST_MODES)}")
    rate = F.lit(0.0) if bps is None else (bps if isinstance(bps, Column) else F.lit(float(bps))) / 10_000
    if turnover is None:
        charged = returns.withColumn("cost", F.lit(0.0))
    else:
        charged = returns.join(turnover.select("date", *KEY, "turnover"), ["date", *KEY], "left").withColumn("cost", F.coalesce("turnover", F.lit(0.0)) * rate).drop("turnover")
    more = [c for c in returns.columns if c not in ("date", *KEY, "ret")]
    if ls_cost_mode == "reference_precomputed":
        return charged.withColumn("ret", F.when(is_spread(), F.col("ret")).otherwise(F.col("ret") - F.col("cost"))).drop("cost")
    net = charged.filter(~is_spread()).withColumn("ret", F.col("ret") - F.col("cost"))
    ends = charged.filter(~is_spread()).withColumn("q", quantile())
    which = ends.groupBy("model").agg(F.min("q").alias("bottom"), F.max("q").alias("top"))
    at = lambda c, end: F.max(F.when(F.col("q") == F.col(end), F.col(c)))
    legs = ends.join(which, "model").groupBy("date", "model", *more).agg((at("ret", "top") - at("ret", "bottom")).alias("gross"), F.coalesce(at("cost", "top"), F.lit(0.0)).alias("c_top"), F.coalesce(at("cost", "bottom"), F.lit(0.0)).alias("c_bottom"))
    if ls_cost_mode == "reference_derived":
        spread = F.col("gross") - F.col("c_top") + F.col("c_bottom") - (F.col("c_top") + F.col("c_bottom"))
    else:
        spread = F.col("gross") - (F.col("c_top") + F.col("c_bottom"))
    made = legs.select("date", "model", F.lit("long_short").alias("bucket"), spread.alias("ret"), *more)
    return net.drop("cost").unionByName(made)


def summarize_portfolio_performance(decile_returns: DataFrame, *, turnover_weights: DataFrame | None = None, transaction_cost_bps: float | None = None, risk_free_rate: float = 0.0, periods_per_year: int = 12, start_date: str | None = None, ls_cost_mode: str | None = None, plot_path: str | None = None) -> Performance:
    """Statistics of returns after costs, clipped to RETURN_BOUNDS; cumulative wealth and drawdowns.

    ls_cost_mode None: reference_precomputed where decile_returns has spreads, else reference_derived. Average turnover is
    that of all dates of the weights. plot_path: the cumulative frame is written there as CSV.
    """
    returns = long_returns(decile_returns).filter(is_after("date", start_date))
    turnover = None if turnover_weights is None else compute_turnover_from_weights(turnover_weights)
    mode = ls_cost_mode or ("reference_derived" if returns.filter(is_spread()).isEmpty() else "reference_precomputed")
    net = net_returns(returns, turnover, transaction_cost_bps, ls_cost_mode=mode)
    return _performance(net, turnover, KEY, risk_free_rate, periods_per_year, plot_path)


def _performance(net: DataFrame, turnover: DataFrame | None, by: Sequence[str], risk_free_rate: float, periods_per_year: int, plot_path: str | None = None) -> Performance:
    clipped = net.withColumn("ret", clip("ret", *RETURN_BOUNDS)).filter("ret IS NOT NULL")
    paths = wealth(clipped, by)
    metrics = _statistics(paths, by, risk_free_rate, periods_per_year, F.min("drawdown").alias("max_drawdown"))
    if turnover is None:
        metrics = metrics.withColumn("avg_turnover", F.lit(None).cast("double"))
    else:
        metrics = metrics.join(turnover.groupBy(*KEY).agg(F.avg("turnover").alias("avg_turnover")), list(KEY), "left")
    cumulative = paths.select("date", *by, "cum")
    if plot_path is not None:
        cumulative.write.mode("overwrite").option("header", True).csv(str(plot_path))
    return Performance(metrics, cumulative, paths.select("date", *by, "drawdown"))


def summarize_returns_basic(returns: DataFrame, *, risk_free_rate: float = 0.0, periods_per_year: int = 12) -> Performance:
    """The same without costs and without clipping; returns of ruin or worse are left out of wealth only."""
    rows = long_returns(returns).filter("ret IS NOT NULL")
    kept = wealth(rows.withColumn("all_ret", F.col("ret")).withColumn("ret", F.when(F.col("ret") > RUIN, F.col("ret"))))
    metrics = _statistics(kept.withColumn("ret", F.col("all_ret")), KEY, risk_free_rate, periods_per_year, F.min("drawdown").alias("max_drawdown"))
    paths = kept.filter("ret IS NOT NULL")
    return Performance(metrics, paths.select("date", *KEY, "cum"), paths.select("date", *KEY, "drawdown"))


def transaction_cost_stress(decile_returns: DataFrame, decile_weights: DataFrame, *, start_date: str | None = "1995-01-31", cost_bps_list: Sequence[float] = (0, 10, 25, 50), periods_per_year: int = 12, ls_cost_mode: str | None = None) -> tuple[DataFrame, Performance]:
    """(tc_summary, performance by tc_bps): spreads under several costs, turnover being computed once.

    tc_summary: tc_bps, model, bucket and the metrics, for spreads. The window applies to wealth and drawdowns after they
    are computed.
    """
    returns = long_returns(decile_returns)
    turnover = compute_turnover_from_weights(decile_weights)
    mode = ls_cost_mode or ("reference_derived" if returns.filter(is_spread()).isEmpty() else "reference_precomputed")
    levels = returns.withColumn("tc_bps", F.explode(F.array(*(F.lit(float(b)) for b in cost_bps_list))))
    found = _performance(net_returns(levels, turnover, F.col("tc_bps"), ls_cost_mode=mode), turnover, ("tc_bps", *KEY), 0.0, periods_per_year)
    summary = found.metrics.filter(is_spread()).select("tc_bps", *KEY, "mean_return", "volatility", "sharpe_ratio", "t_stat_mean", "max_drawdown").orderBy("tc_bps", F.col("sharpe_ratio").desc_nulls_last())
    late = [d.filter(is_after("date", start_date)) for d in (found.cumulative, found.drawdowns)]
    return summary, Performance(found.metrics, *late)


__all__ = ["Performance", "compute_long_short_returns", "net_returns", "summarize_portfolio_performance", "summarize_returns_basic", "transaction_cost_stress", "wealth"]
