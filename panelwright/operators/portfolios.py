"""Quantile portfolios of model signals.

Frames are long: returns are (date, model, bucket, ret), weights (ticker, date, model, bucket, weight). bucket is a string:
the number of a quantile, or LS or long_short for a spread of top minus bottom.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.panel import clip, finite, require_columns, require_panel
from ..functions.xsec import with_buckets

SPREADS = ("LS", "long_short")


def quantile(bucket: str = "bucket") -> Column:
    """Number of a quantile's bucket, null for spreads."""
    return F.expr(f"try_cast({bucket} AS INT)")


def is_spread(bucket: str = "bucket") -> Column:
    return F.col(bucket).isin(*SPREADS)


def in_display_order(df: DataFrame) -> DataFrame:
    """By model, quantiles by number, spreads after them."""
    return df.orderBy(*([c for c in ("date",) if c in df.columns]), "model", quantile().asc_nulls_last(), "bucket")


def long_signals(panel: DataFrame, models: Sequence[str], keep: dict[str, Column]) -> DataFrame:
    """ticker, date, the kept columns, model, signal: a row for each model with a signal."""
    wide = panel.select("ticker", F.to_date("date").alias("date"), *(c.alias(n) for n, c in keep.items()), *(finite(m).alias(f"m_{i}") for i, m in enumerate(models)))
    listed = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"m_{i}").alias("signal")) for i, m in enumerate(models)))
    return wide.select("ticker", "date", *keep, F.inline(listed)).filter("signal IS NOT NULL")


def model_columns(panel: DataFrame, model_cols: Sequence[str] | None, excluding: Sequence[str | None]) -> list[str]:
    require_panel(panel)
    if model_cols is None:
        return [c for c in panel.columns if c not in ("ticker", "date", *excluding)]
    require_columns(panel, model_cols, "model column")
    return list(model_cols)


def assigned(panel: DataFrame, models: Sequence[str], n_deciles: int, keep: dict[str, Column], ranged: bool = False) -> DataFrame:
    """Signals with their decile; the section of a date is that of all names with a signal."""
    return with_buckets(long_signals(panel, models, keep), "signal", buckets=n_deciles, by=("date", "model"), ranged=ranged)


def compute_decile_portfolio_returns(panel: DataFrame, *, model_cols: Sequence[str] | None = None, return_col: str = "realized_return", weight_col: str | None = None, n_deciles: int = 10, ranged: bool = False) -> DataFrame:
    """Mean, or weighted mean, of the returns in each decile, and LS: the last decile less the first.

    Names without a return count for the deciles and not for the means. Deciles whose weights sum to zero have no return.
    LS is null on dates where either end has none; a model has an LS row for each date on which it has a return. ranged:
    sections are too large for one task each.
    """
    models = model_columns(panel, model_cols, (return_col, weight_col))
    require_columns(panel, [c for c in (return_col, weight_col) if c])
    keep = {"ret": finite(return_col)} | ({"w": F.coalesce(finite(weight_col), F.lit(0.0))} if weight_col else {})
    rows = assigned(panel, models, n_deciles, keep, ranged).filter("ret IS NOT NULL")
    mean = F.try_divide(F.sum(F.col("w") * F.col("ret")), F.nullif(F.sum("w"), F.lit(0.0))) if weight_col else F.avg("ret")
    deciles = rows.groupBy("date", "model", "decile").agg(mean.alias("ret"))
    ends = [F.max(F.when(F.col("decile") == d, F.col("ret"))) for d in (n_deciles, 1)]
    row = lambda bucket, ret: F.struct(bucket.alias("bucket"), ret.alias("ret"))
    # One pass gives both: a date has n_deciles rows of a model at most, so they and their spread are made together.
    dates = deciles.groupBy("date", "model").agg(F.collect_list(row(F.col("decile").cast("string"), F.col("ret"))).alias("rows"), (ends[0] - ends[1]).alias("spread"))
    return dates.select("date", "model", F.inline(F.concat("rows", F.array(row(F.lit("LS"), F.col("spread"))))))


def compute_decile_portfolio_weights(panel: DataFrame, *, model_cols: Sequence[str] | None = None, weight_col: str | None = None, n_deciles: int = 10, ranged: bool = False) -> DataFrame:
    """Weights that sum to one in each (date, model, decile); only names in the decile have a row.

    With a weight column, names without a weight have no row, and deciles whose weights sum to zero are weighted equally.
    """
    models = model_columns(panel, model_cols, (weight_col,))
    require_columns(panel, [weight_col] if weight_col else [], "weight column")
    rows = assigned(panel, models, n_deciles, {"w": finite(weight_col)} if weight_col else {}, ranged)
    w = Window.partitionBy("date", "model", "decile")
    equal = 1.0 / F.count(F.lit(1)).over(w)
    total = F.coalesce(F.sum("w").over(w), F.lit(0.0)) if weight_col else None
    weight = F.when(total == 0, equal).otherwise(F.try_divide(F.col("w"), total)) if weight_col else equal
    out = rows.select("ticker", "date", "model", F.col("decile").cast("string").alias("bucket"), weight.alias("weight"))
    return out.filter("weight IS NOT NULL")


def pivoted(returns: DataFrame, n_deciles: int = 10) -> DataFrame:
    """date, model and a column for each bucket: for display."""
    return returns.groupBy("date", "model").pivot("bucket", [*map(str, range(1, n_deciles + 1)), *SPREADS]).agg(F.first("ret"))


def compute_long_short_returns(decile_returns: DataFrame, *, bottom_decile: int = 1, top_decile: int | None = None, cap: float | None = None) -> DataFrame:
    """(date, model, bucket=long_short, ret) of each model's top less its bottom decile.

    Where a model lacks the decile asked for, its last or first is taken.
    """
    require_columns(decile_returns, ("date", "model", "bucket", "ret"))
    d = decile_returns.withColumn("q", quantile()).filter("q IS NOT NULL")
    of_model = Window.partitionBy("model")  # a row for each date and quantile
    has = lambda k: F.max((F.col("q") == k).cast("int")).over(of_model) == 1
    first, last = F.min("q").over(of_model), F.max("q").over(of_model)
    bottom = F.when(has(bottom_decile), F.lit(bottom_decile)).otherwise(first)
    top = last if top_decile is None else F.when(has(top_decile), F.lit(top_decile)).otherwise(last)
    legs = d.withColumns({"bottom": bottom, "top": top}).groupBy("date", "model").agg((F.max(F.when(F.col("q") == F.col("top"), F.col("ret"))) - F.max(F.when(F.col("q") == F.col("bottom"), F.col("ret")))).alias("ret"))
    ret = F.col("ret") if cap is None else clip("ret", -cap, cap)
    return legs.select("date", "model", F.lit("long_short").alias("bucket"), ret.alias("ret"))


def compute_turnover_from_weights(weights: DataFrame) -> DataFrame:
    """(date, model, bucket, turnover): half the absolute changes of weights since the date before, null on the first.

    Dates are those of the whole frame, so a portfolio that is absent on one counts as sold. Each weight is sent to its own
    date and, negated, to the next; a sum by name gives the change without a join of the frame with itself.
    """
    require_panel(weights, "weights")
    rows = weights.select("ticker", F.to_date("date").alias("date"), "model", "bucket", F.coalesce(finite("weight"), F.lit(0.0)).alias("weight"))
    order = Window.orderBy("date")  # one row for each date
    dates = rows.select("date").distinct().select("date", F.row_number().over(order).alias("idx"))
    placed = rows.join(dates, "date").select("ticker", "model", "bucket", F.inline(F.array(F.struct(F.col("idx"), F.col("weight").alias("change")), F.struct((F.col("idx") + 1).alias("idx"), (-F.col("weight")).alias("change")))))
    moves = placed.groupBy("model", "bucket", "idx", "ticker").agg(F.sum("change").alias("change"))
    traded = moves.groupBy("model", "bucket", "idx").agg((F.sum(F.abs("change")) * 0.5).alias("moved"))
    # A portfolio's dates, of which it has a few hundred, are one list; the list of all dates is one row.
    calendar = dates.agg(F.sort_array(F.collect_list(F.struct("idx", "date"))).alias("calendar"))
    own = traded.groupBy("model", "bucket").agg(F.map_from_entries(F.collect_list(F.struct("idx", "moved"))).alias("moved"))
    every = own.join(F.broadcast(calendar)).select("model", "bucket", "moved", F.inline("calendar"))
    return every.select("date", "model", "bucket", F.when(F.col("idx") > 1, F.coalesce(F.try_element_at("moved", F.col("idx")), F.lit(0.0))).alias("turnover"))
