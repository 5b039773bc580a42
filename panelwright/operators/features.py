"""Monthly characteristics from daily prices and volumes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions.panel import finite, month_end, require_columns, require_panel, rolling, ticker_rows

FEATURES = ("dollar_volume", "value", "momentum", "volatility", "investment", "profitability")


@dataclass(frozen=True)
class FeatureConfig:
    """compounding: "reference" multiplies 2 + r over a window, as the engine that results are compared with does;
    "standard" multiplies 1 + r."""

    price_col: str = "adj_close"
    volume_col: str = "volume"
    return_col: str | None = None
    value_method: str = "moving_average"
    profitability_method: str = "rolling_sharpe"
    volatility_window_days: int = 252
    volatility_min_days: int = 63
    momentum_min_months: int = 6
    value_min_months: int = 6
    reversal_min_months: int = 24
    profitability_min_months: int = 6
    investment_min_months: int = 6
    compounding: str = "reference"

    def __post_init__(self):
        choices = {"value_method": ("moving_average", "long_term_reversal"), "profitability_method": ("rolling_sharpe", "return_over_volatility"), "compounding": ("reference", "standard")}
        for name, allowed in choices.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}")
        if self.volatility_window_days <= 1 or self.volatility_min_days <= 1:
            raise ValueError("volatility windows must be longer than one day")


def simple_return(price: str) -> Column:
    """Change from the row before, null where either price is missing or the former is zero."""
    return F.try_divide(F.col(price), F.lag(price).over(ticker_rows())) - 1


def with_daily_volatility(daily: DataFrame, config: FeatureConfig) -> DataFrame:
    """daily with ret and realized_vol: yearly population volatility over the last rows."""
    given = config.return_col is not None and config.return_col in daily.columns
    df = daily.withColumn("ret", finite(config.return_col) if given else simple_return(config.price_col))
    vol = rolling(F.stddev_pop("ret"), F.col("ret"), config.volatility_window_days, config.volatility_min_days)
    return df.withColumn("realized_vol", vol * F.sqrt(F.lit(252.0)))


def monthly(daily: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """ticker, date (month end), price (last known in the month), volume (mean), vol (last known).

    Months without a row between a ticker's first and last month are there with nulls. They are made from the gap to the
    next month, so that nothing is joined and the partitioning by ticker stays.
    """
    price, volume = config.price_col, config.volume_col
    at = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("date")))
    months = daily.groupBy("ticker", month_end("date").alias("month")).agg(at(price).alias("price"), F.avg(volume).alias("volume"), (at("realized_vol") if "realized_vol" in daily.columns else F.lit(None).cast("double")).alias("vol"))
    begin = F.trunc("month", "MM")
    following = F.lead(begin).over(_rows_by("month"))
    until = F.coalesce(F.add_months(following, -1), begin)
    filled = months.withColumn("until", until).withColumn("m", F.explode(F.sequence(begin, F.col("until"), F.expr("INTERVAL 1 MONTH"))))
    own = F.col("m") == begin
    return filled.select("ticker", F.last_day("m").alias("date"), *(F.when(own, F.col(c)).alias(c) for c in ("price", "volume", "vol")))


def _rows_by(column: str) -> WindowSpec:
    return Window.partitionBy("ticker").orderBy(column)


def compounded(ret: Column, rows: int, least: int, mode: str) -> Column:
    base = F.lit(2.0) if mode == "reference" else F.lit(1.0)
    return rolling(F.product(base + ret), ret, rows, least) - 1


def with_lags(months: DataFrame) -> DataFrame:
    w = ticker_rows()
    df = months.withColumn("mret", simple_return("price"))
    return df.withColumns({f"mret_{k}": F.lag("mret", k).over(w) for k in (1, 2, 13)} | {"volatility": F.lag("vol").over(w)})


def dollar_volume() -> Column:
    traded = F.col("price") * F.col("volume")
    return F.when(traded > 0, F.ln(traded))


def value(config: FeatureConfig) -> Column:
    if config.value_method == "moving_average":
        mean = rolling(F.avg("price"), F.col("price"), 12, config.value_min_months)
        return -F.try_divide(F.col("price"), F.nullif(mean, F.lit(0.0)))
    return -compounded(F.col("mret_13"), 48, config.reversal_min_months, config.compounding)


def momentum(config: FeatureConfig) -> Column:
    return compounded(F.col("mret_2"), 11, config.momentum_min_months, config.compounding)


def log_mean_volume(config: FeatureConfig) -> Column:
    mean = rolling(F.avg("volume"), F.col("volume"), 12, config.investment_min_months)
    return F.when(mean > 0, F.ln(mean))


def profitability(config: FeatureConfig) -> Column:
    ret, least = F.col("mret_1"), config.profitability_min_months
    if config.profitability_method == "rolling_sharpe":
        return F.try_divide(rolling(F.avg(ret), ret, 12, least), F.nullif(rolling(F.stddev_pop(ret), ret, 12, least), F.lit(0.0)))
    return F.try_divide(compounded(ret, 12, least, config.compounding), F.nullif(F.col("volatility"), F.lit(0.0)))


def compute_features(raw: DataFrame, *, config: FeatureConfig | None = None) -> DataFrame:
    """ticker, date (month end) and FEATURES; months without any feature are dropped.

    One shuffle by ticker serves the daily windows, the monthly aggregation and all monthly windows.
    """
    made = _months_with_features(raw, config or FeatureConfig())
    return made.select("ticker", "date", *FEATURES).na.drop("all", subset=list(FEATURES))


def monthly_panel(raw: DataFrame, *, config: FeatureConfig | None = None, return_col: str = "RET", next_col: str = "next_return") -> DataFrame:
    """ticker, date, FEATURES, the month's return and the ticker's next one, for every month; nothing is dropped.

    It holds what compute_features and monthly_returns give, in one pass, so that they need not be joined: return_col is
    null in months that the latter leaves out, and next_col is null there.
    """
    made = _months_with_features(raw, config or FeatureConfig())
    following = F.when(F.col("mret").isNotNull(), F.expr("lead(mret) IGNORE NULLS OVER (PARTITION BY ticker ORDER BY date)"))
    return made.select("ticker", "date", *FEATURES, F.col("mret").alias(return_col), following.alias(next_col))


def _months_with_features(raw: DataFrame, cfg: FeatureConfig) -> DataFrame:
    require_panel(raw, "raw")
    require_columns(raw, (cfg.price_col, cfg.volume_col))
    kept = [cfg.price_col, cfg.volume_col] + ([cfg.return_col] if cfg.return_col in raw.columns else [])
    daily = raw.select("ticker", F.to_date("date").alias("date"), *(finite(c).alias(c) for c in dict.fromkeys(kept)))
    months = with_lags(monthly(with_daily_volatility(daily, cfg), cfg))
    w = ticker_rows()
    made = months.withColumns({"dv": dollar_volume(), "value": value(cfg), "momentum": momentum(cfg), "lv": log_mean_volume(cfg), "profitability": profitability(cfg)})
    return made.withColumns({"dollar_volume": F.lag("dv").over(w), "investment": F.col("lv") - F.lag("lv").over(w)})


def monthly_returns(daily: DataFrame, *, price_col: str = "adj_close", return_col: str = "RET") -> DataFrame:
    """ticker, date (month end) and the simple return on the last price of the month before; months without are dropped."""
    require_panel(daily, "daily")
    require_columns(daily, (price_col,))
    prices = daily.select("ticker", F.to_date("date").alias("date"), finite(price_col).alias("adj_close"), F.lit(None).cast("double").alias("volume"))
    return monthly(prices).withColumn(return_col, simple_return("price")).filter(F.col(return_col).isNotNull()).select("ticker", "date", return_col)
