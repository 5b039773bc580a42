"""Rolling factor exposures."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.panel import finite, month_end, one_of, require_columns, require_panel, ticker_rows, window_lengths
from .linear import spread_over_tasks
from .moments import trailing_fits


@dataclass(frozen=True)
class ExposureConfig:
    min_months: int = 36
    max_months: int = 60
    return_col: str = "RET"
    rf_col: str = "RF"
    factor_cols: tuple[str, ...] = ("MKT", "SMB", "HML")

    def __post_init__(self):
        window_lengths(self.min_months, self.max_months)

    @property
    def columns(self) -> tuple[str, ...]:
        return ("alpha_ff3", *(f"beta_{c}" for c in self.factor_cols))


def with_factors(stock_returns: DataFrame, factors: DataFrame, cfg: ExposureConfig) -> DataFrame:
    """Returns with the factors of their month; months without factors keep nulls. Factors are a row a month: Spark
    broadcasts them as long as its own threshold allows."""
    require_panel(stock_returns, "stock_returns")
    require_columns(stock_returns, (cfg.return_col,))
    require_columns(factors, ("date", cfg.rf_col, *cfg.factor_cols))
    returns = stock_returns.select("ticker", month_end("date").alias("date"), finite(cfg.return_col).alias("ret"))
    series = factors.select(month_end("date").alias("date"), finite(cfg.rf_col).alias("rf"), *(finite(c).alias(f"f_{i}") for i, c in enumerate(cfg.factor_cols)))
    return returns.join(series, "date", "left").withColumn("excess", F.col("ret") - F.col("rf"))


def compute_factor_exposures(stock_returns: DataFrame, factors: DataFrame, *, config: ExposureConfig = ExposureConfig(), mode: str = "fast") -> DataFrame:
    """ticker, date, alpha_ff3 and a beta for each factor, estimated on the trailing rows before the date.

    fast: centred moments of blocks of rows, merged to those of each window. exact: least squares on the rows of each
    window, a check of the former. Where factors depend on one another both give the solution of minimum norm.
    """
    one_of("mode", mode, ("fast", "exact"))
    joined = with_factors(stock_returns, factors, config)
    if mode == "fast":
        return _by_moments(joined, config)
    w = ticker_rows()
    estimates = _by_rows(joined, config)
    lagged = estimates.select("ticker", "date", *(F.lag(c).over(w).alias(c) for c in config.columns))
    return lagged.na.drop("all", subset=list(config.columns))


def _by_moments(joined: DataFrame, cfg: ExposureConfig) -> DataFrame:
    names = [*(f"f_{i}" for i in range(len(cfg.factor_cols))), "excess"]
    # The place asks for rows by ticker and date: no shuffle where they are dealt so already.
    rows = joined.select("ticker", "date", *names, F.row_number().over(ticker_rows()).alias("place"))
    schema = T.StructType([joined.schema["ticker"], T.StructField("date", T.DateType()), *(T.StructField(c, T.DoubleType()) for c in cfg.columns)])
    length, least, columns = cfg.max_months, cfg.min_months, cfg.columns
    return rows.mapInArrow(lambda batches: trailing_fits(batches, names, length, least, columns), schema)


def _by_rows(joined: DataFrame, cfg: ExposureConfig) -> DataFrame:
    names, columns = [f"f_{i}" for i in range(len(cfg.factor_cols))], cfg.columns

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date", ignore_index=True)
        data = pdf[["excess", *names]].to_numpy(float)
        complete = ~np.isnan(data).any(axis=1)
        found = []
        for end in range(cfg.min_months, len(pdf) + 1):
            rows = np.arange(max(0, end - cfg.max_months), end)
            rows = rows[complete[rows]]
            if len(rows) >= cfg.min_months:
                design = np.column_stack([np.ones(len(rows)), data[rows, 1:]])
                found.append((end - 1, *np.linalg.lstsq(design, data[rows, 0], rcond=None)[0]))
        at = [f[0] for f in found]
        out = pdf.loc[at, ["ticker", "date"]].reset_index(drop=True)
        for i, c in enumerate(columns):
            out[c] = [f[i + 1] for f in found]
        return out

    schema = ", ".join([f"ticker {joined.schema['ticker'].dataType.simpleString()}", "date date", *(f"`{c}` double" for c in columns)])
    rows = joined.select("ticker", "date", "excess", *names)
    return spread_over_tasks(rows, "ticker").groupBy("ticker").applyInPandas(fit, schema)
