from __future__ import annotations

import calendar
from datetime import date

import numpy as np


def month(i: int, year: int = 2020) -> date:
    y, m = year + i // 12, i % 12 + 1
    return date(y, m, calendar.monthrange(y, m)[1])


def rows(spark, columns: dict, *, tickers: list[str], months: int, extra: str = ""):
    """Ticker-major frame: columns maps a name to a flat list of values."""
    keys = [(t, month(i)) for t in tickers for i in range(months)]
    data = [(*k, *(None if v is None else float(v) for v in vals)) for k, vals in zip(keys, zip(*columns.values(), strict=True), strict=True)]
    return spark.createDataFrame(data, "ticker string, date date, " + ", ".join(f"`{c}` double" for c in columns))


def series(df, column: str) -> dict:
    return {(r["ticker"], r["date"]): r[column] for r in df.collect()}


def random_panel(spark, seed: int = 0, tickers: int = 12, months: int = 20, holes: float = 0.05):
    rng = np.random.default_rng(seed)
    n = tickers * months
    x = rng.normal(size=(n, 3))
    y = x @ [0.5, -0.2, 0.0] + 0.3 * rng.normal(size=n)
    cols = {f"x{i}": [None if rng.random() < holes else v for v in x[:, i]] for i in range(3)}
    cols["next_return"] = [None if rng.random() < holes else v for v in y]
    return rows(spark, cols, tickers=[f"T{i:02d}" for i in range(tickers)], months=months)
