"""Contracts and expressions of panels keyed by (ticker, date)."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

KEYS = ("ticker", "date")


def require_panel(df: DataFrame, name: str = "panel") -> None:
    if missing := [k for k in KEYS if k not in df.columns]:
        raise ValueError(f"{name} must have the key columns ticker and date; it lacks {', '.join(missing)}")


def one_of(name: str, value: object, allowed: Sequence[object]) -> None:
    if value not in allowed:
        raise ValueError(f"{name} is {value!r}; it can be {', '.join(map(repr, allowed))}")


def window_lengths(least: int, most: int | None) -> None:
    """Lengths of windows in rows: one or more, and the least not above the most, where there is a most."""
    for length in (least, most):
        if length is not None and length < 1:
            raise ValueError(f"a window of {length} rows")
    if most is not None and least > most:
        raise ValueError(f"windows of {least} rows at least and {most} at most")


def require_columns(df: DataFrame, columns: Iterable[str], what: str = "columns") -> None:
    if missing := [c for c in columns if c not in df.columns]:
        raise KeyError(f"missing {what}: {', '.join(missing)}")


def numeric_columns(df: DataFrame, excluding: Iterable[str] = KEYS) -> list[str]:
    skip = set(excluding)
    return [f.name for f in df.schema.fields if f.name not in skip and isinstance(f.dataType, T.NumericType)]


def finite(value: Column | str) -> Column:
    """As a double, null where it is NaN or infinite."""
    x = (F.col(value) if isinstance(value, str) else value).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def with_finite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: finite(c) for c in columns})


def month_end(date: Column | str) -> Column:
    return F.last_day(F.to_date(date))


def clip(value: Column | str, lower: float, upper: float) -> Column:
    """Bounded below and above; null stays null."""
    x = F.col(value) if isinstance(value, str) else value
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(float(lower))), F.lit(float(upper))))


def ticker_rows(first: int | None = None, last: int = 0) -> WindowSpec:
    """Rows of a ticker by date; with first, those from first to last relative to the current row."""
    w = Window.partitionBy("ticker").orderBy("date")
    return w if first is None else w.rowsBetween(first, last)


def rolling(aggregate: Column, counted: Column, rows: int, least: int) -> Column:
    """An aggregate over the last rows of a ticker, null where fewer than least values are counted there."""
    w = ticker_rows(1 - rows)
    return F.when(F.count(counted).over(w) >= least, aggregate.over(w))


def is_after(date: Column | str, start: str | None) -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.lit(True) if start is None else d >= F.to_date(F.lit(str(start)))
