"""Sums of products over the cross-validation folds of rolling windows, as one plan without a job of its own.

Folds are consecutive blocks of a window's rows in (ticker, date) order, so their edges differ from window to window. An
edge is one row of one ticker: it is found by counting each ticker's rows in each window, and asks each date of its window
for the sums up to its ticker, which are running sums over the date's rows by ticker. Rows are never repeated for the
windows they are in; there is an ask for each window, fold and date.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .linear import WindowConfig, known
from .solve import pairs, products


def folds_of(upto: np.ndarray, size: int) -> np.ndarray:
    """Symmetric matrices of sums, one for each fold."""
    each = np.diff(upto, axis=0, prepend=0.0)
    whole = np.zeros((len(each), size, size))
    for n, (i, j) in enumerate(pairs(size)):
        whole[:, i, j] = whole[:, j, i] = each[:, n]
    return whole


def _fold_ends(placed: DataFrame, cfg: WindowConfig, cv_folds: int) -> DataFrame:
    """at, first (place of the window's first date), fold, ticker and place of the last row of each fold."""
    back = None if cfg.expanding else cfg.max_train_months
    n = F.col("n_dates")
    have = placed.select("ticker", "place", "n_dates")
    stops = n - 1 if back is None else F.least(n - 1, F.col("newest") + back)
    starts = F.greatest(F.col("oldest") + 1, F.lit(cfg.min_train_months))
    seen = have.groupBy("ticker", "n_dates").agg(F.min("place").alias("oldest"), F.max("place").alias("newest"))
    asked = seen.filter(starts <= stops).select("ticker", F.explode(F.sequence(starts, stops)).alias("place"), F.lit(0).alias("one"))
    train = Window.partitionBy("ticker").orderBy("place").rangeBetween(Window.unboundedPreceding if back is None else -back, -1)
    both = have.select("ticker", "place", F.lit(1).alias("one")).unionByName(asked)
    counted = both.select("ticker", F.col("place").alias("at"), "one", F.sum("one").over(train).alias("c")).filter("one = 0 AND c > 0")
    window = Window.partitionBy("at")
    through = window.orderBy(F.col("ticker").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    sized = counted.select("at", "ticker", "c", F.sum("c").over(through).alias("through"), F.sum("c").over(window).alias("n"))
    k = F.least(F.lit(cv_folds), F.col("n"))
    ends = F.transform(F.sequence(F.lit(1).cast("bigint"), k), lambda f: F.struct(f.alias("fold"), (f * F.floor(F.col("n") / k) + F.least(f, F.col("n") % k) - F.col("through") + F.col("c")).alias("nth")))
    first = F.lit(0) if back is None else F.greatest(F.lit(0), F.col("at") - back)
    inside = sized.select("at", first.alias("first"), "ticker", F.explode(F.filter(ends, lambda e: (e["nth"] > 0) & (e["nth"] <= F.col("c")))).alias("end"))
    own = have.select(F.col("ticker").alias("own_ticker"), "place")
    met = inside.join(own, inside["ticker"].eqNullSafe(own["own_ticker"]) & (F.col("place") >= F.col("first")) & (F.col("place") < F.col("at")))
    nth = F.row_number().over(Window.partitionBy("at", "end.fold").orderBy("place"))
    return met.select("at", "first", F.col("end.fold").alias("fold"), "ticker", "place", "end.nth", nth.alias("rank")).filter("rank = nth").drop("rank", "nth")


def fold_sums(rows: DataFrame, features: Sequence[str], target: str, cfg: WindowConfig, cv_folds: int) -> DataFrame:
    """For each prediction date with complete rows in its window: date; centre, the features' means; and upto, for each
    fold in order the sums of products of (1, features - centre, target) over the window's rows up to its end, as pairs()
    lists them.

    rows are those of model_rows. Windows count all their dates, also those without a complete row. Rows that share ticker
    and date stay in one fold; rows without ticker come last, those without date take no part. Windows of fewer rows than
    folds have a fold a row.
    """
    order = Window.orderBy("date")  # a row for each date
    dates = rows.select("date").distinct().filter("date IS NOT NULL")
    dates = dates.select("date", (F.row_number().over(order) - 1).alias("place"), F.count(F.lit(1)).over(Window.partitionBy()).cast("int").alias("n_dates"))
    placed = rows.filter(known([*features, target])).join(dates, "date")
    means = placed.agg(F.array(*(F.coalesce(F.avg(c), F.lit(0.0)) for c in features)).alias("centre"))  # one row
    names = [f"x_{i}" for i in range(len(features))]
    sums = products(names, "y", F.lit(True))
    near = placed.join(F.broadcast(means)).select("place", "ticker", *((F.col(c) - F.col("centre")[i]).alias(x) for i, (c, x) in enumerate(zip(features, names, strict=True))), F.col(target).alias("y"))
    # Within a ticker: asks that leave out its row of the date, the row, asks that take it in.
    cells = near.select("place", "ticker", F.lit(1).alias("turn"), *(p.alias(s) for s, p in sums.items()))
    ends = _fold_ends(placed, cfg, cv_folds).select("at", "fold", "ticker", F.col("place").alias("end_place"), F.explode(F.sequence(F.col("first"), F.col("at") - 1)).alias("place"))
    asks = ends.select("at", "fold", "place", "ticker", F.when(F.col("place") <= F.col("end_place"), F.lit(2)).otherwise(F.lit(0)).alias("turn"))
    before = Window.partitionBy("place").orderBy(F.col("ticker").asc_nulls_last(), "turn").rowsBetween(Window.unboundedPreceding, 0)
    read = asks.unionByName(cells, allowMissingColumns=True).select("at", "fold", *(F.coalesce(F.sum(s).over(before), F.lit(0.0)).alias(s) for s in sums)).filter("at IS NOT NULL")
    upto = read.groupBy("at", "fold").agg(F.array(*(F.sum(s) for s in sums)).alias("sums"))
    whole = upto.groupBy("at").agg(F.transform(F.sort_array(F.collect_list(F.struct("fold", "sums"))), lambda f: f["sums"]).alias("upto"))
    return whole.join(dates.select(F.col("place").alias("at"), "date"), "at").join(F.broadcast(means)).select("date", "centre", "upto")
