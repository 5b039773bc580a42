"""Tests of differences in Sharpe ratios and in forecast losses."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.panel import finite, one_of, require_columns, require_panel, window_lengths
from .performance import sharpe_ratio


def normal_p_value(z: Column) -> Column:
    """2 (1 - Phi(|z|)); null for null. Only for tables with a row for each test."""

    @F.pandas_udf(T.DoubleType())
    def two_sided(v: pd.Series) -> pd.Series:
        return v.map(lambda x: None if x is None or math.isnan(x) else math.erfc(abs(x) / math.sqrt(2)))

    return F.when(z.isNotNull(), two_sided(z))


def paired(returns: DataFrame, models: Sequence[str], value: str = "ret") -> DataFrame:
    """(date, model_1, model_2, a, b) of dates on which both models of a pair have a value, pairs in the order of models."""
    require_columns(returns, ("date", "model", value))
    rank = F.array_position(F.array(*map(F.lit, models)), F.col("model"))
    rows = returns.select(F.to_date("date").alias("date"), "model", finite(value).alias("x"), rank.alias("r")).filter("x IS NOT NULL AND r > 0")
    # A date has a row for each of the models, so its pairs are made from one list, without joining returns to themselves.
    dates = rows.groupBy("date").agg(F.collect_list(F.struct("model", "x", "r")).alias("all"))
    pairs = dates.select("date", "all", F.explode("all").alias("l")).select("date", "l", F.explode("all").alias("m")).filter("l.r < m.r")
    return pairs.select("date", F.col("l.model").alias("model_1"), F.col("m.model").alias("model_2"), F.col("l.x").alias("a"), F.col("m.x").alias("b"))


def sharpe_tests(returns: DataFrame, models: Sequence[str], *, risk_free_rate: float = 0.0, periods_per_year: int = 12, memmel_correction: bool = True) -> DataFrame:
    """A row for each pair of models: sharpe_1, sharpe_2, sharpe_diff, jk_stat, p_value, periods.

    returns: date, model, ret. Yearly ratios enter the variance as they are.
    """
    both = paired(returns, models)
    n = F.count(F.lit(1))
    ratio = lambda c: F.when(n >= 2, sharpe_ratio(F.avg(c), F.stddev_samp(c), risk_free_rate, periods_per_year))
    spread = F.nullif(F.stddev_samp("a") * F.stddev_samp("b"), F.lit(0.0))
    made = both.groupBy("model_1", "model_2").agg(ratio("a").alias("sharpe_1"), ratio("b").alias("sharpe_2"), F.when(n >= 2, F.try_divide(F.covar_samp("a", "b"), spread)).alias("rho"), n.alias("periods"))
    pairs = both.sparkSession.createDataFrame(list(combinations(models, 2)) or [], "model_1 string, model_2 string")
    s1, s2, rho, m = F.col("sharpe_1"), F.col("sharpe_2"), F.col("rho"), F.col("periods")
    variance = (2 * (1 - rho) * s1 * s2 + 0.5 * (s1 * s1 + s2 * s2)) / m
    if memmel_correction:
        variance = variance - F.try_divide((s1 - s2) * (s1 - s2), 2 * (m - 1))
    stat = F.when(F.col("v") > 0, (s1 - s2) / F.sqrt("v"))
    out = pairs.join(made, ["model_1", "model_2"], "left").withColumn("v", variance).withColumn("jk_stat", stat)
    return out.select("model_1", "model_2", "sharpe_1", "sharpe_2", (s1 - s2).alias("sharpe_diff"), "jk_stat", normal_p_value(F.col("jk_stat")).alias("p_value"), F.coalesce("periods", F.lit(0)).alias("periods"))


def _require_models(returns: DataFrame, *models: str) -> None:
    there = {r[0] for r in returns.select("model").filter(F.col("model").isin(*models)).distinct().collect()}
    if missing := [m for m in models if m not in there]:
        raise KeyError(f"models without returns: {', '.join(missing)}")


def jobson_korkie_test(returns: DataFrame, *, model_1: str, model_2: str, risk_free_rate: float = 0.0, periods_per_year: int = 12, memmel_correction: bool = True) -> DataFrame:
    """One row of sharpe_tests."""
    _require_models(returns, model_1, model_2)
    return sharpe_tests(returns, [model_1, model_2], risk_free_rate=risk_free_rate, periods_per_year=periods_per_year, memmel_correction=memmel_correction)


def compute_sharpe_significance_table(returns: DataFrame, *, models: Sequence[str] | None = None, risk_free_rate: float = 0.0, periods_per_year: int = 12, memmel_correction: bool = True) -> DataFrame:
    names = list(models) if models is not None else sorted(r[0] for r in returns.select("model").distinct().collect())
    return sharpe_tests(returns, names, risk_free_rate=risk_free_rate, periods_per_year=periods_per_year, memmel_correction=memmel_correction)


#: Draws that a task makes at a time.
DRAWS = 64


def bootstrap_sharpe_ratio_difference(returns: DataFrame, *, model_1: str, model_2: str, n_bootstrap: int = 1000, random_state: int | None = None, risk_free_rate: float = 0.0, periods_per_year: int = 12) -> DataFrame:
    """One row: sharpe_1, sharpe_2, sharpe_diff, bootstrap_mean, bootstrap_std, p_value, periods.

    Dates are drawn anew with the generator's integers(0, n, size=n), a call for each draw. The generator is run through
    once for its states before every DRAWS draws; tasks go on from these, so that the draws are the same however many
    tasks make them.
    """
    _require_models(returns, model_1, model_2)
    rf, scale = risk_free_rate / periods_per_year, math.sqrt(periods_per_year)
    seed = int(np.random.default_rng().integers(1 << 62)) if random_state is None else random_state  # a task that is run again draws alike
    pairs = paired(returns, [model_1, model_2]).groupBy("model_1", "model_2").agg(F.sort_array(F.collect_list(F.struct("date", "a", "b"))).alias("rows"))
    both = pairs.select(F.col("rows.a").alias("a"), F.col("rows.b").alias("b"))  # a value for each date
    chunks = "a array<double>, b array<double>, first int, n int, state string"
    drawn = both.mapInArrow(_states(n_bootstrap, seed), chunks).repartition(max(1, -(-n_bootstrap // DRAWS))).mapInArrow(_draws(rf, scale), "first int, diffs array<double>")
    series = both.select(F.lit(-1).alias("first"), F.lit(None).cast("array<double>").alias("diffs"), "a", "b")
    every = series.unionByName(drawn, allowMissingColumns=True).groupBy(F.lit(1)).agg(F.sort_array(F.collect_list(F.struct("first", "diffs", "a", "b"))).alias("parts"))
    out = every.select("parts").mapInArrow(_bootstrapped(rf, scale), "sharpe_1 double, sharpe_2 double, sharpe_diff double, bootstrap_mean double, bootstrap_std double, p_value double, periods bigint")
    return out.select(*(finite(c).alias(c) for c in out.columns[:-1]), "periods")


def _ratio(x: np.ndarray, rf: float, scale: float) -> float:
    spread = x.std(ddof=1) if len(x) > 1 else float("nan")
    return float("nan") if spread == 0 or np.isnan(spread) else float((x - rf).mean() / spread * scale)


def _states(draws: int, seed: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The series with the generator's state before each range of draws."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rng, rows = np.random.default_rng(seed), []
                for first in range(0, draws, DRAWS) if len(a) else ():
                    n = min(DRAWS, draws - first)
                    rows.append((a, b, first, n, json.dumps(rng.bit_generator.state)))
                    for _ in range(n):
                        rng.integers(0, len(a), size=len(a))
                if rows:
                    doubles = pa.list_(pa.float64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (doubles, doubles, pa.int32(), pa.int32(), pa.string()), strict=True)], names=["a", "b", "first", "n", "state"])

    return run


def _draws(rf: float, scale: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a, b = np.array(row["a"]), np.array(row["b"])
                rng, diffs = np.random.default_rng(), []
                rng.bit_generator.state = json.loads(row["state"])
                for _ in range(row["n"]):
                    at = rng.integers(0, len(a), size=len(a))
                    diffs.append(_ratio(a[at], rf, scale) - _ratio(b[at], rf, scale))
                yield pa.RecordBatch.from_arrays([pa.array([row["first"]], pa.int32()), pa.array([diffs], pa.list_(pa.float64()))], names=["first", "diffs"])

    return run


def _bootstrapped(rf: float, scale: float) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Statistics of the series (the first part) and of what all draws say, in their order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column(0).to_pylist():
                a, b = np.array(parts[0]["a"]), np.array(parts[0]["b"])
                diffs = np.array([d for p in parts[1:] for d in p["diffs"]])
                row = [float("nan")] * 6
                if len(diffs):
                    one, other = _ratio(a, rf, scale), _ratio(b, rf, scale)
                    seen = one - other
                    row = [one, other, seen, diffs.mean(), diffs.std(ddof=1) if len(diffs) > 1 else float("nan"), 2 * min(np.mean(diffs >= seen), np.mean(diffs <= seen))]
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.float64()) for v in row), pa.array([len(a)], pa.int64())], names=["sharpe_1", "sharpe_2", "sharpe_diff", "bootstrap_mean", "bootstrap_std", "p_value", "periods"])

    return run


def newey_west(differences: DataFrame, by: Sequence[str], *, horizon: int = 1, test_mode: bool = False) -> DataFrame:
    """by, mean_loss_diff, variance of that mean, periods, from (by, date, diff): Bartlett weights up to horizon - 1 lags."""
    w = Window.partitionBy(*by)
    u = differences.withColumn("u", F.col("diff") - F.avg("diff").over(w))
    lags = range(1, horizon)
    for k in lags:
        u = u.withColumn(f"u_{k}", F.col("u") * F.lag("u", k).over(w.orderBy("date")))
    n = F.count(F.lit(1))
    most = F.least(F.lit(horizon - 1), n - 1)
    variance = F.sum(F.col("u") * F.col("u")) / n
    for k in lags:
        variance = variance + F.when(most >= k, 2 * (1 - k / (most + 1.0)) * F.coalesce(F.sum(f"u_{k}"), F.lit(0.0)) / n).otherwise(0.0)
    variance = variance / n / (4.0 if test_mode else 1.0)
    return u.groupBy(*by).agg(F.avg("diff").alias("mean_loss_diff"), variance.alias("variance"), n.alias("periods"))


def _pair_differences(models: Sequence[str]) -> Callable[[tuple, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Mean differences of losses by pair from a date's rows (date, known, n, sums), taken up a batch at a time."""
    many, names = len(models), list(models)

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, totals = np.zeros((many, many)), np.zeros((many, many))
        for batch in batches:
            for _, known, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = np.flatnonzero(np.frombuffer(known.encode(), np.uint8) == 49)
                rows[np.ix_(own, own)] += n
                totals[np.ix_(own, own)] += np.array([sums[i] for i in own])[:, None]
        a, b = np.triu_indices(many, 1)
        there = rows[a, b] > 0
        a, b = a[there], b[there]
        diff = (totals[a, b] - totals[b, a]) / rows[a, b]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()] * len(a), pa.date32()), pa.array([names[i] for i in a], pa.string()), pa.array([names[i] for i in b], pa.string()), pa.array(diff)], names=["date", "model_1", "model_2", "diff"])

    return run


def diebold_mariano_test(panel: DataFrame, *, realized_col: str = "realized_return", model_cols: Sequence[str] | None = None, loss: str = "squared_error", horizon: int = 1, test_mode: bool = False) -> DataFrame:
    """A row for each pair of models (by name): dm_stat, p_value, mean_loss_diff, periods.

    Rows count for a pair where both models and the outcome are known. Rows of a date that know the same models are summed
    together, a sum for each model; a date's pairs are then read from these few sums, so that columns grow with the models
    and not with their pairs.
    """
    one_of("loss", loss, ("squared_error", "absolute_error"))
    window_lengths(horizon, None)
    require_panel(panel)
    require_columns(panel, (realized_col,))
    chosen = None if model_cols is None else set(model_cols)
    models = sorted(c for c in panel.columns if c not in ("ticker", "date", realized_col) and (chosen is None or c in chosen))
    pairs = list(combinations(models, 2))
    spark = panel.sparkSession
    names = spark.createDataFrame(pairs, "model_1 string, model_2 string")
    if not pairs:
        return names.select("model_1", "model_2", *(F.lit(None).cast("double").alias(c) for c in ("dm_stat", "p_value", "mean_loss_diff")), F.lit(0).cast("bigint").alias("periods"))
    y = finite(realized_col)
    lost = [(finite(m) - y) * (finite(m) - y) if loss == "squared_error" else F.abs(finite(m) - y) for m in models]
    rows = panel.select(F.to_date("date").alias("date"), *(x.alias(f"l_{i}") for i, x in enumerate(lost)))
    rows = rows.withColumn("known", F.concat(*(F.when(F.col(f"l_{i}").isNull(), F.lit("0")).otherwise(F.lit("1")) for i in range(len(models)))))
    sums = rows.groupBy("date", "known").agg(F.count(F.lit(1)).alias("n"), F.array(*(F.sum(f"l_{i}") for i in range(len(models)))).alias("sums"))
    differences = sums.groupBy("date").applyInArrow(_pair_differences(models), "date date, model_1 string, model_2 string, diff double")
    stats = newey_west(differences, ("model_1", "model_2"), horizon=horizon, test_mode=test_mode)
    out = names.join(stats, ["model_1", "model_2"], "left").withColumn("dm_stat", F.when(F.col("variance") > 0, F.col("mean_loss_diff") / F.sqrt("variance")))
    return out.select("model_1", "model_2", "dm_stat", normal_p_value(F.col("dm_stat")).alias("p_value"), "mean_loss_diff", F.coalesce("periods", F.lit(0)).alias("periods"))


compute_dm_significance_table = diebold_mariano_test
