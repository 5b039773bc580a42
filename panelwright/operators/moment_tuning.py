"""Choice among models that are fitted on moments, without sending rows to the windows they are in.

A window's and its splits' models come of the moments of their dates; each date's section meets the models that it is held
out for and gives what their scores are summed from. Rows are dealt by date once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .linear import WindowConfig, known, moments, moments_of, spread_over_tasks
from .moments import Moments

_FITS = "at int, at_date date, split int, option int, date date, b array<double>, model binary"


def _merged(each: Moments, at: Sequence[int]) -> Moments:
    """Moments over some places, merged pairwise."""
    parts = [each.take(np.array([i])) for i in at]
    while len(parts) > 1:
        parts = [a.merged(b) for a, b in zip(parts[::2], parts[1::2])] + parts[len(parts) // 2 * 2 :]
    return parts[0]


def window_models(by_date: DataFrame, many: int, cfg: WindowConfig, cv_folds: int, factories: Sequence[Callable], splits_of: Callable[[int, int], list[tuple[range, range]]]) -> DataFrame:
    """_FITS: for each window, each of its splits and each option a row for each date that is held out, with the coefficients,
    and one of split -1 with the model of the whole window. by_date has a row for each date of the panel."""

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        each, dates = moments_of(rows, many), rows.column("date").to_pylist()
        out = []
        for at in range(cfg.min_train_months, len(dates)):
            train = [i for i in range(0 if cfg.expanding else max(0, at - cfg.max_train_months), at) if each.n[i] > 0]
            if not train:
                continue
            splits = min(cv_folds, len(train) - 1)
            for option, make in enumerate(factories):
                whole = make().fit_moments(_merged(each, train))
                out.append((at, dates[at], -1, option, None, whole.raw(), cloudpickle.dumps(whole)))
                for k, (before, after) in enumerate(splits_of(len(train), splits) if splits >= 2 else []):
                    if len(before) and len(after):
                        b = make().fit_moments(_merged(each, [train[i] for i in before])).raw()
                        out += [(at, dates[at], k, option, dates[train[i]], b, None) for i in after]
        if out:
            kinds = [pa.int32(), pa.date32(), pa.int32(), pa.int32(), pa.date32(), pa.list_(pa.float64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["at", "at_date", "split", "option", "date", "b", "model"])

    return by_date.repartition(1).sortWithinPartitions("date").mapInArrow(fit, _FITS)


def _ranked(v: np.ndarray) -> np.ndarray:
    return pd.Series(v).rank().to_numpy()


def _held(rows: DataFrame, fits: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """For each model and date that it is held out for what its scores are summed from."""

    def score(section: pa.Table, models: pa.Table) -> pa.Table:
        out = []
        if len(section) and len(models):
            x = np.column_stack([section.column(c).to_numpy() for c in features])
            y = section.column(target).to_numpy()
            ranks = _ranked(y)
            flat = np.ptp(ranks) == 0 or len(y) < 2
            ranks = ranks - ranks.mean()
            for m in models.select(["at", "split", "option", "b"]).to_pylist():
                said = m["b"][0] + x @ np.array(m["b"][1:])
                own = _ranked(said)
                none = flat or np.ptp(own) == 0
                own = own - own.mean()
                error = y - said
                out.append((m["at"], m["split"], m["option"], None if none else float(ranks @ own / np.sqrt((ranks @ ranks) * (own @ own))), len(y), float(error @ error), float(np.abs(error).sum()), float(y.mean()), float(((y - y.mean()) ** 2).sum())))
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64(), *[pa.float64()] * 4]
        names = ["at", "split", "option", "rho", "n", "square", "size", "mean", "spread"]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * len(kinds), kinds, strict=True)], names=names)

    complete = rows.filter(known([*features, target]) & F.col("date").isNotNull()).select("date", *dict.fromkeys([*features, target]))
    asked = fits.filter("split >= 0").select("date", "at", "split", "option", "b")
    schema = "at int, split int, option int, rho double, n long, square double, size double, mean double, spread double"
    return spread_over_tasks(complete, "date").groupBy("date").cogroup(spread_over_tasks(asked, "date").groupBy("date")).applyInArrow(score, schema)


def _score(held: pd.DataFrame) -> tuple[float, float, float]:
    """Mean over splits of the mean rank correlation by month, R2 and absolute error."""
    found = []
    for _, s in held.groupby("split"):
        n, rho = s["n"].sum(), s["rho"].dropna()
        middle = (s["n"] * s["mean"]).sum() / n
        error, spread = s["square"].sum(), (s["spread"] + s["n"] * (s["mean"] - middle) ** 2).sum()
        r2 = -np.inf if n < 2 else 1 - error / spread if spread > 0 else float(error == 0)
        found.append((float(rho.mean()) if len(rho) else -np.inf, float(r2), float(s["size"].sum() / n)))
    return tuple(float(np.mean(c)) for c in zip(*found, strict=True)) if found else (-np.inf, -np.inf, np.inf)


def chosen_models(rows: DataFrame, features: Sequence[str], target: str, cfg: WindowConfig, cv_folds: int, names: Sequence[str], factories: Sequence[Callable], splits_of: Callable, keep: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """at, date, name, spearman, r2, mae, b and model of each window: those of the option with the best scores.

    keep writes a frame that is read more than once.
    """
    many = len(features) + 1
    fits = keep(window_models(moments(rows, features, target), many, cfg, cv_folds, factories, splits_of), "window-models")
    sums = _held(rows, fits, features, target)

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = pdf[pdf["split"] < 0].sort_values("option")
        scores = [_score(pdf[(pdf["split"] >= 0) & (pdf["option"] == k)]) for k in whole["option"]]
        keys = [(s, r, -m) for s, r, m in scores]
        best = max(range(len(keys)), key=lambda i: (keys[i], -i))
        row = whole.iloc[best]
        spearman, r2, mae = scores[best]
        return pd.DataFrame({"at": [row["at"]], "date": [row["at_date"]], "name": [names[row["option"]]], "spearman": [spearman], "r2": [r2], "mae": [mae], "b": [row["b"]], "model": [row["model"]]})

    both = sums.unionByName(fits.filter("split < 0").drop("date"), allowMissingColumns=True)
    return spread_over_tasks(both, "at").groupBy("at").applyInPandas(choose, "at int, date date, name string, spearman double, r2 double, mae double, b array<double>, model binary")
