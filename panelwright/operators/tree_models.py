"""Forests and boosting fitted on the section of each date: trees grown from histograms, see grown_trees."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .grown_trees import Growth, fitted_predictions
from .linear import CrossSectionalModelConfig, finish, known, model_rows, spread_over_tasks

#: Sections of no more names have a bin for each value, so that cuts are those of the values themselves.
SECTION_BINS = 1024


@dataclass(frozen=True)
class RandomForestConfig(CrossSectionalModelConfig):
    """n_jobs is taken and does nothing: Spark deals the work."""

    n_estimators: int = 200
    max_depth: int | None = None
    min_samples_leaf: int = 1
    bootstrap: bool = True
    n_jobs: int = -1
    random_state: int = 0


@dataclass(frozen=True)
class GradientBoostingConfig(CrossSectionalModelConfig):
    """booster only names the library whose defaults these are; one implementation serves both names. n_jobs does nothing."""

    booster: str = "xgboost"
    n_estimators: int = 300
    max_depth: int = 4
    learning_rate: float = 0.05
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    n_jobs: int = -1
    random_state: int = 0


def cross_sectional_predictions(panel: DataFrame, feature_cols: Sequence[str], factory: Callable[[], object], *, target_col: str, config: CrossSectionalModelConfig) -> DataFrame:
    """Each date's model is fitted on its rows with a target and predicts its rows with all features.

    For models of any kind: a date's rows are one group. Forests and boosting don't come this way.
    """
    features, out = list(feature_cols), config.prediction_col

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ticker", ignore_index=True)
        train = pdf[pdf[target_col].notna()]
        if train.empty:
            return pd.DataFrame(columns=["ticker", "date", out])
        model = factory()
        model.fit(train[features].to_numpy(float), train[target_col].to_numpy(float))
        return pdf[["ticker", "date"]].assign(**{out: np.asarray(model.predict(pdf[features].to_numpy(float)), float)})

    rows = model_rows(panel, features, target_col).filter(known(features))
    schema = f"ticker {panel.schema['ticker'].dataType.simpleString()}, date date, `{out}` double"
    return finish(spread_over_tasks(rows, "date").groupBy("date").applyInPandas(fit, schema), config)


def _grown(panel: DataFrame, feature_cols: Sequence[str], target_col: str, config: CrossSectionalModelConfig, how: Growth) -> DataFrame:
    rows = model_rows(panel, feature_cols, target_col).filter(known(feature_cols))
    dates = sorted(r[0] for r in rows.select("date").distinct().collect() if r[0] is not None)  # a row for each month
    own = lambda p: (p, p + 1)
    said = fitted_predictions(rows.filter("date IS NOT NULL"), dates, own, list(feature_cols), target_col, how, config.prediction_col, by_date=True)
    return finish(said, config)


def cross_sectional_random_forest(panel: DataFrame, feature_cols: Sequence[str], *, target_col: str = "next_return", config: RandomForestConfig | None = None) -> DataFrame:
    """Predictions (or ranks) of a forest for each date, fitted on the rows with a target."""
    cfg = config or RandomForestConfig()
    how = Growth(cfg.n_estimators, cfg.max_depth, cfg.min_samples_leaf, None, cfg.bootstrap, seed=cfg.random_state, bins=SECTION_BINS)
    return _grown(panel, feature_cols, target_col, cfg, how)


def cross_sectional_gradient_boosting(panel: DataFrame, feature_cols: Sequence[str], *, target_col: str = "next_return", config: GradientBoostingConfig | None = None) -> DataFrame:
    """Predictions (or ranks) of boosted trees for each date, fitted on the rows with a target."""
    cfg = config or GradientBoostingConfig()
    if cfg.booster not in ("xgboost", "lightgbm"):
        warnings.warn(f"booster {cfg.booster!r} is treated as lightgbm", stacklevel=2)
    how = Growth(cfg.n_estimators, cfg.max_depth, 1, None, False, cfg.learning_rate, cfg.subsample, cfg.colsample_bytree, cfg.random_state, SECTION_BINS)
    return _grown(panel, feature_cols, target_col, cfg, how)
