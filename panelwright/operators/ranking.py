"""Predictions as percentile ranks of their date."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.panel import finite, one_of, require_columns, require_panel
from ..functions.xsec import RANK_METHODS, with_percentile_rank, with_zscores, zscore


@dataclass(frozen=True)
class RankingConfig:
    """ranged: sections are too large for one task each."""

    prediction_col: str = "prediction"
    output_col: str = "prediction_rank"
    basis: str = "return"
    risk_adjust: str | None = None
    volatility_col: str | None = None
    beta_col: str | None = None
    rank_method: str = "average"
    ranged: bool = False

    def __post_init__(self):
        for name, allowed in (("basis", ("return", "zscore")), ("risk_adjust", (None, "volatility", "beta")), ("rank_method", RANK_METHODS)):
            one_of(name, getattr(self, name), allowed)
        if self.risk_adjust and not self.risk_col:
            raise ValueError(f"no column of the {self.risk_adjust} to adjust by")

    @property
    def risk_col(self) -> str | None:
        return {"volatility": self.volatility_col, "beta": self.beta_col}.get(self.risk_adjust)


def convert_predictions_to_rankings(predictions: DataFrame, *, config: RankingConfig | None = None) -> DataFrame:
    """ticker, date and the rank (0..1] of the prediction, divided by a risk measure and z-scored where asked for.

    Rows without a prediction, or with a missing or zero risk measure, are left out.
    """
    cfg = config or RankingConfig()
    require_panel(predictions, "predictions")
    require_columns(predictions, (cfg.prediction_col,), "prediction column")
    score = finite(cfg.prediction_col)
    if cfg.risk_col is not None:
        require_columns(predictions, (cfg.risk_col,), "risk adjustment column")
        score = finite(F.try_divide(score, F.nullif(finite(cfg.risk_col), F.lit(0.0))))
    scored = predictions.select("ticker", F.to_date("date").alias("date"), score.alias("score")).filter("score IS NOT NULL")
    if cfg.basis == "zscore":
        scored = with_zscores(scored, ["score"]) if cfg.ranged else scored.withColumn("score", zscore("score"))
    return with_percentile_rank(scored, "score", cfg.output_col, method=cfg.rank_method, ranged=cfg.ranged).drop("score")
