"""The modelling panel: standardised characteristics, loadings and next period's return."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.panel import finite, month_end, numeric_columns, one_of, require_columns, require_panel
from ..functions.xsec import with_percentile_rank, with_zscores, zscore


def next_return(returns: DataFrame, *, return_col: str = "RET", out: str = "next_return") -> DataFrame:
    """ticker, date and the return of the ticker's next row."""
    rows = returns.select("ticker", month_end("date").alias("date"), finite(return_col).alias("ret"))
    return rows.select("ticker", "date", F.lead("ret").over(Window.partitionBy("ticker").orderBy("date")).alias(out))


def standardize_characteristics(characteristics: DataFrame, method: str, *, ranged: bool = False) -> DataFrame:
    """Numeric characteristics within each date: z-scores with 0 for missing values, or percentile ranks.

    ranged: sections are too large for one task each."""
    columns = numeric_columns(characteristics)
    df = characteristics.select("ticker", month_end("date").alias("date"), *(finite(c).alias(c) for c in columns))
    if method == "zscore" and ranged:
        return with_zscores(df, columns)
    if method == "zscore":
        return df.withColumns({c: zscore(c) for c in columns})
    for c in columns:
        df = with_percentile_rank(df, c, f"rank_{c}", ranged=ranged)
    return df.select("ticker", "date", *(F.col(f"rank_{c}").alias(c) for c in columns))


def assemble_modeling_dataset(returns: DataFrame, characteristics: DataFrame, factor_loadings: DataFrame, *, return_col: str = "RET", next_return_col: str = "next_return", standardize: str = "zscore", ranged: bool = False) -> DataFrame:
    """Complete rows of characteristics (standardised over the whole section), loadings and the target.

    ranged: sections are too large for one task each."""
    one_of("standardize", standardize, ("zscore", "rank"))
    for df, name in ((returns, "returns"), (characteristics, "characteristics"), (factor_loadings, "factor_loadings")):
        require_panel(df, name)
    require_columns(returns, (return_col,))
    loads = [c for c in factor_loadings.columns if c not in ("ticker", "date")]
    numeric = set(numeric_columns(factor_loadings))
    loadings = factor_loadings.select("ticker", month_end("date").alias("date"), *(finite(c).alias(c) if c in numeric else F.col(c) for c in loads))
    panel = standardize_characteristics(characteristics, standardize, ranged=ranged).join(loadings, ["ticker", "date"]).join(next_return(returns, return_col=return_col, out=next_return_col), ["ticker", "date"])
    return panel.na.drop("any")
