"""Sums of products of design columns, and fitted values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def pairs(k: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(k) for j in range(i, k)]


def products(features: Sequence[str], target: str | Column, where: Column) -> dict[str, Column]:
    """Named products of (1, features, target) for rows that satisfy where; null for others."""
    columns = [F.lit(1.0), *(F.col(c).cast("double") for c in features), (F.col(target) if isinstance(target, str) else target).cast("double")]
    return {f"s_{i}_{j}": F.when(where, columns[i] * columns[j]) for i, j in pairs(len(columns))}


def fitted(coefficients: str | Column, features: Sequence[str]) -> Column:
    b = F.col(coefficients) if isinstance(coefficients, str) else coefficients
    out = b[0]
    for i, c in enumerate(features):
        out = out + b[i + 1] * F.col(c)
    return out
