"""The written monthly panel: read once from the daily rows, dealt by ticker."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelwright.functions.stored import stored, stored_by_ticker
from panelwright.plans import catalogue

from .frames import random_panel


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_windows_and_groups_by_ticker_need_no_shuffle(spark):
    panel = random_panel(spark, tickers=30)
    table = stored_by_ticker(panel, "t")
    assert sorted(map(tuple, table.collect()), key=str) == sorted(map(tuple, panel.collect()), key=str)
    w = Window.partitionBy("ticker").orderBy("date")
    assert "Exchange" not in plan(table.withColumn("before", F.lag("x0").over(w)).groupBy("ticker").agg(F.sum("before")))
    assert "Exchange" in plan(panel.withColumn("before", F.lag("x0").over(w)))
    assert stored(panel.limit(0), "none").count() == 0


@pytest.mark.parametrize("name", ["perf_summary", "turnover", "modeling_panel", "rolling_ols", "rank_vs_raw"])
def test_daily_rows_are_read_once(spark, name):
    """The daily table is read for the written panel and by nothing else."""
    shown = plan(catalogue.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert "l_extendedprice" not in shown and "monthly_" in shown
    assert "CartesianProduct" not in shown
