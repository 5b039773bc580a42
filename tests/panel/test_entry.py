from __future__ import annotations

from datetime import date

import __spark_entry__ as entry
from panelwright.session import session
from panelwright.streaming.monthly import monthly_stream


def test_names_of_oracles_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_session_reuses_the_active_one(spark):
    assert session() is not None and spark.sql("SELECT 1").count() == 1


def test_stream_keeps_months_current(spark, tmp_path):
    schema = "ticker string, date date, adj_close double, volume double"
    batches = [[("A", date(2020, 1, 2), 1.0, 10.0), ("A", date(2020, 1, 30), 2.0, 20.0)], [("A", date(2020, 2, 3), 3.0, 30.0), ("A", date(2020, 1, 31), 4.0, 60.0)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = monthly_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/daily", f"{tmp_path}/monthly").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        query.awaitTermination(120)
    got = {r.date: (r.price, r.volume) for r in spark.read.parquet(f"{tmp_path}/monthly").collect()}
    assert got == {date(2020, 1, 31): (4.0, 30.0), date(2020, 2, 29): (3.0, 30.0)}
