"""Month-end panels from a stream of daily rows.

The engine is a batch engine; this keeps its monthly input current. Each micro-batch is merged into a table of daily rows,
and months that it touches are computed anew from that table, so late rows are as good as punctual ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.panel import finite, month_end
from ..operators.features import monthly


def month_summary(daily: DataFrame) -> DataFrame:
    """ticker, date (month end), last price, mean volume, without months that have no row."""
    rows = daily.select("ticker", F.to_date("date").alias("date"), finite("adj_close").alias("adj_close"), finite("volume").alias("volume"))
    return monthly(rows).filter("price IS NOT NULL OR volume IS NOT NULL").drop("vol")


def monthly_stream(daily: DataFrame, daily_path: str, monthly_path: str) -> DataStreamWriter:
    """A query (not started) over a stream of ticker, date, adj_close, volume.

    Daily rows go to daily_path by month; each touched month of monthly_path is replaced as a whole (dynamic partition
    overwrite), so a batch that is run twice leaves what one run leaves.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("month", month_end("date")).withColumn("batch", F.lit(batch_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month", "batch").parquet(daily_path)
        months = [r[0] for r in rows.select("month").distinct().collect()]
        if months:
            touched = spark.read.parquet(daily_path).filter(F.col("month").isin(months))
            month_summary(touched).withColumn("month", F.col("date")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(monthly_path)

    return daily.writeStream.outputMode("append").foreachBatch(merge)
