"""Frames that are written once: what is built on them is not computed again, whatever executors are lost."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Used where the session names no checkpoint folder and driver and executors are one machine, as in tests.
ONE_MACHINE = "file:///tmp/checkpoints/panelwright-panels"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; unset, a local one on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: name a folder there that driver and executors share")
    return ONE_MACHINE


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Delete what stands at path when the driver's process ends."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).deleteOnExit(at)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back; the files go when the driver's process ends."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def stored_by_ticker(df: DataFrame, name: str) -> DataFrame:
    """As stored, dealt into buckets by ticker and sorted by date in each: windows and groups by ticker need no shuffle.

    The table stands in the session's catalogue under a name of its own, its files in the shared folder.
    """
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{table}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by ticker before, so that a bucket is one file and stays sorted.
    df.repartition(buckets, "ticker").write.bucketBy(buckets, "ticker").sortBy("ticker", "date").option("path", path).saveAsTable(table)
    gone_at_exit(spark, path)
    return spark.table(table)
