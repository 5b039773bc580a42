"""Work that several operators share: lineage cuts in the shared folder, names that don't clash, joins on hot keys."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Used only where the session names no checkpoint folder and driver and executors are one machine, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/panelwright"
#: A key is hot if it has more than one in so many of all rows; there are fewer hot keys than this.
HOT_SHARE = 1000
_SPREAD = 4096


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; unset, a local one on a single machine, and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder there that driver and executors share")
        folder = LOCAL_CHECKPOINTS
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _hadoop(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def exists(spark: SparkSession, path: str) -> bool:
    system, at = _hadoop(spark, path)
    return system.exists(at)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once to the shared folder and read back, and where: later stages and lost executors start from the files.

    The files are removed when the driver's process ends, or before by remove().
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    gone_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


def gone_at_exit(spark: SparkSession, path: str) -> None:
    """Delete what stands at path when the driver's process ends."""
    system, at = _hadoop(spark, path)
    system.deleteOnExit(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete written files that nothing reads any more."""
    system, at = _hadoop(spark, path)
    system.delete(at, True)


def apart(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str], Callable[[DataFrame], DataFrame]]:
    """docs under names that no operator uses, the new name of a column, and the way back to docs' columns."""
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names.__getitem__, lambda df: df.select(*(F.col(new).alias(old) for old, new in names.items()))


def hot_join(left: DataFrame, right: DataFrame, keys: Sequence[str], size: str, *, trim: dict[str, Callable[[Column], Column]] | None = None) -> DataFrame:
    """left joined (left outer) to right, which has one row for each key, and in size the number of left's rows with it.

    A key with more than a thousandth of all rows would send these to one task. There are fewer than a thousand such keys:
    their rows of right are broadcast, and left's rows with them are dealt by row instead. trim: for columns of left what
    they become with a hot key, given right's values, before they are dealt. Null keys join nothing and are dealt by row
    too. right is read three times: pass a written frame. left comes from files, so that a task that is run again deals
    alike. size is not returned.
    """
    total = right.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    values = [c for c in right.columns if c not in (*keys, size)]
    hot = F.col(size) * HOT_SHARE > total
    few = right.filter(hot).select(*(F.col(k).alias(f"hot_{k}") for k in keys), F.struct(F.lit(True).alias("hot_there"), *values).alias("hot_values"))
    many = right.filter(~hot).select(*(F.col(k).alias(f"cold_{k}") for k in keys), F.lit(0).alias("cold_deal"), F.struct(F.lit(True).alias("hot_there"), *values).alias("cold_values"))
    met = left.join(F.broadcast(few), reduce(and_, (F.col(k) == F.col(f"hot_{k}") for k in keys)), "left")
    cold = reduce(and_, (F.col(k).isNotNull() for k in keys)) & F.col("hot_values").isNull()
    for name, less in (trim or {}).items():
        met = met.withColumn(name, F.when(F.col("hot_values").isNull(), F.col(name)).otherwise(less(F.col("hot_values"))))
    # Rows with a hot key look for a partner that does not exist, each in a place of its own.
    met = met.withColumn("deal", F.when(cold, F.lit(0)).otherwise((F.monotonically_increasing_id() % _SPREAD).cast("int") + 1))
    met = met.join(many, reduce(and_, (F.col(k) == F.col(f"cold_{k}") for k in keys)) & (F.col("deal") == F.col("cold_deal")), "left")
    got = F.coalesce("hot_values", "cold_values")
    return met.select(*left.columns, *(got[c].alias(c) for c in values))


def running_sums(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: dict[str, Column], parts: int, name: str) -> DataFrame:
    """df with, for each entry of sums, its sum over the rows before in the group.

    Rows are range-sorted by group and order into parts ranges, so that a group of any size is summed by many tasks: what
    a group has in the ranges before is added to the sums within a range. Groups and orders are not null; rows that are
    equal in both may come in any order, but for one that is unique. The ranges are written, so that they never change.
    """
    ranged = materialise(df.repartitionByRange(parts, *group, *order).withColumn("range_no", F.spark_partition_id()), name)
    before = Window.partitionBy(*group).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*group, "range_no").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    pieces = ranged.groupBy(*group, "range_no").agg(*(F.sum(c).alias(f"piece_{n}") for n, c in sums.items()))
    starts = pieces.select(*(F.col(g).alias(f"of_{g}") for g in group), F.col("range_no").alias("of_range"), *(F.coalesce(F.sum(f"piece_{n}").over(before), F.lit(0)).alias(f"start_{n}") for n in sums))
    same = reduce(and_, (F.col(g) == F.col(f"of_{g}") for g in group), F.col("range_no") == F.col("of_range"))
    inside = ranged.select("*", *(F.coalesce(F.sum(c).over(within), F.lit(0)).alias(f"inside_{n}") for n, c in sums.items()))
    return inside.join(starts, same).select(*df.columns, *((F.col(f"start_{n}") + F.col(f"inside_{n}")).alias(n) for n in sums))
