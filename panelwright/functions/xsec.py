"""Expressions over a cross-section: z-scores, percentile ranks and quantile buckets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .stored import stored

RANK_METHODS = ("average", "min", "max", "first", "dense")


def zscore(value: Column | str, by: Sequence[str] = ("date",)) -> Column:
    """Population z-score within by; 0 for missing values and where there is no dispersion."""
    x = F.col(value) if isinstance(value, str) else value
    w = Window.partitionBy(*by)
    return F.coalesce(F.try_divide(x - F.avg(x).over(w), F.nullif(F.stddev_pop(x).over(w), F.lit(0.0))), F.lit(0.0))


def with_zscores(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("date",)) -> DataFrame:
    """columns of df as zscore() gives them, by a sum for each section and a join, so that no task needs a whole section."""
    stats = df.groupBy(*(F.col(b).alias(f"z_{b}") for b in by)).agg(*(f(c).alias(f"z_{n}_{i}") for i, c in enumerate(columns) for n, f in (("mean", F.avg), ("dev", F.stddev_pop))))
    same = reduce(and_, (F.col(b).eqNullSafe(F.col(f"z_{b}")) for b in by))
    scores = {c: F.coalesce(F.try_divide(F.col(c) - F.col(f"z_mean_{i}"), F.nullif(F.col(f"z_dev_{i}"), F.lit(0.0))), F.lit(0.0)).alias(c) for i, c in enumerate(columns)}
    return df.join(stats, same, "left").select(*(scores.get(c, F.col(c)) for c in df.columns))


#: What a row's place in its section is told by: its number, the least rank of its value, that among distinct values, how
#: many rows share the value; of the section its known values, distinct ones, and how many share its least and its largest.
PLACES = ("p_row", "p_rank", "p_dense", "p_same", "p_n", "p_distinct", "p_least", "p_most")


def with_places(df: DataFrame, value: str, by: Sequence[str], ties: Sequence[str]) -> DataFrame:
    """df with PLACES, by windows: a section is sorted by one task. Rows without a value get any."""
    x, w = F.col(value), Window.partitionBy(*by)
    up = w.orderBy(x.asc_nulls_last())
    placed = df.withColumns({"p_row": F.row_number().over(w.orderBy(x.asc_nulls_last(), *ties)), "p_rank": F.rank().over(up), "p_dense": F.dense_rank().over(up), "p_same": F.count(F.lit(1)).over(Window.partitionBy(*by, value)), "p_n": F.count(x).over(w)})
    known = lambda c: F.when(x.isNotNull(), F.col(c))
    return placed.withColumns({"p_distinct": F.max(known("p_dense")).over(w), "p_least": F.max(F.when(F.col("p_rank") == 1, known("p_same"))).over(w), "p_most": F.max(F.when(F.col("p_rank") + F.col("p_same") - 1 == F.col("p_n"), known("p_same"))).over(w)})


def with_ranged_places(df: DataFrame, value: str, by: Sequence[str], ties: Sequence[str], parts: int | None = None) -> DataFrame:
    """df with PLACES for sections of any size: rows without a value get nulls.

    Rows are sorted into ranges over all sections, which are written, so that they never change. Each piece of a section
    that lies in one range is placed by itself; a directory of the pieces, with the values at their ends, says what lies
    before each and how runs of equal values go on from piece to piece.
    """
    spark, x = df.sparkSession, F.col(value)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [f"k_{i}" for i in range(len(by))]
    known = df.filter(x.isNotNull()).withColumns({k: F.col(b) for k, b in zip(keys, by, strict=True)})
    ranged = stored(known.repartitionByRange(parts, *keys, value, *ties).withColumn("piece", F.spark_partition_id()), "sections")
    of_piece = Window.partitionBy(*keys, "piece")
    up = of_piece.orderBy(value)
    inside = ranged.withColumns({"i_row": F.row_number().over(of_piece.orderBy(value, *ties)), "i_rank": F.rank().over(up), "i_dense": F.dense_rank().over(up), "i_same": F.count(F.lit(1)).over(Window.partitionBy(*keys, "piece", value))})
    # Pieces: as many as ranges and sections together, at most.
    ends = ranged.groupBy(*keys, "piece").agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("first"), F.max(value).alias("last"), F.count_distinct(value).alias("distinct"))
    ends = ends.join(ranged.groupBy(*keys, "piece", value).agg(F.count(F.lit(1)).alias("c")).withColumnsRenamed({k: f"o_{k}" for k in keys} | {"piece": "o_piece", value: "o_value"}), reduce(and_, (F.col(k).eqNullSafe(F.col(f"o_{k}")) for k in keys), (F.col("piece") == F.col("o_piece")) & ((F.col("first") == F.col("o_value")) | (F.col("last") == F.col("o_value"))))).groupBy(*keys, "piece", "n", "first", "last", "distinct").agg(F.max(F.when(F.col("first") == F.col("o_value"), F.col("c"))).alias("n_first"), F.max(F.when(F.col("last") == F.col("o_value"), F.col("c"))).alias("n_last"))
    section = Window.partitionBy(*keys)
    order = section.orderBy("piece")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    goes_on = F.coalesce((F.col("first") == F.lag("last").over(order)).cast("int"), F.lit(0))
    lined = ends.withColumns({"before": F.coalesce(F.sum("n").over(earlier), F.lit(0)), "goes_on": goes_on, "p_n": F.sum("n").over(section)})
    lined = lined.withColumns({"dense_before": F.coalesce(F.sum("distinct").over(earlier), F.lit(0)) - F.sum("goes_on").over(order.rowsBetween(Window.unboundedPreceding, 0)), "p_distinct": F.sum(F.col("distinct") - F.col("goes_on")).over(section)})
    # A value at an end: how many rows have it in all pieces, and how many come before the first of them.
    run = lambda c: Window.partitionBy(*keys, c)
    edges = lined.select(*keys, "piece", F.inline(F.array_distinct(F.array(F.struct(F.col("first").alias("edge"), F.col("n_first").alias("c"), F.col("before").alias("start")), F.struct(F.col("last").alias("edge"), F.col("n_last").alias("c"), (F.col("before") + F.col("n") - F.col("n_last")).alias("start"))))))
    edges = edges.withColumns({"all": F.sum("c").over(run("edge")), "start": F.min("start").over(run("edge"))})
    told = edges.groupBy(*keys, "piece").agg(F.map_from_entries(F.collect_list(F.struct("edge", F.struct("all", "start")))).alias("edges"), F.min_by("all", "edge").alias("low_all"), F.max_by("all", "edge").alias("high_all"))
    told = told.withColumns({"p_least": F.first("low_all").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), "p_most": F.last("high_all").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    names = {c: f"d_{c}" for c in (*keys, "piece")}
    directory = lined.join(told, [*keys, "piece"]) if len(by) == 0 else lined.alias("l").join(told.withColumnsRenamed(names), reduce(and_, (F.col(f"l.{k}").eqNullSafe(F.col(f"d_{k}")) for k in keys), F.col("l.piece") == F.col("d_piece"))).drop(*names.values())
    directory = directory.select(*(F.col(k).alias(f"d_{k}") for k in keys), F.col("piece").alias("d_piece"), "before", "dense_before", "edges", "p_n", "p_distinct", "p_least", "p_most")
    met = inside.join(directory, reduce(and_, (F.col(k).eqNullSafe(F.col(f"d_{k}")) for k in keys), F.col("piece") == F.col("d_piece")))
    edge = F.try_element_at("edges", x)
    places = {
        "p_row": F.col("before") + F.col("i_row"),
        "p_rank": F.coalesce(edge["start"], F.col("before") + F.col("i_rank") - 1) + 1,
        "p_dense": F.col("dense_before") + F.col("i_dense"),
        "p_same": F.coalesce(edge["all"], F.col("i_same")),
    }
    own = [c for c in df.columns]
    out = met.select(*own, *(c.alias(n) for n, c in places.items()), *PLACES[4:])
    return out.unionByName(df.filter(x.isNull()), allowMissingColumns=True)


def with_percentile_rank(df: DataFrame, value: str, out: str, by: Sequence[str] = ("date",), method: str = "average", ties: Sequence[str] = ("ticker",), *, ranged: bool = False) -> DataFrame:
    """df with the rank of value within by, as a share of the number of values (of distinct ones for dense); null for null.

    ranged: for sections that one task cannot sort, see with_ranged_places.
    """
    if method not in RANK_METHODS:
        raise ValueError(f"method must be one of {', '.join(RANK_METHODS)}")
    placed = (with_ranged_places if ranged else with_places)(df, value, by, ties)
    rank, same, n = (F.col(c) for c in ("p_rank", "p_same", "p_n"))
    share = {"average": (rank + (same - 1) / 2) / n, "min": rank / n, "max": (rank + same - 1) / n, "first": F.col("p_row") / n, "dense": F.col("p_dense") / F.col("p_distinct")}[method]
    return placed.withColumn(out, F.when(F.col(value).isNotNull(), share)).drop(*PLACES)


#: Up to so many buckets edges are the rounded quantiles that a percentage scale gives.
MANY_BUCKETS = 10_000


def quantile_edges(buckets: int) -> list[float]:
    """Inner quantiles as shares, computed as a percentage scale is."""
    return [float(p) for p in (np.linspace(0, 1, buckets + 1) * 100 / 100)[1:-1]]


def with_buckets(df: DataFrame, value: str, out: str = "decile", buckets: int = 10, by: Sequence[str] = ("date",), ties: Sequence[str] = ("ticker",), *, ranged: bool = False) -> DataFrame:
    """df with the bucket 1..buckets of each non-null value within by.

    Values are put in order, equal ones by ties, and cut at interpolated quantiles of their places. A section with fewer
    distinct values than buckets is instead cut into equal widths of the average rank; one of a single value lies in the
    middle bucket. ranged: for sections that one task cannot sort, see with_ranged_places.
    """
    if buckets < 1:
        raise ValueError(f"{buckets} buckets")
    placed = (with_ranged_places if ranged else with_places)(df.filter(F.col(value).isNotNull()), value, by, ties)
    row, n = F.col("p_row"), F.col("p_n")
    # Twice the average rank, and what it is for the least and the largest value.
    twice, low, high = 2 * F.col("p_rank") + F.col("p_same") - 1, F.col("p_least") + 1, 2 * n - F.col("p_most") + 1
    if buckets <= 20:
        by_place = sum(((row > 1 + F.lit(p) * (n - 1)).cast("int") for p in quantile_edges(buckets)), F.lit(1))
    elif buckets > MANY_BUCKETS:  # an array of edges would be too long; at an edge this is exact, not rounded
        by_place = F.greatest(F.lit(1), F.ceil((row - 1) * F.lit(buckets) / F.nullif(n - 1, F.lit(0))))
    else:  # the same over an array: deep sums do not plan well
        by_place = F.size(F.filter(F.array(*map(F.lit, quantile_edges(buckets))), lambda p: row > 1 + p * (n - 1))) + 1
    width = F.ceil((twice - low) * buckets / F.nullif(high - low, F.lit(0)))
    by_width = F.when(low == high, F.lit(-(-buckets // 2))).otherwise(F.greatest(F.lit(1), width))
    bucket = F.when(F.col("p_distinct") < buckets, by_width).otherwise(by_place)
    return placed.withColumn(out, bucket.cast("int")).drop(*PLACES)
