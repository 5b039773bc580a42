"""Mixing sources to target weights along a curriculum that varies in time.

Each source has a schedule of weight over training time 0..1, piecewise linear. Its integral, scaled to the source's
target, is the source's cumulative token demand. A source's documents follow one another in an order fixed by a digest,
epoch after epoch; the training position of each is where demand reaches the tokens before it. The mix is those
documents sorted by position.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import hot_join, materialise, running_sums


@dataclass(frozen=True)
class Mix:
    """weights: by rank of the source, repeating. share: target of the whole mix by all sizes. most: epochs at most.

    schedules: for each rank (repeating), weights at the equally spaced times of training; only their shape counts.
    rows_per_bucket: about so many documents are summed by one window, or fewer.
    """

    weights: tuple[int, ...] = (5, 2, 1)
    share: tuple[int, int] = (3, 2)
    most: int = 2
    schedules: tuple[tuple[float, ...], ...] = ((1.0, 1.0, 1.0), (0.5, 1.0, 1.5), (1.5, 1.0, 0.5))
    rows_per_bucket: int = 200_000


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^ \\t\\n\\x0B\\f\\r]+")).cast("long")


def source_targets(sources: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """From (source, source_size, rows) those with of (the source as a key that is not null), rank, weight and target.

    Targets are the fixed point of sharing by weight and resharing what lies above a cap. Sources that stop at the cap
    are the first in order of cap by weight, as long as the share of the others at that point reaches the next cap.
    Sources may be many: ranks and sums are running sums over ranges; the driver gets the totals and the level.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    ranked = running_sums(sources.withColumn("of", key), [], ["of"], {"rank": F.lit(1)}, parts, "mix-ranks")
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), (F.pmod("rank", F.lit(len(mix.weights))) + 1).cast("int")).cast("long")
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(mix.most) * F.col("source_size"))
    ranked = ranked.withColumn("fill", F.struct((F.col("source_size") / F.col("weight")).alias("at"), "rank"))
    filled = materialise(running_sums(ranked, [], ["fill"], {"caps_before": F.col("cap"), "weights_before": F.col("weight")}, parts, "mix-fill"), "mix-levels")
    sizes, weights = filled.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0))).first()
    level = (F.lit(sizes * mix.share[0] / mix.share[1]) - F.col("caps_before")) / (F.lit(weights) - F.col("weights_before"))
    reached = filled.withColumn("level", level).filter(F.col("level") * F.col("weight") <= F.col("cap"))
    at = reached.agg(F.min_by("level", "fill")).first()[0]
    target = F.col("cap").cast("double") if at is None else F.least(F.col("cap").cast("double"), F.lit(at) * F.col("weight"))
    return filled.withColumn("target", target).select("of", "source", "source_size", "rows", "rank", "weight", "target")


def _inverse_demand(share: Column, rank: Column, schedules: tuple[tuple[float, ...], ...]) -> Column:
    """Time at which a source's schedule has given this share (0..1) of its target."""
    out = F.lit(None).cast("double")
    for k, weights in enumerate(schedules):
        pieces = len(weights) - 1
        step = 1.0 / pieces
        area = [0.0]
        for a, b in zip(weights, weights[1:], strict=False):
            area.append(area[-1] + (a + b) / 2 * step)
        need = share * F.lit(area[-1])
        time = F.lit(1.0)
        for i in reversed(range(pieces)):
            a, slope = weights[i], (weights[i + 1] - weights[i]) / step
            rest = need - F.lit(area[i])
            root = rest / F.lit(a) if slope == 0 else (F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * rest, F.lit(0.0))) - F.lit(a)) / F.lit(slope)
            time = F.when(need < F.lit(area[i + 1]), F.lit(i * step) + root) if i == pieces - 1 else F.when(need < F.lit(area[i + 1]), F.lit(i * step) + root).otherwise(time)
            if i == pieces - 1:
                time = time.otherwise(F.lit(1.0))
        out = F.when(F.pmod(rank, F.lit(len(schedules))) == k, time).otherwise(out)
    return out


def mixed(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mix: Mix = Mix()) -> DataFrame:
    """One row per row of docs: id, source, size, source_size, target, taken, positions.

    taken: words of the document that the mix takes, over all epochs; a source's sum is its target to the word, for which
    the document at the end of its quota is taken in part. positions: one in 0..1 for each epoch that takes it.
    A source's documents follow one another by the MD5 of their id, then id and size; rows that are equal in these get
    each their share in any order. A null text has size 0; null sources are one source, the last; documents of size 0
    take nothing. Repeated rows each get a row. An empty table gives an empty one. Only the three named columns are read.
    """
    spark = docs.sparkSession
    source = F.col(source_col).cast("string")
    read = docs.select(F.col(id_col).alias("id"), source.alias("source"), word_count(F.col(text_col)).alias("size"))
    key = F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name"))
    text_id = F.coalesce(F.col("id").cast("string"), F.lit(""))
    place = F.struct(F.md5(text_id.cast("binary")).alias("digest"), text_id.alias("text"), "size", F.monotonically_increasing_id().alias("row"))
    sized = materialise(read.select("*", key.alias("of"), place.alias("place")), "mix-sizes")
    sums = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")), "mix-sums")
    plan = materialise(source_targets(sums, mix).drop("source", "weight"), "mix-sources")
    rows = plan.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // mix.rows_per_bucket))
    started = running_sums(sized, ["of"], ["place"], {"start": F.col("size")}, parts, "mix-order")
    placed = hot_join(started, plan, ["of"], "rows")
    start = F.col("start")
    quota = F.round("target").cast("long")
    by_epoch = [F.greatest(F.lit(0), F.least(F.col("size"), quota - (start + F.lit(e) * F.col("source_size")))) for e in range(mix.most)]
    taken = sum(by_epoch[1:], by_epoch[0])
    share = lambda e: F.try_divide(start + F.lit(e) * F.col("source_size"), F.col("target"))
    times = [F.when(x > 0, _inverse_demand(share(e), F.col("rank"), mix.schedules)) for e, x in enumerate(by_epoch)]
    return placed.select(F.col("id").alias(id_col), "source", "size", "source_size", "target", taken.cast("long").alias("taken"), F.array_compact(F.array(*times)).alias("positions"))


def by_position(taken: DataFrame) -> DataFrame:
    """What mixed() takes, range-sorted by training position: a row for each epoch of a document.

    Documents that the mix leaves out have no row, nor has an empty table; repeated rows keep rows of their own, and rows of
    one position stand in any order.
    """
    rows = taken.select("*", F.explode("positions").alias("position")).drop("positions")
    parts = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartitionByRange(parts, "position").sortWithinPartitions("position")


def in_order(taken: DataFrame) -> DataFrame:
    """What mixed() returns, a row for each document, range-sorted by its first training position.

    positions has the later epochs; by_position() gives them rows of their own. Documents that the mix leaves out come
    last, dealt by a hash of their columns, so that they don't meet in one range. Null ids and sources and repeated rows
    stay as they are; rows that are equal in all columns stand in any order; an empty table gives an empty one.
    """
    taken = materialise(taken, "mix-taken")  # the range sort reads it twice
    parts = int(taken.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = F.try_element_at("positions", F.lit(1)).asc_nulls_last()
    tie = F.xxhash64(*[c for c in taken.columns if c != "positions"])
    return taken.repartitionByRange(parts, first, tie).sortWithinPartitions(first, tie)
