"""Sources of daily panels, returns and factors."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.panel import finite
from .panel_csv import SPLIT_BYTES, register, starts_inside

FACTORS = ("MKT", "SMB", "HML", "RF")


def read_symbols(spark: SparkSession, *paths: str, column: str = "Symbol") -> DataFrame:
    """Distinct symbols of metadata files with a header, as ticker."""
    parts = [spark.read.option("header", True).csv(p).select(F.col(column).cast("string").alias("ticker")) for p in paths]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.na.drop().distinct()


def hash_share(column: Column | str, share: float) -> Column:
    """A fixed pseudo-random share of the values of a column, by the MD5 of their text."""
    column = F.col(column) if isinstance(column, str) else column
    return F.conv(F.substring(F.md5(column.cast("string").cast("binary")), 1, 8), 16, 10).cast("long") % 10_000 < round(share * 10_000)


def sample_tickers(df: DataFrame, share: float) -> DataFrame:
    return df.filter(hash_share("ticker", share))


def numbers(text: Column) -> Column:
    """As a finite double, null where it is no number."""
    return finite(text.try_cast("double"))


def read_daily_csv(spark: SparkSession, folder: str, *, columns: Sequence[str] = ("adj_close", "volume"), date_col: str = "date", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Panel from a folder with a CSV file for each ticker, named after it: ticker, date, columns.

    Every file is read by its own header, whatever the number and order of its columns; a column it lacks is null. Rows
    without a date are dropped, values that are no numbers are null. A file that is no CSV, or has no dates, gives no rows
    (scan_files tells which). Small files share tasks, files of more than split_bytes are read by several; cells may hold
    line breaks. Filters on ticker and date are pushed into the scan.
    """
    wanted = list(dict.fromkeys(columns))
    inside = starts_inside(spark, folder, split_bytes)
    source = spark.read.format("panelcsv").option("path", folder).option("columns", json.dumps(wanted)).option("date_col", date_col).option("split_bytes", split_bytes).option("inside", json.dumps(inside))
    return source.load().select("ticker", "date", *(numbers(F.trim(F.col(f"`{c}`"))).alias(c) for c in wanted))


def write_daily_csv(daily: DataFrame, folder: str) -> None:
    """A CSV file for each ticker, named after it, with its rows by date: what read_daily_csv reads. Files of tickers that
    are there already are replaced; rows without ticker are an error."""
    spark = daily.sparkSession
    register(spark)
    columns = ["date", *(c for c in daily.columns if c not in ("ticker", "date"))]
    rows = daily.select("ticker", *columns).select(*(F.col(f"`{c}`").cast("string").alias(c) for c in ("ticker", *columns)))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.repartition(parts, "ticker").sortWithinPartitions("ticker", "date").write.format("panelcsv").mode("append").option("path", folder).save()


def scan_files(spark: SparkSession, folder: str, *, price_col: str = "adj_close", date_col: str = "date", split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A row for each file: ticker, bytes, n_rows (with a date), n_usable (with a price too), problem (null: none)."""
    inside = starts_inside(spark, folder, split_bytes)
    source = spark.read.format("panelcsv").option("path", folder).option("kind", "files").option("columns", json.dumps([price_col])).option("date_col", date_col).option("split_bytes", split_bytes).option("inside", json.dumps(inside))
    sums = source.load().groupBy("ticker").agg(F.max("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows"), F.sum("n_usable").alias("n_usable"), F.max("problem").alias("problem"))
    return sums.withColumn("problem", F.coalesce("problem", F.when(F.col("n_rows") == 0, F.lit("no dates")).when(F.col("n_usable") == 0, F.lit("no prices"))))


def scan_report(spark: SparkSession, folder: str, tickers: DataFrame, *, price_col: str = "adj_close", date_col: str = "date") -> DataFrame:
    """One row, files, read, missing, bad: of tickers those whose file gives rows, does not exist or is empty, or has no usable row."""
    files = scan_files(spark, folder, price_col=price_col, date_col=date_col).filter("bytes > 0").select("ticker", (F.col("n_usable") > 0).alias("good"))
    every = tickers.select("ticker").join(files, "ticker", "left")
    return every.agg(F.count(F.lit(1)).alias("files"), F.count_if("good").alias("read"), F.count_if(F.col("good").isNull()).alias("missing"), F.count_if(~F.col("good")).alias("bad"))


def tail_rows(daily: DataFrame, n: int) -> DataFrame:
    """The last n rows of each ticker."""
    place = F.row_number().over(Window.partitionBy("ticker").orderBy(F.col("date").desc()))
    return daily.withColumn("place", place).filter(F.col("place") <= n).drop("place")


def read_factors(spark: SparkSession, path: str, *, columns: Sequence[str] = FACTORS, date_col: str = "date", scale: float = 1.0) -> DataFrame:
    """date and factor returns times scale (0.01 for percentages), by date."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.expr(f"try_cast(`{date_col}` AS DATE)").alias("date"), *((numbers(F.col(c)) * scale).alias(c) for c in columns)).filter("date IS NOT NULL").orderBy("date")


#: What a written table consists of; readers of Spark skip it for its first letter.
MANIFEST = "_manifest.json"


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), at


def write_csv(df: DataFrame, path: str, *, single: bool = False) -> None:
    """With a header; single puts a small table into one file. The table at path is replaced as a whole or not at all.

    Rows are written beside it, with a manifest of the files and their sizes as the last of them. Only then does the new
    version take the place of the old one, which waits under another name meanwhile: a run that ends in between leaves
    either, and the next run clears up. Runs of the same frame leave the same table.
    """
    spark, path = df.sparkSession, str(path).rstrip("/")
    fresh, old = f"{path}.new-{uuid.uuid4().hex}", f"{path}.old"
    system, at = _file_system(spark, path)
    of = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    if system.exists(of(old)):  # an earlier run ended between its renames
        if system.exists(at):
            system.delete(of(old), True)
        else:
            system.rename(of(old), at)
    try:
        (df.coalesce(1) if single else df).write.option("header", True).csv(fresh)
        files = {f.getPath().getName(): f.getLen() for f in system.listStatus(of(fresh)) if f.getPath().getName().startswith("part-")}
        out = system.create(of(f"{fresh}/{MANIFEST}"), True)
        out.write(bytearray(json.dumps({"columns": df.columns, "files": files}, sort_keys=True).encode()))
        out.close()
        if system.exists(at):
            system.rename(at, of(old))
        if not system.rename(of(fresh), at):
            raise OSError(f"{path} could not be put in place")
    except BaseException:
        if not system.exists(at) and system.exists(of(old)):
            system.rename(of(old), at)
        system.delete(of(fresh), True)
        raise
    system.delete(of(old), True)


def written_csv(spark: SparkSession, path: str) -> DataFrame:
    """What write_csv wrote, as text; ValueError where files of its manifest are missing or have another size."""
    system, at = _file_system(spark, str(path))
    manifest = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{MANIFEST}")
    told = None
    if system.exists(manifest):
        stream = system.open(manifest)
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    there = {f.getPath().getName(): f.getLen() for f in system.listStatus(at)}
    if told is None or any(there.get(n) != size for n, size in told["files"].items()):
        raise ValueError(f"{path} is no whole table")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in told["columns"]])
    return spark.read.schema(schema).option("header", True).csv([f"{path}/{n}" for n in sorted(told["files"])]) if told["files"] else spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Adapter:
    """Panels over the order tables: a supplier is a ticker, its mean price of a day the close."""

    folder: str

    def daily(self, spark: SparkSession) -> DataFrame:
        lines = spark.read.parquet(f"{self.folder}/lineitem.parquet")
        price = (100 + F.avg(F.col("l_extendedprice").cast("double")) / 1000).alias("adj_close")
        return lines.groupBy(F.col("l_suppkey").alias("ticker"), F.to_date("l_shipdate").alias("date")).agg(price, F.sum(F.col("l_quantity").cast("double")).alias("volume"))

    def user_days(self, spark: SparkSession) -> DataFrame:
        """A second, short panel: a user is a ticker."""
        events = spark.read.parquet(f"{self.folder}/events.parquet")
        return events.groupBy(F.col("user_id").alias("ticker"), F.to_date("ts").alias("date")).agg(F.sum(F.col("value").cast("double")).alias("value"), F.count(F.lit(1)).alias("n"))


def factors_from_panel(returns: DataFrame, features: DataFrame | None = None, *, risk_free: float = 0.002, return_col: str = "RET") -> DataFrame:
    """Factor series of a panel: the mean return, and differences of means of its halves by volatility and by value.

    Without features, returns has volatility and value itself.
    """
    both = returns.select("date", return_col, "volatility", "value") if features is None else returns.select("ticker", "date", return_col).join(features.select("ticker", "date", "volatility", "value"), ["ticker", "date"], "left")
    w = Window.partitionBy("date")
    cut = both.withColumns({f"mid_{c}": F.median(c).over(w) for c in ("volatility", "value")})
    mean = lambda side: F.avg(F.when(side, F.col(return_col)))
    return cut.groupBy("date").agg(
        F.avg(return_col).alias("MKT"),
        F.coalesce(mean(F.col("volatility") < F.col("mid_volatility")) - mean(F.col("volatility") > F.col("mid_volatility")), F.lit(0.0)).alias("SMB"),
        F.coalesce(mean(F.col("value") > F.col("mid_value")) - mean(F.col("value") < F.col("mid_value")), F.lit(0.0)).alias("HML"),
        F.lit(risk_free).alias("RF"),
    )


PANEL_SCHEMA = T.StructType([T.StructField("ticker", T.StringType()), T.StructField("date", T.DateType()), T.StructField("adj_close", T.DoubleType()), T.StructField("volume", T.DoubleType())])
