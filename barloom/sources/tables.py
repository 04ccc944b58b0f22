"""Scans, sinks and data audits (IO1-IO7)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = 25

# Fixed column names of the raw event files.
TRADES = T.StructType([
    T.StructField("exchange", T.StringType()), T.StructField("symbol", T.StringType()),
    T.StructField("timestamp", T.LongType()), T.StructField("local_timestamp", T.LongType()),
    T.StructField("id", T.StringType()), T.StructField("side", T.StringType()),
    T.StructField("price", T.DoubleType()), T.StructField("amount", T.DoubleType()),
])
QUOTES = T.StructType([
    T.StructField("exchange", T.StringType()), T.StructField("symbol", T.StringType()),
    T.StructField("timestamp", T.LongType()), T.StructField("local_timestamp", T.LongType()),
    T.StructField("ask_amount", T.DoubleType()), T.StructField("ask_price", T.DoubleType()),
    T.StructField("bid_price", T.DoubleType()), T.StructField("bid_amount", T.DoubleType()),
])
TICKER = T.StructType([
    T.StructField("symbol", T.StringType()), T.StructField("timestamp", T.LongType()),
    T.StructField("funding_timestamp", T.LongType()), T.StructField("funding_rate", T.DoubleType()),
    T.StructField("index_price", T.DoubleType()), T.StructField("mark_price", T.DoubleType()),
])
BOOK = T.StructType(
    [T.StructField("exchange", T.StringType()), T.StructField("symbol", T.StringType()),
     T.StructField("timestamp", T.LongType()), T.StructField("local_timestamp", T.LongType())]
    + [T.StructField(f"{side}[{i}].{field}", T.DoubleType())
       for i in range(LEVELS) for side in ("asks", "bids") for field in ("price", "amount")]
)


def read_events(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """IO1: one CSV (or .csv.gz) or folder of them per day, with the ``date`` taken from its name.

    ``schema`` lists the file's columns in order. A file whose header says
    otherwise is an error, not wrong values. Spark reads only the columns a
    query uses.
    """
    df = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    # The last date of the path: the file's name, or the name of its day's folder.
    return df.withColumn("date", F.to_date(F.regexp_extract("_metadata.file_path", r".*(\d{4}-\d{2}-\d{2})", 1)))


def on_date(df: DataFrame, date: str, column: str = "date") -> DataFrame:
    """IO2: one day; prunes partitions when ``column`` is a partition column."""
    return df.where(F.col(column) == F.lit(date).cast("date"))


def in_dates(df: DataFrame, start: str, end: str, column: str = "date") -> DataFrame:
    """IO3: days from ``start`` to ``end``, both included."""
    return df.where(F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def write_partitioned(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """IO4: columnar sink, one folder per value of the partition columns.

    Rows are spread over several writers per folder where it is large (AQE
    splits the rebalanced partitions by size).
    """
    df.hint("rebalance", *columns).write.mode("overwrite").partitionBy(*columns).parquet(path)


def read_partitioned(spark: SparkSession, path: str) -> DataFrame:
    """IO4: read back what ``write_partitioned`` wrote."""
    return spark.read.parquet(path)


def write_small(df: DataFrame, path: str, fmt: str) -> None:
    """IO5: result tables as JSON or CSV."""
    writer = df.write.mode("overwrite")
    writer.json(path) if fmt == "json" else writer.option("header", True).csv(path)


def with_event_time(df: DataFrame, micros: str = "timestamp", out: str = "ts") -> DataFrame:
    """PR1: epoch microseconds to timestamp."""
    return df.withColumn(out, F.timestamp_micros(F.col(micros))).drop(micros)


def book_arrays(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """PR2: raw level columns to four arrays, best level first."""
    def side(name: str, field: str):
        return F.array(*[F.col(f"`{name}[{i}].{field}`") for i in range(levels)])

    return df.select(
        "symbol", "timestamp",
        side("asks", "price").alias("ask_price"), side("asks", "amount").alias("ask_size"),
        side("bids", "price").alias("bid_price"), side("bids", "amount").alias("bid_size"),
    )


def book_columns(df: DataFrame, levels: int = LEVELS) -> DataFrame:
    """PR2: the four arrays flattened to ``ask1_price`` ... ``bid25_size``."""
    flat = [
        F.get(f"{side}_{field}", F.lit(i)).alias(f"{side}{i + 1}_{field}")
        for i in range(levels) for side in ("ask", "bid") for field in ("price", "size")
    ]
    rest = [c for c in df.columns
            if c not in ("ask_price", "ask_size", "bid_price", "bid_size")]
    return df.select(*rest, *flat)


def ticker_columns(df: DataFrame, *more: str) -> DataFrame:
    """PR3: the six ticker columns later steps use, and any ``more`` (an arrival number, for instance)."""
    return df.select("ts", "symbol", "funding_timestamp", "funding_rate", "index_price", "mark_price", *more)


def missing_days(sources: Mapping[str, DataFrame], start: str, end: str) -> DataFrame:
    """IO6: expected days without any row, per source and symbol.

    Symbols are those seen in any source; each source is reduced to its
    distinct (symbol, day) pairs first.
    """
    seen = None
    for name, df in sources.items():
        part = df.select(
            F.lit(name).alias("source"), "symbol", F.to_date("ts").alias("day")
        ).distinct()
        seen = part if seen is None else seen.unionByName(part)
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    expected = (
        seen.select("symbol").distinct()
        .withColumn("source", F.explode(F.array(*[F.lit(n) for n in sources])))
        .withColumn("day", F.explode(days))
    )
    return expected.join(seen, ["source", "symbol", "day"], "left_anti")


def completeness(df: DataFrame, start: str, end: str, seconds: int) -> DataFrame:
    """IO7: filled buckets per symbol and day against the number expected."""
    filled = (
        df.select("symbol", F.to_date("ts").alias("day"),
                  F.floor(F.unix_seconds("ts") / seconds).alias("b"))
        .distinct().groupBy("symbol", "day").agg(F.count(F.lit(1)).alias("n"))
    )
    days = F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))
    expected = df.select("symbol").distinct().withColumn("day", F.explode(days))
    return expected.join(filled, ["symbol", "day"], "left").select(
        "symbol", "day",
        F.coalesce("n", F.lit(0)).cast("long").alias("n_buckets"),
        F.lit(86400 // seconds).cast("long").alias("n_expected"),
        (F.coalesce("n", F.lit(0)) == 86400 // seconds).alias("complete"),
    )
