"""Queries that run the live operators over a table read as a stream (ST)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import r6, report, table, with_views
from barloom.streaming.live import drain, live_bars, live_first


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return source.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_id").alias("id"), F.col("value").alias("price"),
        (1 + F.col("user_id") % 10).cast("double").alias("amount"))


def bars(spark, sf):
    return report(drain(live_bars(_stream(spark, sf), "1 hour", "2 hours"), "bars"))


SQL_BARS = with_views(
    ["fx_sparse"], late="select max(ts) - interval 2 hour mark from fx_trades",
) + f"""
SELECT symbol, epoch_us(bucket) bucket, {r6('"open"', 'high', 'low', '"close"', 'volume', 'tradeval', 'vwap')}, ntrade
FROM fx_sparse, late WHERE bucket + interval 1 hour <= mark"""


def first(spark, sf):
    """First trade of each symbol and hour in event time, with its payload, from files in any order."""
    rows = _stream(spark, sf).withColumn("hour", F.date_trunc("hour", "ts"))
    return report(drain(live_first(rows, ["symbol", "hour"], 7200), "first"))


SQL_FIRST = with_views(
    ["fx_trades"], late="select max(ts) - interval 2 hour mark from fx_trades",
    f="""select symbol, ts, id, price, amount, date_trunc('hour', ts) "hour" from fx_trades
        qualify row_number() over (partition by symbol, date_trunc('hour', ts) order by ts, id) = 1""",
) + f"""
SELECT symbol, epoch_us(ts) ts, id, {r6('price', 'amount')}, epoch_us("hour") "hour" FROM f, late WHERE ts < mark"""

QUERIES = {"live_bars": (bars, SQL_BARS), "live_first_quotes": (first, SQL_FIRST)}
