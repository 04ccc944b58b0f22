"""Queries that write a given table as files of each kind and read them back (IO1, IO4, IO5, PR1, PR9)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barloom.catalog.fixtures import factors, r6, report, trades, with_views
from barloom.operators import dedup
from barloom.session import scratch_root
from barloom.sources import tables


def _folder(spark, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def csv_scan(spark, sf):
    """Trades as one CSV folder per day with epoch times, scanned with a fixed schema."""
    path = _folder(spark, "csv")
    raw = trades(spark, sf).withColumns({
        "exchange": F.lit("x"), "timestamp": F.unix_micros("ts"), "local_timestamp": F.unix_micros("ts") + 7,
        "day": F.date_format("ts", "yyyy-MM-dd")})
    raw.select(*tables.TRADES.fieldNames(), "day").write.option("header", True).partitionBy("day").csv(path)
    read = tables.with_event_time(tables.read_events(spark, path, tables.TRADES))
    return report(read.select("symbol", F.col("id").cast("long").alias("id"), "side", "price", "amount", "local_timestamp",
                              "ts", F.unix_date("date").cast("long").alias("day")))


SQL_CSV = with_views(["fx_trades"]) + f"""
SELECT symbol, id, side, {r6('price', 'amount')}, epoch_us(ts)+7 local_timestamp, epoch_us(ts) ts,
 cast(cast(ts as date) - date '1970-01-01' as bigint) AS day FROM fx_trades"""


def partitioned(spark, sf):
    """Trades in one folder per symbol and day; the scan of three days reads only theirs."""
    path = _folder(spark, "partitioned")
    tables.write_partitioned(trades(spark, sf).withColumn("date", F.to_date("ts")), path, ["symbol", "date"])
    rows = tables.in_dates(tables.read_partitioned(spark, path), "2024-01-10", "2024-01-12")
    return report(rows.select("symbol", "id", "side", "price", "amount", "ts"))


SQL_PARTITIONED = with_views(["fx_trades"]) + f"""
SELECT symbol, id, side, {r6('price', 'amount')}, epoch_us(ts) ts FROM fx_trades
WHERE cast(ts as date) BETWEEN date '2024-01-10' AND date '2024-01-12'"""


def small_sinks(spark, sf):
    """A result table through JSON and through CSV."""
    made = trades(spark, sf).groupBy("symbol", "side").agg(F.count(F.lit(1)).alias("n"), F.max("price").alias("high"))
    found = None
    for fmt in ("json", "csv"):
        path = _folder(spark, fmt)
        tables.write_small(made, path, fmt)
        reader = spark.read.schema(made.schema)
        back = (reader.json(path) if fmt == "json" else reader.option("header", True).csv(path)).withColumn("format", F.lit(fmt))
        found = back if found is None else found.unionByName(back)
    return report(found)


SQL_SMALL = with_views(
    ["fx_trades"], a="select symbol, side, count(*) n, max(price) high from fx_trades group by 1, 2") + f"""
SELECT symbol, side, n, {r6('high')}, format FROM a, (VALUES ('json'), ('csv')) f(format)"""


def moved(spark, sf):
    """Columns with one of them moved to the second place: place, name and sum of each."""
    df = dedup.move_column(factors(spark, sf).drop("label"), "mark_price", 1)
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(c).alias("name"), F.col(c).cast("double").alias("v"))
                      for i, c in enumerate(df.columns)])
    rows = df.select(F.inline(cells)).groupBy("place", "name").agg(F.sum("v").alias("total"))
    return report(rows.withColumn("place", F.col("place").cast("long")))


SQL_MOVED = with_views(
    ["fx_factors"],
    o="select unnest(['vec_id','mark_price','f1','f2','f3','f4','f5','f6','f7','f8','r']) name, unnest(range(11)) place",
    u="unpivot (select vec_id::double vec_id, mark_price, f1, f2, f3, f4, f5, f6, f7, f8, r from fx_factors) on columns(*) into name name value v",
    s="select name, sum(v) total from u group by name",
) + f"\nSELECT place, name, {r6('total')} FROM o JOIN s USING (name)"

QUERIES = {
    "csv_scan": (csv_scan, SQL_CSV),
    "partitioned_round_trip": (partitioned, SQL_PARTITIONED),
    "small_sinks": (small_sinks, SQL_SMALL),
    "moved_column": (moved, SQL_MOVED),
}
