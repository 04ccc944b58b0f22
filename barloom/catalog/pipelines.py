"""The feature table from raw ticks, end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import HOUR, book, quotes, report, ticker, trades
from barloom.plans.features import FeatureOptions, feature_table


def features(spark, sf):
    """Selected features of the default set (six windows, three horizons, every family, the book); the table itself is
    summarised per feature. The book's snapshots are those of one symbol."""
    options = FeatureOptions(seconds=HOUR, ic_threshold=0.05, quote_order=("ts", "event_id"), ticker_order=("ts", "event_id"))
    snapshots = book(spark, sf).withColumn("symbol", F.lit("click")).drop("book_id")
    made = feature_table(trades(spark, sf), quotes(spark, sf), ticker(spark, sf), snapshots, options)
    rows = made.rows.select(F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").alias("x")) for f in made.features])))
    return report(rows.groupBy("feature").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std")))


QUERIES = {"feature_table": (features, None)}
