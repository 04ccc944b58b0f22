"""Files in and out: scans by file date, partition pruning, small sinks."""

import gzip

import pytest
from pyspark.sql import functions as F

from barloom.session import scratch_root, settle
from barloom.sources import tables

HEADER = "exchange,symbol,timestamp,local_timestamp,id,side,price,amount\n"


@pytest.fixture
def trade_files(tmp_path):
    for day, gz in (("2024-01-01", False), ("2024-01-02", True), ("2024-01-04", False)):
        text = HEADER + "".join(
            f"ex,BTC,{1704067200000000 + i},{i},t{i},{'buy' if i % 2 else 'sell'},{100 + i}.5,{i}\n" for i in range(3))
        name = tmp_path / f"ex_trades_{day}_BTC.csv"
        if gz:
            with gzip.open(f"{name}.gz", "wt") as f:
                f.write(text)
        else:
            name.write_text(text)
    return str(tmp_path)


def test_scan_takes_dates_from_names(spark, trade_files):
    df = tables.read_events(spark, trade_files, tables.TRADES)
    assert df.count() == 9
    assert tables.on_date(df, "2024-01-02").count() == 3
    assert tables.in_dates(df, "2024-01-02", "2024-01-04").count() == 6
    timed = tables.with_event_time(df)
    assert str(timed.agg(F.min("ts")).first()[0]) == "2024-01-01 00:00:00"


def test_reordered_file_is_refused(spark, trade_files, tmp_path):
    (tmp_path / "ex_trades_2024-01-05_BTC.csv").write_text(HEADER.replace("price,amount", "amount,price") + "ex,BTC,1,1,t,buy,2.0,3.0\n")
    for columns in (["price", "amount"], ["amount"], tables.TRADES.fieldNames()):
        with pytest.raises(Exception, match="(?i)header"):
            tables.read_events(spark, trade_files, tables.TRADES).select(*columns).collect()


def test_scan_reads_only_used_columns(spark, trade_files):
    plan = tables.read_events(spark, trade_files, tables.TRADES).select("price")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<price:double>" in text


def test_partitioned_table_prunes(spark, tmp_path):
    df = spark.range(100).select(
        F.when(F.col("id") % 2 == 0, "A").otherwise("B").alias("symbol"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 4).cast("int")).alias("date"), F.col("id").alias("x"))
    path = str(tmp_path / "table")
    tables.write_partitioned(df, path, ["symbol", "date"])
    back = tables.in_dates(tables.read_partitioned(spark, path).where("symbol = 'A'"), "2024-01-01", "2024-01-02")
    assert back.agg(F.sum("x")).first()[0] == sum(i for i in range(100) if i % 2 == 0 and i % 4 < 2)
    text = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(symbol" in text


def test_small_sinks(spark, tmp_path):
    df = spark.range(3).withColumn("v", F.lit("a"))
    for fmt in ("json", "csv"):
        path = str(tmp_path / fmt)
        tables.write_small(df, path, fmt)
        reader = spark.read.option("header", True)
        assert getattr(reader, fmt)(path).count() == 3


def test_book_columns_round_trip(spark):
    names = [f"{s}[{i}].{f}" for i in range(25) for s in ("asks", "bids") for f in ("price", "amount")]
    row = ("ex", "BTC", 1, 2, *[float(i) for i in range(100)])
    df = spark.createDataFrame([row], tables.BOOK)
    arrays = tables.book_arrays(df).first()
    assert arrays.ask_price[24] == float(names.index("asks[24].price"))
    flat = tables.book_columns(tables.book_arrays(df)).first().asDict()
    assert flat["bid3_size"] == float(names.index("bids[2].amount"))
    assert len(flat) == 102


def test_settle_keeps_rows_and_types(spark):
    df = spark.range(5).select("id", F.array(F.lit(1.5)).alias("a"), F.current_timestamp().alias("t"))
    back = settle(df, "test")
    assert back.dtypes == df.dtypes and back.count() == 5
    assert back.inputFiles()[0].removeprefix("file://").startswith(scratch_root(spark).removeprefix("file:"))


def test_settled_folders_can_be_forgotten(spark, monkeypatch):
    from barloom import session

    monkeypatch.setattr(session, "_WRITTEN", {})
    kept = settle(spark.range(3), "kept")
    folder = kept.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    import os

    assert kept.count() == 3 and os.path.isdir(folder)
    other = settle(spark.range(5), "other")
    assert session.forget(spark, kept) == 1 and not os.path.exists(folder) and other.count() == 5
    assert session.forget(spark) == 1 and session.forget(spark) == 0
