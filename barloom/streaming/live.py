"""Live versions of the bar and de-duplication operators (ST1, ST2)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BooleanType, StructField, StructType

from barloom.functions.columns import ratio
from barloom.session import scratch_root


def live_bars(trades: DataFrame, width: str, delay: str) -> DataFrame:
    """ST1: tumbling OHLCV bars of a trade stream.

    A bar is emitted once, when the watermark has passed its end; trades later
    than ``delay`` are dropped. State holds one row per open bar and symbol.
    """
    order = F.struct("ts", "id")
    bars = (
        trades.withWatermark("ts", delay)
        .groupBy(F.window("ts", width).alias("_w"), "symbol")
        .agg(
            F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
            F.max_by("price", order).alias("close"), F.sum("amount").alias("volume"),
            F.sum(F.col("price") * F.col("amount")).alias("tradeval"), F.count(F.lit(1)).alias("ntrade"))
    )
    return bars.select(
        "symbol", F.col("_w.start").alias("bucket"), "open", "high", "low", "close", "volume", "tradeval",
        "ntrade", ratio(F.col("tradeval"), F.col("volume")).alias("vwap"))


class _Earliest(StatefulProcessor):
    """Holds the least row of a key by (event time, tie), emits it when no earlier one can come, and drops later ones."""

    def __init__(self, columns: StructType, time: str, ties: Sequence[str], delay_ms: int):
        self.columns, self.time, self.ties, self.delay_ms = columns, time, list(ties), delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", StructType([*self.columns.fields, StructField("_sent", BooleanType())]))

    def _timer(self, row: Sequence) -> int:
        return int(row[self.columns.names.index(self.time)].timestamp() * 1000) + 1

    def _rank(self, row: Sequence) -> tuple:
        return tuple(row[self.columns.names.index(c)] for c in (self.time, *self.ties))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.best.get()) if self.best.exists() else None
        if held is None or not held[-1]:
            least = held[:-1] if held else None
            for frame in rows:
                for row in frame[self.columns.names].sort_values([self.time, *self.ties]).head(1).itertuples(index=False, name=None):
                    row = tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row)
                    least = row if least is None or self._rank(row) < self._rank(least) else least
            if least is not None and (held is None or least != held[:-1]):
                if held is not None:
                    self.handle.deleteTimer(self._timer(held))
                self.best.update((*least, False))
                self.handle.registerTimer(self._timer(least))
        yield pd.DataFrame(columns=self.columns.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = tuple(self.best.get()) if self.best.exists() else None
        if held is not None and not held[-1]:
            self.best.update((*held[:-1], True))
            self.handle.registerTimer(self._timer(held) + self.delay_ms)
            yield pd.DataFrame([held[:-1]], columns=self.columns.names)
        else:
            self.best.clear()
            yield pd.DataFrame(columns=self.columns.names)

    def close(self) -> None:
        pass


def live_first(quotes: DataFrame, keys: Sequence[str], delay_seconds: int, ts: str = "ts", ties: Sequence[str] = ("id",)) -> DataFrame:
    """ST2: the first row of each key in event time (ties: least ``ties``), whatever the order of arrival.

    A row is emitted with all its columns when the watermark, ``delay_seconds`` behind the latest event, has passed it: no
    earlier one can follow. Rows of the key up to ``delay_seconds`` after it are repeats and dropped. State holds one row
    per key younger than twice the delay.
    """
    quotes.sparkSession.conf.set(
        "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = quotes.schema
    return quotes.withWatermark(ts, f"{delay_seconds} seconds").groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=_Earliest(schema, ts, ties, 1000 * delay_seconds), outputStructType=schema,
        outputMode="append", timeMode="EventTime")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there now, into files, and read them.

    Sink and checkpoint are in the shared scratch folder, so a restarted query
    goes on where it stopped.
    """
    import uuid

    spark = stream.sparkSession
    base = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
        .option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
