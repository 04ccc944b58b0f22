"""Resampling ticks, quotes and snapshots to bars on a regular grid (RS1-RS22).

Buckets are left-closed, left-labelled and aligned to midnight UTC.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import bucket, gap_seconds, ratio
from barloom.operators.dedup import first_values
from barloom.operators.ordering import (
    BLOCK,
    GRID_ROWS_PER_BLOCK,
    ROWS_PER_BLOCK,
    Ordered,
    explode_range,
    last_set,
    next_set,
)
from barloom.operators.quantiles import exact_quantiles
from barloom.session import join_per_key, settle

SIDES = ("buy", "sell")

# Bars whose value in an empty bucket is 0; all others are carried forward.
ZERO_WHEN_EMPTY = ("volume", "tradeval", "ntrade", "ntrade_up", "ntrade_down", "ntrade_flat")


def downscale(df: DataFrame, seconds: int, columns: Sequence[str], keys: Sequence[str] = ("symbol",),
              ts: str = "ts", order: Sequence[str] | None = None) -> DataFrame:
    """RS1, RS2, RS3: first non-null value of each column per bucket.

    Applied to bars of a finer grid (``ts="bucket"``) it is the two-level rollup.
    """
    order = list(order or [ts])
    # Renamed first: the output bucket may carry the name of the input time.
    source = df.select(
        *keys, bucket(F.col(ts), seconds).alias("_to"),
        *[F.col(c).alias(f"_o_{c}") for c in order], *[c for c in columns],
    )
    firsts = first_values(source, [*keys, "_to"], [f"_o_{c}" for c in order], columns)
    return firsts.withColumnRenamed("_to", "bucket")


def _ohlc(value: Column, seq: Column, suffix: str = "") -> list[Column]:
    return [
        F.min_by(value, seq).alias(f"open{suffix}"),
        F.max(value).alias(f"high{suffix}"),
        F.min(value).alias(f"low{suffix}"),
        F.max_by(value, seq).alias(f"close{suffix}"),
    ]


def _trade_measures(side: str | None, gap: Column) -> list[Column]:
    """RS7-RS13: the twelve measures, for all trades or one side."""
    suffix = f"_{side}" if side else ""

    def of(value: Column) -> Column:
        return F.when(F.col("side") == side, value) if side else value

    price, amount, move = F.col("price"), F.col("amount"), F.col("_move")
    value = price * amount
    zero = F.lit(0.0)
    return [
        *_ohlc(of(price), of(F.col("_seq")), suffix),
        F.coalesce(F.sum(of(amount)), zero).alias(f"volume{suffix}"),
        F.coalesce(F.sum(of(value)), zero).alias(f"tradeval{suffix}"),
        F.count(of(F.lit(1))).alias(f"ntrade{suffix}"),
        ratio(F.sum(of(value)), F.sum(of(amount))).alias(f"vwap{suffix}"),
        F.avg(of(price)).alias(f"awap{suffix}"),
        ratio(F.sum(of(price * gap)), F.sum(of(gap))).alias(f"twap{suffix}"),
        F.count_if(of(move > 0)).alias(f"ntrade_up{suffix}"),
        F.count_if(of(move < 0)).alias(f"ntrade_down{suffix}"),
        F.count_if(of(move == 0)).alias(f"ntrade_flat{suffix}"),
    ]


def trade_bars(trades: DataFrame, seconds: int, by_side: bool = False,
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """RS7-RS13: OHLC, volume, value, count, vwap, awap, twap and tick directions.

    One ordered pass finds the previous trade of each row, one map-side
    combined aggregate makes the bars. The time gap and the price move look at
    the previous trade of the symbol, also across bucket edges; the gap of a
    side's twap looks only at that side's trades in the same bucket.
    """
    columns = ["symbol", "ts", "id", "price", "amount"] + (["side"] if by_side else [])
    series = Ordered.on_events(trades.select(*columns), ["symbol"], ["ts", "id"], rows_per_block)
    series = series.on(series.df.withColumn("_seq", series.rank_in_block()))
    before = {
        "_prev": last_set(F.struct("ts", "price"), strict=True),
    }
    if by_side:
        for side in SIDES:
            own = F.when(F.col("side") == side, F.col("ts"))
            before[f"_prev_{side}"] = last_set(own, strict=True)
    ticks = series.running(**before).done()
    ticks = ticks.withColumns({
        "bucket": bucket(F.col("ts"), seconds),
        "_move": F.col("price") - F.col("_prev.price"),
    })
    measures = _trade_measures(None, gap_seconds(F.col("ts"), F.col("_prev.ts")))
    for side in SIDES if by_side else ():
        previous = F.col(f"_prev_{side}")
        same = bucket(previous, seconds) == F.col("bucket")
        measures += _trade_measures(side, F.when(same, gap_seconds(F.col("ts"), previous)))
    return ticks.groupBy("symbol", "bucket").agg(*measures)


def quote_indicators(quotes: DataFrame) -> DataFrame:
    """RS18: nine per-quote indicators, each under its own name."""
    bid, ask = F.col("bid_price"), F.col("ask_price")
    bid_size, ask_size = F.col("bid_amount"), F.col("ask_amount")
    depth = bid_size + ask_size
    return quotes.withColumns({
        "spread": ask - bid,
        "mid": (ask + bid) / 2,
        "imblance_volume": ratio(bid_size - ask_size, depth),
        "makav_rev": ratio(ask_size * ask + bid_size * bid, depth),
        "makav_ori": ratio(ask_size * bid + bid_size * ask, depth),
        "bid": bid,
        "bidsize": bid_size,
        "ask": ask,
        "asksize": ask_size,
    })


# Fixed names of the indicators, also the suffixes of their bar columns.
QUOTE_INDICATORS = (
    "spread", "mid", "imblance_volume", "makav_rev", "makav_ori", "bid", "bidsize", "ask", "asksize",
)


def _quote_counts() -> list[Column]:
    """RS14-RS17: how often each side moved against the previous quote of the bucket."""
    old = F.col("_old")
    counts = [F.count(F.lit(1)).alias("nquote")]
    for label, column in (("bid", "bid_price"), ("ask", "ask_price"),
                          ("bidsize", "bid_amount"), ("asksize", "ask_amount")):
        now, was = F.col(column), old[column]
        counts += [
            F.count_if(was.isNull() | (now != was)).alias(f"nquote_{label}"),
            F.count_if(now > was).alias(f"nquote_{label}_up"),
            F.count_if(now < was).alias(f"nquote_{label}_down"),
        ]
    for label, column, other, still in (("bid", "bid_price", "ask_price", "askflat"),
                                        ("ask", "ask_price", "bid_price", "bidflat")):
        now, was = F.col(column), old[column]
        flat = F.col(other) == old[other]
        counts += [
            F.count_if((now != was) & flat).alias(f"nquote_{label}_{still}"),
            F.count_if((now > was) & flat).alias(f"nquote_{label}up_{still}"),
            F.count_if((now < was) & flat).alias(f"nquote_{label}down_{still}"),
        ]
    return counts


def quote_bars(quotes: DataFrame, seconds: int, order: Sequence[str] = ("ts",),
               counts: bool = True, ohlc: bool = True,
               rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """RS14-RS19: quote change counts and OHLC/twap/awap of nine indicators.

    Both come from one ordered pass and one aggregate.
    """
    fields = ["bid_price", "ask_price", "bid_amount", "ask_amount"]
    columns = dict.fromkeys(["symbol", *order, "ts", *fields])
    series = Ordered.on_events(quotes.select(*columns), ["symbol"], order, rows_per_block)
    series = series.on(series.df.withColumn("_seq", series.rank_in_block()))
    ticks = series.running(_prev=last_set(F.struct("ts", *fields), strict=True)).done()
    ticks = ticks.withColumn("bucket", bucket(F.col("ts"), seconds))
    same = bucket(F.col("_prev.ts"), seconds) == F.col("bucket")
    ticks = ticks.withColumn("_old", F.when(same, F.col("_prev")))
    measures = _quote_counts() if counts else []
    if ohlc:
        ticks = quote_indicators(ticks)
        gap = gap_seconds(F.col("ts"), F.col("_prev.ts"))
        for name in QUOTE_INDICATORS:
            value = F.col(name)
            measures += [
                *_ohlc(value, F.col("_seq"), f"_{name}"),
                ratio(F.sum(value * gap), F.sum(gap)).alias(f"twap_{name}"),
                F.avg(value).alias(f"awap_{name}"),
            ]
    return ticks.groupBy("symbol", "bucket").agg(*measures)


def grid(bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",), ts: str = "bucket",
         rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """Every grid point between the first and last bar of each key.

    Points are made block by block, so a long series is spread over tasks.
    """
    index = F.floor(F.unix_seconds(F.col(ts)) / seconds)
    size = F.lit(rows_per_block)
    spans = bars.groupBy(*keys).agg(F.min(index).alias("_lo"), F.max(index).alias("_hi"))
    blocks = spans.withColumn(
        BLOCK, F.explode(F.sequence(F.floor(F.col("_lo") / size), F.floor(F.col("_hi") / size)))
    ).repartition(*keys, BLOCK)
    points = F.sequence(
        F.greatest(F.col("_lo"), F.col(BLOCK) * size),
        F.least(F.col("_hi"), F.col(BLOCK) * size + size - 1),
    )
    return blocks.select(*keys, F.explode(points).alias("_i")).select(
        *keys, F.timestamp_seconds(F.col("_i") * seconds).alias(ts)
    )


def densify(bars: DataFrame, seconds: int, keys: Sequence[str] = ("symbol",), ts: str = "bucket",
            rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RS4: one row per grid point; points without a bar are null."""
    return grid(bars, seconds, keys, ts, rows_per_block).join(bars, [*keys, ts], "left")


def fill_forward(dense: DataFrame, seconds: int, columns: Sequence[str],
                 keys: Sequence[str] = ("symbol",), ts: str = "bucket",
                 rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RS5: last non-null value so far."""
    series = Ordered.on_grid(dense, keys, ts, seconds, rows_per_block)
    filled = series.running(**{f"_f_{c}": last_set(F.col(c)) for c in columns}).done()
    return filled.withColumns({c: F.col(f"_f_{c}") for c in columns}).drop(
        *[f"_f_{c}" for c in columns]
    )


def fill_both(dense: DataFrame, seconds: int, columns: Sequence[str],
              keys: Sequence[str] = ("symbol",), ts: str = "bucket",
              rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RS6: next non-null value, and past the last one the last value."""
    series = Ordered.on_grid(dense, keys, ts, seconds, rows_per_block)
    folds = {f"_n_{c}": next_set(F.col(c)) for c in columns}
    folds |= {f"_l_{c}": last_set(F.col(c)) for c in columns}
    filled = series.running(**folds).done()
    return filled.withColumns(
        {c: F.coalesce(f"_n_{c}", f"_l_{c}") for c in columns}
    ).drop(*folds)


def complete_bars(bars: DataFrame, seconds: int, zero: Sequence[str] = (),
                  keys: Sequence[str] = ("symbol",), ts: str = "bucket",
                  rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RS20 (fill part): densify, counts and sums of empty buckets 0, the rest carried.

    Same rows as ``densify`` and ``fill_forward``, made from the bars alone: each
    bar fills the grid up to the next one. The bars are settled first, because
    making them reads all ticks and the pass over them reads them twice.
    """
    bars = settle(bars, "bars")
    rest = [c for c in bars.columns if c not in {*keys, ts, *zero}]
    series = Ordered.on_grid(bars, keys, ts, seconds, rows_per_block)
    filled = series.running(
        _next=next_set(F.col(ts), strict=True), **{f"_f_{c}": last_set(F.col(c)) for c in rest}).done()
    index = F.floor(F.unix_seconds(F.col(ts)) / seconds)
    until = F.coalesce(F.floor(F.unix_seconds("_next") / seconds), index + 1) - 1
    spread = explode_range(filled.withColumn("_at", index), F.col("_at"), until, "_i", rows_per_block)
    return spread.select(
        *keys, F.timestamp_seconds(F.col("_i") * seconds).alias(ts),
        *[F.when(F.col("_i") == F.col("_at"), F.col(c)).otherwise(F.lit(0)).alias(c)
          if c in zero else F.col(f"_f_{c}").alias(c) for c in bars.columns if c not in {*keys, ts}])


def zero_columns(bars: DataFrame) -> list[str]:
    """Columns of a bar table that are 0, not carried, in an empty bucket."""
    names = {*ZERO_WHEN_EMPTY, *(f"{c}_{s}" for c in ZERO_WHEN_EMPTY for s in SIDES)}
    return [c for c in bars.columns if c in names or c.startswith("nquote")]


def base_features(trades: DataFrame, quotes: DataFrame, seconds: int,
                  order: Sequence[str] = ("ts",), rows_per_block: int = ROWS_PER_BLOCK,
                  grid_rows: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RS20: trade and quote bars side by side on the full grid."""
    left = trade_bars(trades, seconds, by_side=True, rows_per_block=rows_per_block)
    right = quote_bars(quotes, seconds, order, rows_per_block=rows_per_block)
    bars = left.join(right, ["symbol", "bucket"], "full_outer")
    return complete_bars(bars, seconds, zero_columns(bars), rows_per_block=grid_rows)


def describe(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """RS21: count, mean, sample std, min, quartiles and max per column (and key), long form.

    All columns are unpivoted and go through one aggregate and one quantile pass.
    """
    rows = F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns
    ]))
    long = df.select(*keys, rows)
    v, by = F.col("v"), [*keys, "feature"]
    moments = long.groupBy(*by).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    quartiles = exact_quantiles(long, by, "v", (0.25, 0.5, 0.75))
    named = quartiles.withColumnsRenamed({"q0": "q25", "q1": "q50", "q2": "q75"})
    return moments.join(named, by, "left")


def overview(ticker: DataFrame, seconds: int, price: str = "mark_price",
             grid_rows: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RS22, MT10: grid series filled both ways, and its buy-and-hold curve in percent."""
    firsts = downscale(ticker, seconds, [price])
    filled = fill_both(densify(firsts, seconds, rows_per_block=grid_rows), seconds, [price],
                       rows_per_block=grid_rows)
    start = firsts.groupBy("symbol").agg(F.min_by(price, "bucket").alias("_start"))
    joined = join_per_key(filled, start, "symbol")
    return joined.withColumn("net_curve", 100 * (F.col(price) / F.col("_start") - 1)).drop("_start")
