"""Queries over trades, quotes and the ticker (IO, PR, DD, RS)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import HOUR, cut, quotes, r6, report, ticker, trades, with_views
from barloom.operators import dedup, resample
from barloom.sources import tables

BAR_DOUBLES = ('"open"', "high", "low", '"close"', "volume", "tradeval", "vwap", "awap", "twap")
BAR_COUNTS = ("ntrade", "ntrade_up", "ntrade_down", "ntrade_flat")


def trade_bars(spark, sf):
    return report(resample.trade_bars(trades(spark, sf), HOUR))


SQL_TRADE_BARS = with_views(["fx_sparse"]) + f"""
SELECT symbol, epoch_us(bucket) bucket, {r6(*BAR_DOUBLES)}, {', '.join(BAR_COUNTS)} FROM fx_sparse"""


def side_bars(spark, sf):
    wanted = [f"{c}_{s}" for s in resample.SIDES for c in (
        "open", "high", "low", "close", "volume", "tradeval", "ntrade", "vwap", "awap", "twap",
        "ntrade_up", "ntrade_down", "ntrade_flat")]
    bars = resample.trade_bars(trades(spark, sf), HOUR, by_side=True)
    return report(bars, "symbol", "bucket", *wanted)


def _side_sql(s: str) -> str:
    f = f"filter (side='{s}')"
    return f"""arg_min(price, us) {f} open_{s}, max(price) {f} high_{s}, min(price) {f} low_{s},
        arg_max(price, us) {f} close_{s}, coalesce(sum(amount) {f},0) volume_{s},
        coalesce(sum(price*amount) {f},0) tradeval_{s}, count(*) {f} ntrade_{s},
        sum(price*amount) {f}/sum(amount) {f} vwap_{s}, avg(price) {f} awap_{s},
        sum(price*sdus) {f}/nullif(sum(sdus) {f},0) twap_{s},
        count(*) filter (side='{s}' and move>0) ntrade_up_{s},
        count(*) filter (side='{s}' and move<0) ntrade_down_{s},
        count(*) filter (side='{s}' and move=0) ntrade_flat_{s}"""


SQL_SIDE_BARS = with_views(
    ["fx_gaps"],
    own="""select *, us-lag(us) over (partition by symbol, side, bucket order by ts, id) sdus from fx_gaps""",
    agg=f"select symbol, bucket, {_side_sql('buy')}, {_side_sql('sell')} from own group by symbol, bucket",
) + "\nSELECT symbol, epoch_us(bucket) bucket, " + ", ".join(
    r6(*[f"{c}_{s}" for c in ("open", "high", "low", "close", "volume", "tradeval", "vwap", "awap", "twap")])
    + ", " + ", ".join(f"{c}_{s}" for c in BAR_COUNTS)
    for s in ("buy", "sell")
) + " FROM agg"


def quote_counts(spark, sf):
    return report(resample.quote_bars(quotes(spark, sf), HOUR, ["ts", "event_id"], ohlc=False))


def _count_sql() -> str:
    parts = ["count(*) nquote"]
    for label, c in (("bid", "bid_price"), ("ask", "ask_price"),
                     ("bidsize", "bid_amount"), ("asksize", "ask_amount")):
        parts += [
            f"count(*) filter (p_{c} is null or {c}<>p_{c}) nquote_{label}",
            f"count(*) filter ({c}>p_{c}) nquote_{label}_up",
            f"count(*) filter ({c}<p_{c}) nquote_{label}_down",
        ]
    for label, c, o, still in (("bid", "bid_price", "ask_price", "askflat"),
                               ("ask", "ask_price", "bid_price", "bidflat")):
        for word, op in (("", "<>"), ("up", ">"), ("down", "<")):
            parts.append(
                f"count(*) filter ({c}{op}p_{c} and {o}=p_{o}) nquote_{label}{word}_{still}"
            )
    return ", ".join(parts)


SQL_QUOTE_COUNTS = with_views(
    ["fx_quotes"],
    q="""select *, date_trunc('hour', ts) bucket from fx_quotes""",
    l="select *, " + ", ".join(
        f"lag({c}) over w p_{c}" for c in ("bid_price", "ask_price", "bid_amount", "ask_amount")
    ) + " from q window w as (partition by symbol, bucket order by ts, event_id)",
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {_count_sql()} FROM l GROUP BY ALL"


def quote_ohlc(spark, sf):
    return report(resample.quote_bars(quotes(spark, sf), HOUR, ["ts", "event_id"], counts=False))


SQL_INDICATORS = """ask_price-bid_price spread, (ask_price+bid_price)/2 mid,
    (bid_amount-ask_amount)/(bid_amount+ask_amount) imblance_volume,
    (ask_amount*ask_price+bid_amount*bid_price)/(bid_amount+ask_amount) makav_rev,
    (ask_amount*bid_price+bid_amount*ask_price)/(bid_amount+ask_amount) makav_ori,
    bid_price bid, bid_amount bidsize, ask_price ask, ask_amount asksize"""

SQL_QUOTE_OHLC = with_views(
    ["fx_quotes"],
    i=f"""select symbol, ts, date_trunc('hour', ts) bucket, epoch_us(ts) us,
        epoch_us(ts)-lag(epoch_us(ts)) over (partition by symbol order by ts, event_id) dus,
        {SQL_INDICATORS} from fx_quotes""",
    a="select symbol, bucket, " + ", ".join(
        f"""arg_min({n}, us) open_{n}, max({n}) high_{n}, min({n}) low_{n}, arg_max({n}, us) close_{n},
        sum({n}*dus)/nullif(sum(dus),0) twap_{n}, avg({n}) awap_{n}"""
        for n in resample.QUOTE_INDICATORS
    ) + " from i group by symbol, bucket",
) + "\nSELECT symbol, epoch_us(bucket) bucket, " + r6(*[
    f"{m}_{n}" for n in resample.QUOTE_INDICATORS for m in ("open", "high", "low", "close", "twap", "awap")
]) + " FROM a"


def quote_rows(spark, sf):
    rows = resample.quote_indicators(quotes(spark, sf))
    return report(rows, "symbol", "event_id", *resample.QUOTE_INDICATORS)


SQL_QUOTE_ROWS = with_views(["fx_quotes"], i=f"select symbol, event_id, {SQL_INDICATORS} from fx_quotes") + \
    f"\nSELECT symbol, event_id, {r6(*resample.QUOTE_INDICATORS)} FROM i"


def dense_bars(spark, sf):
    sparse = resample.trade_bars(trades(spark, sf), HOUR).select("symbol", "bucket", "close", "volume")
    return report(resample.densify(sparse, HOUR))


SQL_DENSE = with_views(["fx_grid", "fx_sparse"]) + f"""
SELECT symbol, epoch_us(bucket) bucket, {r6('"close"', 'volume')}
FROM fx_grid LEFT JOIN fx_sparse USING (symbol, bucket)"""


def filled_bars(spark, sf):
    bars = resample.trade_bars(trades(spark, sf), HOUR)
    return report(resample.complete_bars(bars, HOUR, resample.zero_columns(bars)))


SQL_FILLED = with_views(["fx_bars"]) + f"""
SELECT symbol, epoch_us(bucket) bucket, {r6(*BAR_DOUBLES)}, {', '.join(BAR_COUNTS)} FROM fx_bars"""


def base_features(spark, sf):
    """All columns of trade bars, bars by side, quote counts and quote indicator bars, on the full grid."""
    return report(resample.base_features(trades(spark, sf), quotes(spark, sf), HOUR, ["ts", "event_id"]))


_SIDE_DOUBLES = [f"{c}_{s}" for s in ("buy", "sell") for c in ("open", "high", "low", "close", "volume", "tradeval", "vwap", "awap", "twap")]
_SIDE_COUNTS = [f"{c}_{s}" for s in ("buy", "sell") for c in BAR_COUNTS]
_QUOTE_COUNTS = [part.rsplit(" ", 1)[1] for part in _count_sql().split(", count")]
_QUOTE_DOUBLES = [f"{m}_{n}" for n in resample.QUOTE_INDICATORS for m in ("open", "high", "low", "close", "twap", "awap")]
BASE_DOUBLES = [*BAR_DOUBLES, *_SIDE_DOUBLES, *_QUOTE_DOUBLES]
BASE_COUNTS = [*BAR_COUNTS, *_SIDE_COUNTS, *_QUOTE_COUNTS]


def base_views() -> dict[str, str]:
    """Views that end in ``base``: every column of ``base_features``, filled over the grid."""
    zero = {*BASE_COUNTS, *(f"{c}{s}" for c in ("volume", "tradeval") for s in ("", "_buy", "_sell"))}
    filled = [f"coalesce({c},0) {c}" if c in zero else f"last_value({c} ignore nulls) over w {c}" for c in (*BASE_DOUBLES, *BASE_COUNTS)]
    return {
        "own": "select *, us-lag(us) over (partition by symbol, side, bucket order by ts, id) sdus from fx_gaps",
        "sides": f"select symbol, bucket, {_side_sql('buy')}, {_side_sql('sell')} from own group by symbol, bucket",
        "qt": "select *, date_trunc('hour', ts) bucket, epoch_us(ts) us from fx_quotes",
        "ql": "select *, " + ", ".join(f"lag({c}) over w p_{c}" for c in ("bid_price", "ask_price", "bid_amount", "ask_amount"))
        + " from qt window w as (partition by symbol, bucket order by ts, event_id)",
        "qc": f"select symbol, bucket, {_count_sql()} from ql group by symbol, bucket",
        "qi": f"""select symbol, bucket, us, us-lag(us) over (partition by symbol order by ts, event_id) dus, {SQL_INDICATORS} from qt""",
        "qo": "select symbol, bucket, " + ", ".join(
            f"""arg_min({n}, us) open_{n}, max({n}) high_{n}, min({n}) low_{n}, arg_max({n}, us) close_{n},
            sum({n}*dus)/nullif(sum(dus),0) twap_{n}, avg({n}) awap_{n}""" for n in resample.QUOTE_INDICATORS)
        + " from qi group by symbol, bucket",
        "base": f"""select symbol, bucket, {', '.join(filled)} from fx_grid left join fx_sparse using (symbol, bucket)
            left join sides using (symbol, bucket) left join qc using (symbol, bucket) left join qo using (symbol, bucket)
            window w as (partition by symbol order by bucket)""",
    }


SQL_BASE = with_views(["fx_grid", "fx_sparse", "fx_quotes"], **base_views()) + f"""
SELECT symbol, epoch_us(bucket) bucket, {', '.join(BASE_COUNTS)}, {r6(*BASE_DOUBLES)} FROM base"""


def ticker_downscale(spark, sf):
    t = tables.ticker_columns(ticker(spark, sf), "event_id")
    cols = ["funding_timestamp", "funding_rate", "index_price", "mark_price"]
    return report(resample.downscale(t, HOUR, cols, order=["ts", "event_id"]))


SQL_TICKER = with_views(["fx_ticker"]) + f"""
SELECT symbol, epoch_us(date_trunc('hour', ts)) bucket, epoch_us(arg_min(funding_timestamp, ts)) funding_timestamp,
{cut('arg_min(funding_rate, ts)', 'funding_rate')},
{cut('arg_min(index_price, ts)', 'index_price')},
{cut('arg_min(mark_price, ts)', 'mark_price')} FROM fx_ticker GROUP BY 1, 2"""


def two_level(spark, sf):
    fine = resample.downscale(ticker(spark, sf), 600, ["mark_price"], order=["ts", "event_id"])
    return report(resample.downscale(fine, HOUR, ["mark_price"], ts="bucket"))


SQL_TWO_LEVEL = with_views(["fx_ticker"]) + f"""
SELECT symbol, epoch_us(date_trunc('hour', ts)) bucket,
{cut('arg_min(mark_price, ts)', 'mark_price')} FROM fx_ticker GROUP BY 1, 2"""


def overview(spark, sf):
    return report(resample.overview(ticker(spark, sf), HOUR))


SQL_OVERVIEW = with_views(
    ["fx_ticker"],
    h="""select symbol, date_trunc('hour', ts) bucket, arg_min(mark_price, ts) mark_price
        from fx_ticker group by 1, 2""",
    g="""select symbol, unnest(generate_series(min(bucket), max(bucket), interval 1 hour)) bucket
        from h group by symbol""",
    f="""select symbol, bucket, coalesce(
        first_value(mark_price ignore nulls) over (partition by symbol order by bucket
            rows between current row and unbounded following),
        last_value(mark_price ignore nulls) over (partition by symbol order by bucket)) mark_price
        from g left join h using (symbol, bucket)""",
    s="select symbol, arg_min(mark_price, bucket) p0 from h group by symbol",
    o="select symbol, bucket, mark_price, 100*(mark_price/p0-1) net_curve from f join s using (symbol)",
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6('mark_price', 'net_curve')} FROM o"


def spread_ties(spark, sf):
    q = quotes(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return report(dedup.spread_ties(q, ["symbol"], "ts", ["event_id"]), "symbol", "event_id", "ts")


SQL_TIES = with_views(["fx_quotes"]) + """
SELECT symbol, event_id, epoch_us(date_trunc('hour', ts))
 + row_number() over (partition by symbol, date_trunc('hour', ts) order by event_id) - 1 ts FROM fx_quotes"""


def keep_first(spark, sf):
    q = quotes(spark, sf).withColumn("ts", F.date_trunc("hour", "ts"))
    return report(dedup.keep_first(q, ["symbol", "ts"], ["event_id"]),
                  "symbol", "ts", "event_id", "bid_price", "ask_amount")


SQL_KEEP_FIRST = with_views(["fx_quotes"]) + f"""
SELECT symbol, epoch_us(h) ts, event_id, {r6('bid_price', 'ask_amount')} FROM (
 SELECT *, date_trunc('hour', ts) h, row_number() over (partition by symbol, date_trunc('hour', ts)
  order by event_id) rn FROM fx_quotes) WHERE rn = 1"""


def first_values(spark, sf):
    q = quotes(spark, sf).withColumns({
        "ts": F.date_trunc("hour", "ts"),
        "bid_price": F.when(F.col("event_id") % 3 != 0, F.col("bid_price")),
        "ask_price": F.when(F.col("event_id") % 2 == 0, F.col("ask_price")),
    })
    return report(dedup.first_values(q, ["symbol", "ts"], ["event_id"], ["bid_price", "ask_price"]))


SQL_FIRST_VALUES = with_views(["fx_quotes"]) + f"""
SELECT symbol, epoch_us(date_trunc('hour', ts)) ts,
{cut('(arg_min(bid_price, event_id) filter (event_id%3<>0))', 'bid_price')},
{cut('(arg_min(ask_price, event_id) filter (event_id%2=0))', 'ask_price')}
FROM fx_quotes GROUP BY 1, 2"""


def equal_columns(spark, sf):
    t = ticker(spark, sf).withColumn("double_mark", F.col("mark_price") * 2)
    return dedup.equal_columns(t, ["event_id"], ["mark_price", "index_price", "double_mark", "funding_rate"])


SQL_EQUAL = with_views(["fx_ticker"]) + """
SELECT t.position, t."column", t.same_as FROM (
 SELECT count(*) filter (mark_price is distinct from index_price) d FROM fx_ticker) c,
LATERAL (VALUES (0, 'mark_price', 'mark_price'),
 (1, 'index_price', case when c.d=0 then 'mark_price' else 'index_price' end),
 (2, 'double_mark', 'double_mark'), (3, 'funding_rate', 'funding_rate')) t(position, "column", same_as)"""


def row_ids(spark, sf):
    return dedup.row_ids(trades(spark, sf).withColumnRenamed("id", "event"), ["symbol"], ["ts", "event"]) \
        .select("symbol", "event", "id")


SQL_ROW_IDS = with_views(["fx_trades"]) + """
SELECT symbol, id event, row_number() over (partition by symbol order by ts, id) - 1 id FROM fx_trades"""


def day_range(spark, sf):
    t = trades(spark, sf).withColumn("date", F.to_date("ts"))
    one = tables.on_date(t, "2024-01-03")
    more = tables.in_dates(t, "2024-01-10", "2024-01-12")
    return one.unionByName(more).groupBy("symbol", F.unix_date("date").cast("long").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


SQL_DAY_RANGE = with_views(["fx_trades"]) + """
SELECT symbol, cast(ts as date) - date '1970-01-01' AS day, count(*) n FROM fx_trades
WHERE cast(ts as date) = date '2024-01-03' OR cast(ts as date) BETWEEN date '2024-01-10' AND date '2024-01-12'
GROUP BY 1, 2"""


def missing_days(spark, sf):
    t = trades(spark, sf)
    gone = tables.missing_days(
        {"trades": t, "buys": t.where("side = 'buy' and symbol <> 'view'")}, "2023-12-30", "2024-02-02")
    return gone.select("source", "symbol", F.unix_date("day").cast("long").alias("day"))


SQL_MISSING = with_views(
    ["fx_trades"],
    seen="""select distinct 'trades' source, symbol, cast(ts as date) d from fx_trades union all
        select distinct 'buys', symbol, cast(ts as date) from fx_trades where side='buy' and symbol<>'view'""",
    want="""select source, symbol, cast(unnest(generate_series(date '2023-12-30', date '2024-02-02',
        interval 1 day)) as date) d
        from (select distinct symbol from fx_trades) cross join (values ('trades'),('buys')) t(source)""",
) + """
SELECT source, symbol, d - date '1970-01-01' AS day FROM want ANTI JOIN seen USING (source, symbol, d)"""


def completeness(spark, sf):
    t = tables.completeness(trades(spark, sf), "2024-01-01", "2024-01-31", HOUR)
    return t.withColumn("day", F.unix_date("day").cast("long"))


SQL_COMPLETENESS = with_views(
    ["fx_trades"],
    n="""select symbol, cast(ts as date) d, count(distinct date_trunc('hour', ts)) n from fx_trades group by 1, 2""",
    want="""select symbol, cast(unnest(generate_series(date '2024-01-01', date '2024-01-31',
        interval 1 day)) as date) d from (select distinct symbol from fx_trades)""",
) + """
SELECT symbol, d - date '1970-01-01' AS day, coalesce(n,0) n_buckets, cast(24 as bigint) n_expected,
 coalesce(n,0)=24 complete FROM want LEFT JOIN n USING (symbol, d)"""


def describe(spark, sf):
    return report(resample.describe(trades(spark, sf), ["price", "amount"]))


SQL_DESCRIBE = with_views(
    ["fx_trades"],
    u="select 'price' feature, price v from fx_trades union all select 'amount', amount from fx_trades",
    d="""select feature, count(*) "count", avg(v) mean, stddev_samp(v) std, min(v) "min",
        quantile_cont(v,0.25) q25, quantile_cont(v,0.5) q50, quantile_cont(v,0.75) q75, max(v) "max"
        from u group by feature""",
) + f"""
SELECT feature, "count", {r6('mean', 'std', '"min"', 'q25', 'q50', 'q75', '"max"')} FROM d"""

QUERIES = {
    "trade_bars": (trade_bars, SQL_TRADE_BARS),
    "side_bars": (side_bars, SQL_SIDE_BARS),
    "quote_change_counts": (quote_counts, SQL_QUOTE_COUNTS),
    "quote_indicator_bars": (quote_ohlc, SQL_QUOTE_OHLC),
    "quote_indicators": (quote_rows, SQL_QUOTE_ROWS),
    "dense_grid": (dense_bars, SQL_DENSE),
    "filled_bars": (filled_bars, SQL_FILLED),
    "base_features": (base_features, SQL_BASE),
    "ticker_downscale": (ticker_downscale, SQL_TICKER),
    "two_level_downscale": (two_level, SQL_TWO_LEVEL),
    "price_overview": (overview, SQL_OVERVIEW),
    "spread_equal_times": (spread_ties, SQL_TIES),
    "keep_first_quote": (keep_first, SQL_KEEP_FIRST),
    "first_values_per_time": (first_values, SQL_FIRST_VALUES),
    "equal_columns": (equal_columns, SQL_EQUAL),
    "row_ids": (row_ids, SQL_ROW_IDS),
    "date_range_scan": (day_range, SQL_DAY_RANGE),
    "missing_days": (missing_days, SQL_MISSING),
    "day_completeness": (completeness, SQL_COMPLETENESS),
    "describe_trades": (describe, SQL_DESCRIBE),
}
