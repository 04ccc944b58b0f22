"""Queries for joins, unions and samples over bars (JN, SE, SL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import HOUR, cut, hourly_bars, quotes, r6, report, runs, ticker, trades, with_views
from barloom.operators import joins, resample, sampling
from barloom.operators.dedup import ordered_union
from barloom.operators.ordering import Ordered
from barloom.session import join_per_key, settle

SIDES = {
    "h": """select symbol, date_trunc('hour', ts) bucket, arg_min(mark_price, ts) mark_price from fx_ticker group by 1, 2""",
    "q": """select symbol, date_trunc('hour', ts) bucket, count(*) nquote from fx_quotes group by 1, 2""",
}


def _three(spark, sf):
    trade = resample.trade_bars(trades(spark, sf), HOUR).select("symbol", "bucket", "close", "volume")
    quote = resample.quote_bars(quotes(spark, sf), HOUR, ["ts", "event_id"], ohlc=False).select("symbol", "bucket", "nquote")
    mark = resample.downscale(ticker(spark, sf), HOUR, ["mark_price"], order=["ts", "event_id"])
    early = F.col("bucket") < F.timestamp_seconds(F.lit(1705000000))
    return [trade.where(early | (F.hour("bucket") < 20)), quote.where(F.hour("bucket") > 2), mark.where(~early)]


def outer(spark, sf):
    return report(joins.side_by_side(_three(spark, sf)))


def _three_sql(kind: str) -> str:
    return with_views(
        ["fx_sparse", "fx_ticker", "fx_quotes"], **SIDES,
        a="""select symbol, bucket, "close", volume from fx_sparse
            where epoch(bucket) < 1705000000 or hour(bucket) < 20""",
        b="select * from q where hour(bucket) > 2", c="select * from h where epoch(bucket) >= 1705000000",
        j=f"select * from a {kind} join b using (symbol, bucket) {kind} join c using (symbol, bucket)",
    ) + f"\nSELECT symbol, epoch_us(bucket) bucket, nquote, {r6(chr(34)+'close'+chr(34), 'volume', 'mark_price')} FROM j"


def inner(spark, sf):
    return report(joins.side_by_side(_three(spark, sf), how="inner"))


def pit(spark, sf):
    later = settle(resample.trade_bars(trades(spark, sf), HOUR).select("symbol", "bucket", "close", "volume"), "bars")
    now = settle(resample.downscale(ticker(spark, sf), HOUR, ["mark_price"], order=["ts", "event_id"]), "marks")
    return report(joins.point_in_time(now, later, HOUR, ["close", "volume"]))


SQL_PIT = with_views(
    ["fx_grid", "fx_sparse", "fx_ticker"], h=SIDES["h"],
    later="""select symbol, bucket, lag("close") over w "close", lag(volume) over w volume, row_number() over w rn
        from fx_grid left join fx_sparse using (symbol, bucket) window w as (partition by symbol order by bucket)""",
    j="""select symbol, bucket, mark_price, "close", volume from fx_grid left join h using (symbol, bucket)
        join (select * from later where rn > 1) using (symbol, bucket)""",
    f="select symbol, bucket, " + ", ".join(
        f'last_value({c} ignore nulls) over (partition by symbol order by bucket) {c}'
        for c in ("mark_price", '"close"', "volume")) + " from j",
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6('mark_price', chr(34)+'close'+chr(34), 'volume')} FROM f"


def labels(spark, sf):
    bars = hourly_bars(spark, sf)
    tags = bars.where("volume > 10").select(
        "symbol", "bucket", "close", (F.col("ntrade") % 4).alias("label"), F.col("open"))
    return report(joins.attach_labels(bars, tags, ["symbol", "bucket", "close"], ["label"]),
                  "symbol", "bucket", "close", "open", "label")


SQL_LABELS = with_views(["fx_bars"]) + f"""
SELECT symbol, epoch_us(bucket) bucket, {r6(chr(34)+'close'+chr(34), chr(34)+'open'+chr(34))},
 case when volume > 10 then ntrade%4 end label FROM fx_bars"""


def numbered(spark, sf):
    """Bars with their 1-based position, from the grid itself."""
    bars = hourly_bars(spark, sf)
    starts = bars.groupBy("symbol").agg(F.min("bucket").alias("_s"))
    at = F.floor((F.unix_seconds("bucket") - F.unix_seconds("_s")) / HOUR) + 1
    return join_per_key(bars, starts, "symbol").withColumn("rn", at).drop("_s")


NUMBERED = "select *, row_number() over (partition by symbol order by bucket) rn from fx_bars"


def context(spark, sf):
    bars = numbered(spark, sf).select("symbol", "bucket", "rn", "close")
    last = bars.groupBy("symbol").agg(F.max("rn").alias("_n"))
    valid = join_per_key(bars, last, "symbol").where((F.col("rn") > 15) & (F.col("rn") <= F.col("_n") - 3))
    anchors = sampling.hash_sample(valid.select("symbol", "rn"), ["symbol", "rn"], 200, seed=7)
    return report(joins.context_windows(bars, anchors, ["symbol"], "rn"),
                  "symbol", "anchor", "offset", "close").withColumn("offset", F.col("offset").cast("long"))


SQL_CONTEXT = with_views(
    ["fx_bars"], n=NUMBERED,
    v="select symbol, rn from n join (select symbol, max(rn) m from n group by symbol) using (symbol) where rn>15 and rn<=m-3",
    a="select * from v order by md5(concat_ws('|', symbol, rn, '7')), symbol, rn limit 200",
) + f"""
SELECT n.symbol, a.rn anchor, n.rn-a.rn "offset", {cut('n."close"', '"close"')}
FROM a JOIN n ON n.symbol=a.symbol AND n.rn BETWEEN a.rn-15 AND a.rn+3"""


def aligned(spark, sf):
    curves = joins.accumulated(runs(spark, sf), ["run_id"], "step", "reward", "curve").select("run_id", "step", "curve")
    return report(joins.right_aligned(curves, "curve"))


SQL_ALIGNED = with_views(
    ["fx_runs"],
    c="select run_id, step, sum(reward) over (partition by run_id order by step) curve, count(*) over (partition by run_id) n from fx_runs",
    m="select max(n) m from c",
    g="select run_id, unnest(range(1, m+1)) step from (select distinct run_id from c), m",
    s="select run_id, step+m-n step, curve from c, m",
    j="select run_id, step, coalesce(curve, 0) curve from g left join s using (run_id, step)",
) + f"\nSELECT run_id, step, {r6('curve')} FROM j"


def split(spark, sf):
    made = sampling.chronological_split(
        numbered(spark, sf), [("train", 2), ("valid", 5), ("test", 5)], ["symbol"], "rn")
    return report(made, "symbol", "bucket", "split")


SQL_SPLIT = with_views(
    ["fx_bars"], n="select *, count(*) over (partition by symbol) c from (" + NUMBERED + ")",
    s="""select symbol, bucket, case when rn<=c//2 then 'train' when rn<=c//2+c//5 then 'valid'
        when rn<=c//2+c//5*2 then 'test' end split from n""",
) + "\nSELECT symbol, epoch_us(bucket) bucket, split FROM s WHERE split IS NOT NULL"


def chunks(spark, sf):
    made = sampling.overlapping_chunks(numbered(spark, sf), 96, 24, ["symbol"], "rn")
    return report(made, "symbol", "chunk_id", "bucket", "close")


SQL_CHUNKS = with_views(
    ["fx_bars"], n="select *, count(*) over (partition by symbol) c from (" + NUMBERED + ")",
    k="select distinct symbol, c, unnest(range(0, (c-120)//96+1)) chunk_id from n where c >= 120",
) + f"""
SELECT n.symbol, chunk_id, epoch_us(bucket) bucket, {cut('"close"', '"close"')} FROM k JOIN n
 ON n.symbol=k.symbol AND rn > chunk_id*96 AND rn <= chunk_id*96+120"""


def label_runs(spark, sf):
    bars = settle(hourly_bars(spark, sf).withColumn("label", F.floor(F.col("volume") / 12)), "labels")
    series = Ordered.on_grid(bars.select("symbol", "bucket", "label"), ["symbol"], "bucket", HOUR)
    return report(sampling.label_runs(series, "label"), "symbol", "bucket", "label", "run_id", "is_last")


SQL_LABEL_RUNS = with_views(
    ["fx_bars"],
    l="select symbol, bucket, cast(floor(volume/12) as bigint) label from fx_bars",
    c="select *, case when label is distinct from lag(label) over (partition by symbol order by bucket) then 1 else 0 end s from l",
    r="select *, sum(s) over (partition by symbol order by bucket) g from c",
) + """
SELECT symbol, epoch_us(bucket) bucket, label,
 dense_rank() over (partition by symbol, label order by g) - 1 run_id,
 g = max(g) over (partition by symbol) is_last FROM r"""


def index_runs(spark, sf):
    bars = numbered(spark, sf).where("volume > 12").select("symbol", F.col("rn").alias("idx"))
    return sampling.index_runs(bars, ["symbol"], "idx")


SQL_INDEX_RUNS = with_views(
    ["fx_bars"], n=NUMBERED, k="select symbol, rn idx from n where volume > 12",
    g="select *, idx-row_number() over (partition by symbol order by idx) gap from k",
) + '\nSELECT symbol, min(idx) "start", max(idx) stop, count(*) n FROM g GROUP BY symbol, gap'


def sample(spark, sf):
    return report(sampling.hash_sample(trades(spark, sf).select("symbol", "id", "price"), ["id"], 300, seed=3))


SQL_SAMPLE = with_views(["fx_trades"]) + f"""
SELECT symbol, id, {cut('price', 'price')} FROM fx_trades ORDER BY md5(concat_ws('|', id, '3')), id LIMIT 300"""


def parameter_sweep(spark, sf):
    from barloom.operators.signals import sweep_profit

    grid = [{"upper": u, "lower": -u} for u in (0.05, 0.1, 0.2)]
    return report(sweep_profit(hourly_bars(spark, sf), HOUR, grid))


SQL_SWEEP = with_views(
    ["fx_bars"],
    b="""select symbol, bucket, "close", (ntrade_up-ntrade_down)/nullif(ntrade,0)::double tilt,
        coalesce(lead("close") over (partition by symbol order by bucket)-"close", 0) gain from fx_bars""",
    g="select b.*, u.u upper, -u.u lower from b, (values (0.05::double),(0.1::double),(0.2::double)) u(u)",
    d="""select *, case when coalesce(tilt,0) >= upper then 1 when coalesce(tilt,0) <= lower then -1 end side from g""",
    p="""select *, coalesce(last_value(side ignore nulls) over (partition by symbol, upper order by bucket), 0) held from d""",
    t="select symbol, upper, lower, sum(held*gain) profit, count(*) filter (held<>0) held_rows from p group by all",
) + f"\nSELECT symbol, held_rows, {r6('upper', 'lower', 'profit')} FROM t"


# The published grid of (short, mid, long) spans.
SPANS = ((30, 60, 120), (60, 120, 240), (120, 240, 360), (15, 30, 60), (6, 15, 30), (3, 15, 60), (15, 45, 90))


def span_sweep(spark, sf):
    from barloom.operators.signals import span_sweep as sweep

    return report(sweep(hourly_bars(spark, sf), HOUR, SPANS))


SQL_SPANS = with_views(
    ["fx_bars"],
    n="""select symbol, row_number() over (partition by symbol order by bucket) i, "close" c,
        coalesce(lead("close") over (partition by symbol order by bucket)-"close", 0) gain from fx_bars""",
    g=f"select * from (values {', '.join(map(str, SPANS))}) g(short, mid, long)",
    **{"walk(symbol, short, mid, long, i, c, gain, mt, mb, lt, lb, dif, dt, db)": """
        select symbol, short, mid, long, i, c, gain, c, 1::double, c, 1::double, 0::double, 0::double, 1::double from n, g where i=1
        union all select symbol, short, mid, long, i, c, gain, mt, mb, lt, lb, d, dt*(1-2.0::double/(short+1))+d, db*(1-2.0::double/(short+1))+1
        from (select *, case when abs(mt/mb-lt/lb) > 1e-12*abs(c) then mt/mb-lt/lb else 0 end d
            from (select w.symbol, short, mid, long, n.i, n.c, n.gain, mt*(1-2.0::double/(mid+1))+n.c mt, mb*(1-2.0::double/(mid+1))+1 mb,
                lt*(1-2.0::double/(long+1))+n.c lt, lb*(1-2.0::double/(long+1))+1 lb, dt, db
                from walk w join n on n.symbol=w.symbol and n.i=w.i+1))"""},
    m="select *, case when abs(dif-dt/db) > 1e-12*abs(c) then dif-dt/db else 0 end macd from walk",
    d="select *, case when macd>0 and dif>0 then 1 when macd*dif<=0 then null else -1 end s from m",
    h="select *, last_value(s ignore nulls) over (partition by symbol, short, mid, long order by i) held from d",
    t="select symbol, short, mid, long, sum(coalesce(held, 0)*gain) profit, count(held) held_rows from h group by all",
).replace("WITH", "WITH RECURSIVE", 1) + f"\nSELECT symbol, short, mid, long, held_rows, {r6('profit')} FROM t"


def union_lists(spark, sf):
    """Name lists of two horizons merged in order of first appearance."""
    t = trades(spark, sf)
    first = t.groupBy("symbol").agg(F.min("id").alias("at")).withColumn("part", F.lit(1))
    second = t.where("side = 'sell'").groupBy("symbol").agg(F.min("id").alias("at")).withColumn("part", F.lit(2))
    return ordered_union(first.unionByName(second), "symbol", ["part", "at"]).withColumn("rank", F.col("rank").cast("long"))


SQL_UNION_LISTS = with_views(["fx_trades"]) + """
SELECT symbol, row_number() over (order by a) "rank" FROM (SELECT symbol, min(id) a FROM fx_trades GROUP BY symbol)"""

QUERIES = {
    "outer_time_join": (outer, _three_sql("full outer")),
    "inner_time_join": (inner, _three_sql("inner")),
    "point_in_time_join": (pit, SQL_PIT),
    "label_join": (labels, SQL_LABELS),
    "context_windows": (context, SQL_CONTEXT),
    "right_aligned_curves": (aligned, SQL_ALIGNED),
    "chronological_split": (split, SQL_SPLIT),
    "overlapping_chunks": (chunks, SQL_CHUNKS),
    "label_runs": (label_runs, SQL_LABEL_RUNS),
    "index_runs": (index_runs, SQL_INDEX_RUNS),
    "hash_sample": (sample, SQL_SAMPLE),
    "parameter_sweep": (parameter_sweep, SQL_SWEEP),
    "span_sweep": (span_sweep, SQL_SPANS),
    "ordered_union": (union_lists, SQL_UNION_LISTS),
}
