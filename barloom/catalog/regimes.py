"""Queries for regime segmentation (RG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import HOUR, hourly_bars, r6, report, with_views
from barloom.operators import regimes
from barloom.operators.ordering import Ordered
from barloom.session import join_per_key, settle

MIN_LENGTH, CLASSES = 12, 4


def _positions(spark, sf):
    bars = hourly_bars(spark, sf).select("symbol", "bucket", "close")
    starts = bars.groupBy("symbol").agg(F.min("bucket").alias("_s"))
    at = F.floor((F.unix_seconds("bucket") - F.unix_seconds("_s")) / HOUR)
    return join_per_key(bars, starts, "symbol").select("symbol", at.alias("pos"), "close")


def _turns(spark, sf):
    return regimes.smoothed_turns(Ordered.on_steps(_positions(spark, sf), ["symbol"], "pos"), "close")


def _segmented(spark, sf):
    turns = _turns(spark, sf)
    turns = turns.on(settle(turns.df, "turns"))
    cut = regimes.segments(turns, MIN_LENGTH)
    return settle(turns.done().join(cut, ["symbol", "pos"]), "segments")


SMOOTH = "+".join(
    f"coalesce({4 - abs(j)}*" + (f'lag("close",{j}) over w' if j >= 0 else f'lead("close",{-j}) over w') + ",0)"
    for j in range(-3, 4))
NORM = "+".join(
    f"case when " + (f'lag("close",{j}) over w' if j >= 0 else f'lead("close",{-j}) over w') + f" is not null then {4 - abs(j)} else 0 end"
    for j in range(-3, 4))
TURN_VIEWS = {
    "sm": f"""select symbol, row_number() over w - 1 pos, "close", ({SMOOTH})/({NORM})::double smooth from fx_bars
        window w as (partition by symbol order by bucket)""",
    "rt": "select *, coalesce(smooth/lag(smooth) over (partition by symbol order by pos)-1, 0) ret from sm",
    "tn": "select *, coalesce(lag(ret) over (partition by symbol order by pos)*ret < 0, false) turn from rt",
}
SEGMENT_VIEWS = TURN_VIEWS | {
    "kept(symbol, p)": f"""select distinct symbol, 0::bigint from tn union all
        select k.symbol, min(t.pos) from kept k join tn t on t.symbol=k.symbol and t.turn and t.pos >= k.p+{MIN_LENGTH}
        group by k.symbol""",
    "sg": """select tn.symbol, pos, "close", smooth, p segment_start from tn asof join
        (select symbol, p from kept where p is not null) k on tn.symbol=k.symbol and tn.pos >= k.p""",
}
SLOPE_VIEWS = SEGMENT_VIEWS | {
    "sl": """select symbol, segment_start, count(*) n, (case when count(*)>1 then regr_slope(smooth, pos) else 0 end) slope,
        100*(case when count(*)>1 then regr_slope(smooth, pos) else 0 end)/arg_min(smooth, pos) norm_slope from sg group by symbol, segment_start""",
}


def _recursive(**views: str) -> str:
    return with_views(["fx_bars"], **views).replace("WITH ", "WITH RECURSIVE ", 1)


def turns(spark, sf):
    return report(_turns(spark, sf).done(), "symbol", "pos", "smooth", "turn")


SQL_TURNS = _recursive(**TURN_VIEWS) + f"\nSELECT symbol, pos, {r6('smooth')}, turn FROM tn"


def merged(spark, sf):
    return report(_segmented(spark, sf), "symbol", "pos", "segment_start")


SQL_MERGED = _recursive(**SEGMENT_VIEWS) + "\nSELECT symbol, pos, segment_start FROM sg"


def slopes(spark, sf):
    return report(regimes.segment_slopes(_segmented(spark, sf), ["symbol"], "pos", "smooth"))


SQL_SLOPES = _recursive(**SLOPE_VIEWS) + f"\nSELECT symbol, segment_start, n, {r6('slope', 'norm_slope')} FROM sl"


def labelled(spark, sf):
    """Row labels by slope cut points and by quantile cut points."""
    rows = _segmented(spark, sf)
    found = settle(regimes.segment_slopes(rows, ["symbol"], "pos", "smooth"), "slopes")
    by_slope = regimes.label_segments(found, regimes.slope_cuts(found, ["symbol"], CLASSES), ["symbol"])
    by_rank = regimes.label_segments(found, regimes.quantile_cuts(found, ["symbol"], CLASSES), ["symbol"])
    out = regimes.spread_labels(rows, by_slope, ["symbol"]).withColumnRenamed("label", "slope_label")
    out = regimes.spread_labels(out, by_rank, ["symbol"]).withColumnRenamed("label", "quantile_label")
    return out.select("symbol", "pos", F.col("slope_label").cast("long").alias("slope_label"),
                      F.col("quantile_label").cast("long").alias("quantile_label"))


SQL_LABELLED = _recursive(
    **SLOPE_VIEWS,
    o="select symbol, list(norm_slope order by norm_slope) s from sl group by symbol",
    e="select symbol, s, s[cast(floor(len(s)*0.05) as int)+3] lo, s[cast(floor(len(s)*0.95) as int)+1] hi from o",
    c="""select symbol, lo c1, lo+(hi-lo)/2*1 c2, hi c3,
        (select quantile_cont(x, [0.25,0.5,0.75]) from (select unnest(s) x)) q from e""",
    l="""select sl.symbol, segment_start, (c1<norm_slope)::int+(c2<norm_slope)::int+(c3<norm_slope)::int a,
        (q[1]<norm_slope)::int+(q[2]<norm_slope)::int+(q[3]<norm_slope)::int b from sl join c on sl.symbol=c.symbol""",
) + """
SELECT sg.symbol, pos, cast(a as bigint) slope_label, cast(b as bigint) quantile_label
FROM sg JOIN l ON sg.symbol=l.symbol AND sg.segment_start=l.segment_start"""


def windows(spark, sf):
    return report(regimes.window_slopes(_positions(spark, sf), ["symbol"], "pos", "close", 24))


SQL_WINDOWS = _recursive(
    sm=TURN_VIEWS["sm"], g="""select symbol, pos//24 window_id, count(*) n, regr_slope("close", pos) slope from sm group by 1, 2""",
) + f"\nSELECT symbol, window_id, {r6('slope')} FROM g WHERE n = 24"


def moves(spark, sf):
    return report(regimes.segment_moves(_segmented(spark, sf), ["symbol"], "pos", "close"))


MOVE_VIEWS = SEGMENT_VIEWS | {
    "pk": """select *, max("close") over w mx, min("close") over w mn, count(*) over (partition by symbol, segment_start) n
        from sg window w as (partition by symbol, segment_start order by pos)""",
    "at": """select a.*, (select min(b.pos) from sg b where b.symbol=a.symbol and b.segment_start=a.segment_start and b."close"=a.mx) mxp,
        (select min(b.pos) from sg b where b.symbol=a.symbol and b.segment_start=a.segment_start and b."close"=a.mn) mnp from pk a""",
    "dd": """select symbol, segment_start, any_value(n) n,
        (arg_max("close",pos)-arg_min("close",pos))/(any_value(n)*arg_min("close",pos)) average_slope,
        max((mx-"close")/mx) f, arg_max(pos-mxp, ((mx-"close")/mx, -pos)) fl,
        max(("close"-mn)/mn) u, arg_max(pos-mnp, (("close"-mn)/mn, -pos)) ul from at group by symbol, segment_start""",
    "mv": """select symbol, segment_start, n, average_slope, f/((case when f>0 then fl else 0 end)+1e-10) fall_slope,
        case when f>0 then fl else 0 end fall_length, (case when f>0 then fl else 0 end)/n fall_share,
        u/((case when u>0 then ul else 0 end)+1e-10) rise_slope,
        case when u>0 then ul else 0 end rise_length, (case when u>0 then ul else 0 end)/n rise_share from dd""",
}
MOVE_VIEWS = {k.replace("at", "atp") if k == "at" else k: v.replace("from at group", "from atp group") for k, v in MOVE_VIEWS.items()}
SQL_MOVES = _recursive(**MOVE_VIEWS) + f"""
SELECT symbol, segment_start, n, fall_length, rise_length,
 {r6('average_slope', 'fall_slope', 'fall_share', 'rise_slope', 'rise_share')} FROM mv"""


def distributions(spark, sf):
    rows = _segmented(spark, sf)
    found = settle(regimes.segment_slopes(rows, ["symbol"], "pos", "smooth"), "slopes")
    labels = regimes.label_segments(found, regimes.quantile_cuts(found, ["symbol"], CLASSES), ["symbol"])
    made = regimes.segment_moves(rows, ["symbol"], "pos", "close").join(
        labels.select("symbol", "segment_start", "label"), ["symbol", "segment_start"])
    out = regimes.label_distributions(made, ["n", "average_slope", "fall_length", "rise_share"])
    return report(out.withColumn("label", F.col("label").cast("long")))


SQL_DISTRIBUTIONS = _recursive(
    **(SLOPE_VIEWS | MOVE_VIEWS),
    c="select symbol, quantile_cont(norm_slope, [0.25,0.5,0.75]) q from sl group by symbol",
    l="""select sl.symbol, segment_start,
        (q[1]<norm_slope)::int+(q[2]<norm_slope)::int+(q[3]<norm_slope)::int lab from sl join c on sl.symbol=c.symbol""",
    u="""select lab, mm.metric, mm.x from (select lab, unnest([{'metric':'n','x':n::double},{'metric':'average_slope','x':average_slope},
        {'metric':'fall_length','x':fall_length::double},{'metric':'rise_share','x':rise_share}]) mm
        from mv join l on mv.symbol=l.symbol and mv.segment_start=l.segment_start)""",
    d="""select cast(lab as bigint) "label", metric, min(x) "min", quantile_cont(x,0.25) q25, quantile_cont(x,0.5) q50,
        quantile_cont(x,0.75) q75, max(x) "max" from u group by lab, metric""",
) + f"""
SELECT "label", metric, {r6('"min"', 'q25', 'q50', 'q75', '"max"')} FROM d"""

QUERIES = {
    "smoothed_turns": (turns, SQL_TURNS),
    "merged_segments": (merged, SQL_MERGED),
    "segment_slopes": (slopes, SQL_SLOPES),
    "segment_labels": (labelled, SQL_LABELLED),
    "window_slopes": (windows, SQL_WINDOWS),
    "segment_moves": (moves, SQL_MOVES),
    "regime_distributions": (distributions, SQL_DISTRIBUTIONS),
}
