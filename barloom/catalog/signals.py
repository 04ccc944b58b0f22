"""Queries for signals, routing and score metrics (SG)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.bars import MACD_VIEWS
from barloom.catalog.fixtures import HOUR, book, cut, factors, hourly_bars, r6, report, runs, scores, with_views
from barloom.operators import rolling, signals
from barloom.operators.book import snapshot_features
from barloom.operators.ordering import Ordered
from barloom.session import settle

WINDOW, DECAY, THRESHOLD, FALLBACK = 8, 0.9, 0.6, 5


def macd(spark, sf):
    made = rolling.macd(hourly_bars(spark, sf), "close", HOUR)
    made = made.withColumn("decision", signals.macd_decision(F.col("dif"), F.col("macd")))
    held = signals.hold_position(Ordered.on_grid(settle(made, "macd"), ["symbol"], "bucket", HOUR), "decision", "held")
    return report(held.done(), "symbol", "bucket", "dif", "dea", "macd", "held")


SQL_MACD = with_views(
    ["fx_bars"], **MACD_VIEWS,
    d="""select *, case when macd>0 and dif>0 then 'buy' when macd*dif<=0 then null else 'sell' end s from macds""",
    h="""select *, coalesce(last_value(s ignore nulls) over (partition by symbol order by bucket), 'flat') held from d""",
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6('dif', 'dea', 'macd')}, held FROM h"


def imbalance(spark, sf):
    rows = snapshot_features(book(spark, sf), ["book_id"], 1).select("book_id", "imblance_volume_oe")
    value = F.col("imblance_volume_oe")
    rows = rows.withColumns({
        "tuned": signals.imbalance_decision(value, F.lit(0.01), F.lit(-0.01)),
        "decision": signals.imbalance_decision(value, F.lit(0.02), F.lit(-0.02), strict=True),
    })
    held = signals.hold_position(Ordered.on_steps(rows, [], "book_id"), "decision", "held")
    return report(held.done(), "book_id", "imblance_volume_oe", "tuned", "decision", "held")


SQL_IMBALANCE = with_views(
    ["fx_book"],
    v="""select book_id, (list_sum(bid_size)-list_sum(ask_size))/(list_sum(bid_size)+list_sum(ask_size)+1e-15) v from fx_book""",
    d="""select *, case when v>=0.01 then 'buy' when v<=-0.01 then 'sell' else 'hold' end tuned,
        case when v>0.02 then 'buy' when v<-0.02 then 'sell' else 'hold' end decision from v""",
) + f"""
SELECT book_id, {cut('v', 'imblance_volume_oe')}, tuned, decision,
 coalesce(last_value(nullif(decision,'hold') ignore nulls) over (order by book_id), 'flat') held FROM d"""


def experts(spark, sf):
    marks = Ordered.on_steps(factors(spark, sf).select(F.col("vec_id").alias("step"), "mark_price"), [], "step")
    moves = marks.with_frames(lambda w: {"move": F.col("mark_price") - F.lag("mark_price").over(w)}, back=1).done()
    votes = scores(spark, sf).join(moves.where("move is not null"), "step").withColumn(
        "action", F.least(F.greatest(F.floor(F.col("score") * 20) + 4, F.lit(0)), F.lit(8)))
    # Steps start at 1 after the first difference: still dense per model.
    return report(signals.expert_weights(Ordered.on_steps(votes, ["model"], "step"), 4, 1.02, 0.99),
                  "model", "step", "weight")


SQL_EXPERTS = with_views(
    ["fx_scores", "fx_factors"],
    m="select vec_id step, mark_price-lag(mark_price) over (order by vec_id) move from fx_factors",
    v="""select model, step, sign(move)*sign(least(greatest(floor(score*20)+4,0),8)-4) a from fx_scores join m using (step)
        where move is not null""",
    w="""select model, step, exp(sum(case when a>0 then ln(1.02) when a<0 then ln(0.99) else 0 end)
        over (partition by model order by step)) weight from v""",
) + f"\nSELECT model, step, {r6('weight')} FROM w"


def _reference(spark, sf):
    return scores(spark, sf).where("y_true = 1")


def positions(spark, sf):
    return report(signals.score_positions(scores(spark, sf), _reference(spark, sf), ["model"]))


SQL_POSITIONS = with_views(
    ["fx_scores"],
    a="select distinct model, score from fx_scores",
    n="select model, count(*) n from fx_scores where y_true=1 group by model",
    q="""select a.model, a.score, count(r.score)/any_value(n)::double quantile from a join n using (model)
        left join (select model, score from fx_scores where y_true=1) r on r.model=a.model and r.score<=a.score
        group by a.model, a.score""",
) + f"\nSELECT model, {r6('score', 'quantile')} FROM q"


def routed(spark, sf):
    all_scores = scores(spark, sf)
    found = signals.score_positions(all_scores, _reference(spark, sf), ["model"])
    rows = settle(all_scores.join(found, ["model", "score"]).select("model", "step", "quantile"), "quantiles")
    series = rolling.decayed_mean(Ordered.on_steps(rows, ["model"], "step"), "quantile", WINDOW, DECAY, "weight")
    made = signals.route(series.done(), "step", "model", "weight", THRESHOLD, FALLBACK)
    return report(made).withColumn("chosen", F.col("chosen").cast("long"))


SQL_ROUTED = SQL_POSITIONS[: SQL_POSITIONS.rindex("\nSELECT")] + f""",
l AS (select s.model, s.step, list(q.quantile) over (partition by s.model order by s.step
    rows between {WINDOW - 1} preceding and current row) l from fx_scores s join q on q.model=s.model and q.score=s.score),
w AS (select model, step, case when len(l)={WINDOW} then
    list_sum(list_transform(l, lambda v, i: v*pow({DECAY}, {WINDOW}-i)))/list_sum(list_transform(l, lambda v, i: pow({DECAY}, {WINDOW}-i))) end weight from l),
b AS (select step, max(weight) best_weight, arg_max(model, (weight, -model)) m from w where weight is not null group by step)
SELECT step, {r6('best_weight')}, cast(case when best_weight < {THRESHOLD} then {FALLBACK} else m end as bigint) chosen FROM b"""


def rejected(spark, sf):
    return report(signals.reject_rates(scores(spark, sf).where("y_true = 0"), _reference(spark, sf), ["model"], 10))


SQL_REJECTED = with_views(
    ["fx_scores"],
    t="select model, quantile_cont(score, 0.1) threshold from fx_scores where y_true=1 group by model",
    r="""select model, threshold, avg((score<threshold)::int::double) reject_rate from fx_scores join t using (model)
        where y_true=0 group by model, threshold""",
) + f"\nSELECT model, {r6('threshold', 'reject_rate')} FROM r"


def ranking(spark, sf):
    return report(signals.ranking_metrics(scores(spark, sf), ["model"]))


SQL_RANKING = with_views(
    ["fx_scores"],
    g="select model, score, sum(y_true)::double pos, sum(1-y_true)::double neg from fx_scores group by 1, 2",
    c="""select *, sum(pos) over w tp, sum(neg) over w fp, sum(pos) over (partition by model) p, sum(neg) over (partition by model) n
        from g window w as (partition by model order by score desc)""",
    m="""select model, sum(neg*(tp-pos/2))/any_value(p*n) roc_auc, sum(pos*tp/(tp+fp))/any_value(p) average_precision,
        min(fp) filter (tp/p >= 0.8)/any_value(n) fpr80 from c group by model""",
) + f"\nSELECT model, {r6('roc_auc', 'average_precision', 'fpr80')} FROM m"


def shares(spark, sf):
    rows = runs(spark, sf).select("run_id", (F.col("step") - 1).alias("pos"), (F.col("action") % 6).alias("chosen"))
    made = signals.chunk_shares(rows, ["run_id"], "pos", "chosen", 20, range(6))
    return report(made)


SQL_SHARES = with_views(
    ["fx_runs"],
    p="select run_id, step-1 pos, action%6 ch, count(*) over (partition by run_id) n from fx_runs",
    k="select run_id, least((pos//(n//20)), 19) chunk, ch from p",
    c='select run_id, chunk, unnest(range(6)) c from (select distinct run_id, chunk from k)',
    s="""select c.run_id, c.chunk, c.c, 100.0::double*count(k.ch) filter (k.ch=c.c)/count(*) pct from c
        join k on k.run_id=c.run_id and k.chunk=c.chunk group by 1, 2, 3""",
) + f"""
SELECT run_id, chunk, cast(c as int) "class", {cut('pct', 'percent')} FROM s"""


def markers(spark, sf):
    rows = runs(spark, sf).select("run_id", "step", "action")
    return signals.markers(Ordered.on_steps(rows, ["run_id"], "step"), "action").select("run_id", "step", "marker")


SQL_MARKERS = with_views(["fx_runs"], m="""select run_id, step,
    lead(action) over (partition by run_id order by step)-action d from fx_runs""") + """
SELECT run_id, step, case when d>0 then 'buy' else 'sell' end marker FROM m WHERE d <> 0"""

QUERIES = {
    "macd_signal": (macd, SQL_MACD),
    "imbalance_signal": (imbalance, SQL_IMBALANCE),
    "expert_weights": (experts, SQL_EXPERTS),
    "score_positions": (positions, SQL_POSITIONS),
    "model_routing": (routed, SQL_ROUTED),
    "reject_rates": (rejected, SQL_REJECTED),
    "ranking_metrics": (ranking, SQL_RANKING),
    "chunk_shares": (shares, SQL_SHARES),
    "trade_markers": (markers, SQL_MARKERS),
}
