"""Queries for execution cost, margin and ledgers (EX1-EX11, JN5, JN6, JN9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import HOUR, TIERS, book, cut, ledger, r6, report, runs, ticker, with_views
from barloom.operators import execution, joins, resample
from barloom.operators.ordering import Ordered

POSITIONS = (-8, -6, -4, -2, 0, 2, 4, 6, 8)
LEVERAGES = (1, 2, 5)
RATE, FEE = 0.0005, 0.0002

LEVELS = "(select unnest(range(1, 26)) i)"


def _mark():
    return 100 + (F.col("book_id") % 7 - 3) * 0.1


MARK_SQL = "(100+(book_id%7-3)*0.1::double)"


def costs(spark, sf):
    b = book(spark, sf).withColumn("quantity", (1 + F.col("book_id") % 40).cast("double"))
    made = execution.trade_costs(b, F.col("quantity"), _mark(), FEE)
    loss = made.withColumns({
        "long_loss": execution.open_loss(F.col("ask_price"), F.col("ask_size"), F.col("quantity"), _mark(), RATE, True),
        "short_loss": execution.open_loss(F.col("bid_price"), F.col("bid_size"), F.col("quantity"), _mark(), RATE, False),
    })
    return report(loss, "book_id", "quantity", "buy_value", "buy_filled", "sell_value", "sell_filled",
                  "buy_slippage", "sell_slippage", "buy_commission", "sell_commission", "long_loss", "short_loss")


SQL_COSTS = with_views(
    ["fx_book"],
    q=f"select *, cast(1+book_id%40 as double) quantity, {MARK_SQL} mark from fx_book",
    l=f"""select q.*, i, ask_price[i] ap, bid_price[i] bp,
        greatest(0, least(ask_size[i], quantity-coalesce(list_sum(ask_size[1:i-1]),0))) ta,
        greatest(0, least(bid_size[i], quantity-coalesce(list_sum(bid_size[1:i-1]),0))) tb from q, {LEVELS}""",
    c=f"""select book_id, quantity, any_value(mark) mark, sum(ta*ap) buy_value, sum(ta) buy_filled,
        sum(tb*bp) sell_value, sum(tb) sell_filled,
        sum(ta*greatest(0, ap*(1+{RATE})-mark)) long_loss, sum(tb*greatest(0, mark-bp*(1+{RATE}))) short_loss
        from l group by book_id, quantity""",
    s=f"""select *, buy_value-mark*buy_filled buy_slippage, mark*sell_filled-sell_value sell_slippage,
        {FEE}*buy_value buy_commission, {FEE}*sell_value sell_commission from c""",
) + "\nSELECT book_id, " + r6(
    "quantity", "buy_value", "buy_filled", "sell_value", "sell_filled", "buy_slippage", "sell_slippage",
    "buy_commission", "sell_commission", "long_loss", "short_loss") + " FROM s"


def margins(spark, sf):
    rows = ledger(spark, sf).withColumn("value", F.abs(F.col("wallet")) * (1 + F.col("step") % 13))
    return report(rows.select(
        "run_id", "step", joins.tier(F.col("value"), TIERS)["ratio"].alias("ratio"),
        execution.maintenance_margin(F.col("value"), TIERS).alias("margin"),
        execution.is_liquidated(F.col("wallet") / 100, F.col("unrealized"), F.col("value"), F.lit(-1.0), TIERS)
        .alias("liquidated"),
    ))


SQL_MARGINS = with_views(
    ["fx_ledger", "fx_tiers"],
    v="select *, abs(wallet)*(1+step%13) value from fx_ledger",
    m="""select run_id, step, ratio, value*ratio-deduction margin, wallet/100+unrealized balance
        from v join fx_tiers on value >= lo and (value < hi or hi is null)""",
) + f"\nSELECT run_id, step, {r6('ratio', 'margin')}, balance <= margin liquidated FROM m"


def reachable(spark, sf):
    i = F.col("book_id")
    lev = F.get(F.array(*[F.lit(v) for v in LEVERAGES]), (i % 3).cast("int"))
    made = execution.reachable(
        book(spark, sf), POSITIONS, LEVERAGES, _mark(), (i % 9 - 4) * 2, lev,
        (300 + i % 7 * 200).cast("double"), (i % 11 - 5).cast("double"), RATE, FEE)
    return made.select("book_id", F.col("target").cast("long").alias("target"),
                       F.col("target_leverage").cast("long").alias("target_leverage"))


SQL_REACHABLE = with_views(
    ["fx_book"],
    st=f"""select *, {MARK_SQL} mark, (book_id%9-4)*2 pos, [1,2,5][book_id%3+1] lev0,
        cast(300+book_id%7*200 as double)+cast(book_id%11-5 as double) balance,
        list_sum(ask_size) depth_up, list_sum(bid_size) depth_down from fx_book""",
    g="""select st.*, t, lev, abs(t-pos)::double size from st,
        (select unnest([-8,-6,-4,-2,0,2,4,6,8]) t), (select unnest([1,2,5]) lev)
        where t <= case when pos<0 then least(0, least(pos+depth_up, 8)) else least(pos+depth_up, 8) end
          and t >= case when pos>0 then greatest(0, greatest(pos-depth_down, -8)) else greatest(pos-depth_down, -8) end""",
    l=f"""select g.*, i,
        greatest(0, least(ask_size[i], size-coalesce(list_sum(ask_size[1:i-1]),0))) ta,
        greatest(0, least(bid_size[i], size-coalesce(list_sum(bid_size[1:i-1]),0))) tb from g, {LEVELS}""",
    c=f"""select book_id, t, lev, pos, lev0, balance, mark, size, sum(ta*ask_price[i]) buy_value, sum(tb*bid_price[i]) sell_value,
        sum(ta*greatest(0, ask_price[i]*(1+{RATE})-mark)) long_loss,
        sum(tb*greatest(0, mark-bid_price[i]*(1+{RATE}))) short_loss from l group by all""",
    v=f"""select *, abs(mark*pos/lev) held, case when t>0 then long_loss else short_loss end loss,
        case when pos>0 then balance+sell_value-mark*size-{FEE}*sell_value
             else balance-(buy_value-mark*size)-{FEE}*buy_value end after from c""",
) + """
SELECT book_id, cast(t as bigint) target, cast(lev as bigint) target_leverage FROM v WHERE
 case when t=pos then lev=lev0 or balance >= abs(mark*t/lev)
  when abs(t)>abs(pos) then (lev=lev0 or balance>=held) and balance-held >= loss+size*mark/lev
  else lev=lev0 or after >= abs(mark*t/lev) end"""


def transitions(spark, sf):
    b = book(spark, sf).withColumn("mark", _mark())
    series = Ordered.on_steps(b, [], "book_id")
    nexts = series.with_frames(lambda w: {"next_mark": F.lead("mark").over(w)}, ahead=1).done()
    nexts = nexts.where("next_mark is not null").withColumns({
        "funding_rate": (F.col("book_id") % 5 - 2) / 1000.0, "funds": F.col("book_id") % 96 == 95})
    made = execution.transition_rewards(nexts, (-4, 0, 4, 8), (1, 5), RATE, FEE, 700.0)
    return report(made.select(
        "book_id", *[F.col(c).cast("long").alias(c) for c in
                     ("from_position", "from_leverage", "to_position", "to_leverage")], "reward"))


SQL_TRANSITIONS = with_views(
    ["fx_book"],
    st=f"""select *, {MARK_SQL} mark, lead({MARK_SQL}) over (order by book_id) next_mark,
        (book_id%5-2)/1000.0::double fr, book_id%96=95 funds from fx_book""",
    states="select p, v from (values (-4,1),(-4,5),(0,1),(4,1),(4,5),(8,1),(8,5)) t(p, v)",
    g="""select st.*, a.p p0, a.v v0, b.p p1, b.v v1, abs(b.p-a.p)::double size
        from st, states a, states b where next_mark is not null""",
    l=f"""select g.*, i,
        greatest(0, least(ask_size[i], size-coalesce(list_sum(ask_size[1:i-1]),0))) ta,
        greatest(0, least(bid_size[i], size-coalesce(list_sum(bid_size[1:i-1]),0))) tb from g, {LEVELS}""",
    c=f"""select book_id, mark, next_mark, fr, funds, p0, v0, p1, v1, size,
        case when p1>p0 then sum(ta*ask_price[i]) else sum(tb*bid_price[i]) end value,
        case when p1>p0 then any_value(list_sum(ask_size)) else any_value(list_sum(bid_size)) end depth,
        case when p1>p0 then sum(ta*greatest(0, ask_price[i]*(1+{RATE})-mark))
             else sum(tb*greatest(0, mark-bid_price[i]*(1+{RATE}))) end loss
        from l group by book_id, mark, next_mark, fr, funds, p0, v0, p1, v1, size""",
    v="""select *, case when p1>p0 then mark*size-value else value-mark*size end gain,
        abs(mark*p0/v1) held from c""",
    w=f"""select *, case when p0*p1<0 or size>depth or not (
          case when abs(p1)>abs(p0) then (v0=v1 or 700>=held) and mark*size/v1+loss <= 700-held
          else v0=v1 or 700+gain-{FEE}*value >= abs(mark*p1/v1) end)
        then -1e10 else gain-{FEE}*value+p1*(next_mark-mark)-case when funds then p1*next_mark*fr else 0 end end reward
        from v""",
) + f"""
SELECT book_id, cast(p0 as bigint) from_position, cast(v0 as bigint) from_leverage,
 cast(p1 as bigint) to_position, cast(v1 as bigint) to_leverage, {r6('reward')} FROM w"""


def path(spark, sf):
    """Costs and earnings along a given path of positions over the snapshots."""
    i = F.col("book_id")
    rows = book(spark, sf).withColumns({
        "mark": _mark(), "position": ((F.floor(i / 3) * 7) % 9 - 4) * 2, "leverage": F.get(F.array(*[F.lit(v) for v in LEVERAGES]), (i % 3).cast("int"))})
    made = execution.path_costs(Ordered.on_steps(rows, [], "book_id"), "mark", "position", "leverage", RATE, FEE)
    return report(made.select("book_id", F.col("position").cast("long").alias("position"), "filled", "slippage", "commission", "open_loss",
                              "margin", "price_pnl"))


SQL_PATH = with_views(
    ["fx_book"],
    st=f"select *, {MARK_SQL} mark, (((book_id//3)*7)%9-4)*2 p1, [1,2,5][book_id%3+1] lev from fx_book",
    g="""select *, abs(p1-p0)::double size from (select *, coalesce(lag(p1) over o, 0) p0, lead(mark) over o nm from st
        window o as (order by book_id))""",
    l=f"""select g.*, i,
        greatest(0, least(ask_size[i], size-coalesce(list_sum(ask_size[1:i-1]),0))) ta,
        greatest(0, least(bid_size[i], size-coalesce(list_sum(bid_size[1:i-1]),0))) tb from g, {LEVELS}""",
    c=f"""select book_id, p0, p1, lev, mark, nm, size,
        case when p1>p0 then sum(ta*ask_price[i]) else sum(tb*bid_price[i]) end val,
        case when p1>p0 then sum(ta) else sum(tb) end fill,
        case when p1>p0 then sum(ta*greatest(0, ask_price[i]*(1+{RATE})-mark)) else sum(tb*greatest(0, mark-bid_price[i]*(1+{RATE}))) end loss
        from l group by book_id, p0, p1, lev, mark, nm, size""",
    v=f"""select book_id, p1, fill filled, case when p1>p0 then val-mark*fill else mark*fill-val end slippage, {FEE}*val commission,
        case when abs(p1)>abs(p0) then loss else 0 end open_loss, abs(mark*p1/lev) margin, p1*(nm-mark) price_pnl from c""",
) + f"""
SELECT book_id, p1::bigint AS position, {r6('filled', 'slippage', 'commission', 'open_loss', 'margin', 'price_pnl')} FROM v"""


def actions(spark, sf):
    a = (F.col("step") % 25).cast("int")
    part = execution.action_parts(a, POSITIONS, LEVERAGES)
    made = runs(spark, sf).withColumns({
        "code": a, "_p": part, "_choices": F.array(*[(F.col("step") * k % 25).cast("int") for k in (3, 7, 11)])})
    return made.select(
        "run_id", "step", F.col("code").cast("long").alias("code"),
        F.col("_p.position").cast("long").alias("position"), F.col("_p.leverage").cast("long").alias("leverage"),
        execution.action_of(F.col("_p.position"), F.col("_p.leverage"), POSITIONS, LEVERAGES).cast("long").alias("back"),
        execution.nearest(a, F.col("_choices")).cast("long").alias("nearest"),
        execution.smaller_position(F.col("_p.position"), POSITIONS).cast("long").alias("smaller"))


SQL_ACTIONS = with_views(
    ["fx_runs"],
    c="select run_id, step, step%25 code, [step*3%25, step*7%25, step*11%25] ch from fx_runs",
    a="""select * from (values (0,-8,1),(1,-8,2),(2,-8,5),(3,-6,1),(4,-6,2),(5,-6,5),(6,-4,1),(7,-4,2),(8,-4,5),
        (9,-2,1),(10,-2,2),(11,-2,5),(12,0,1),(13,2,1),(14,2,2),(15,2,5),(16,4,1),(17,4,2),(18,4,5),
        (19,6,1),(20,6,2),(21,6,5),(22,8,1),(23,8,2),(24,8,5)) t(act, "position", leverage)""",
    p="select * from c join a on act=code",
) + """
SELECT run_id, step, code, cast("position" as bigint) "position", cast(leverage as bigint) leverage, code back,
 cast(list_sort([{'d': abs(x-code), 'x': x} for x in ch])[1].x as bigint) nearest,
 cast(case when "position">0 then list_max([x for x in [-8,-6,-4,-2,0,2,4,6,8] if x<"position"])
  when "position"<0 then list_min([x for x in [-8,-6,-4,-2,0,2,4,6,8] if x>"position"]) else 0 end as bigint) smaller
FROM p"""


def countdowns(spark, sf):
    made = ticker(spark, sf).withColumn("_c", execution.countdown(F.col("funding_timestamp"), F.col("ts")))
    return report(made.select("event_id", "_c.hours", "_c.minutes", "_c.seconds"))


SQL_COUNTDOWN = with_views(
    ["fx_ticker"], d="select event_id, (epoch_us(funding_timestamp)-epoch_us(ts))/1e6 d from fx_ticker",
    c="select event_id, d, d-60*floor(d/60) AS sec from d",
) + f"""
SELECT event_id, cast(floor(d/3600) as bigint) AS hours, cast(floor((d-3600*floor(d/3600))/60) as bigint) AS minutes,
 {cut('sec', '"seconds"')} FROM c"""


def _hourly_ticker(spark, sf):
    t = ticker(spark, sf).withColumn("position", (F.col("event_id") % 9 - 4).cast("double"))
    return resample.downscale(t, HOUR, ["mark_price", "funding_rate", "funding_timestamp", "position"],
                              order=["ts", "event_id"])


def ledgers(spark, sf):
    filled = resample.complete_bars(_hourly_ticker(spark, sf), HOUR)
    made = execution.ledger(filled, HOUR, FEE)
    return report(made, "symbol", "bucket", "price_pnl", "funding_fee", "commission", "wallet", "margin_balance")


TICKER_SQL = {
    "h": """select symbol, date_trunc('hour', ts) bucket, arg_min(mark_price, ts) mark_price,
        arg_min(funding_rate, ts) funding_rate, arg_min(funding_timestamp, ts) funding_timestamp,
        arg_min(cast(event_id%9-4 as double), ts) "position" from fx_ticker group by 1, 2""",
}
SQL_LEDGERS = with_views(
    ["fx_ticker"], **TICKER_SQL,
    g="""select symbol, unnest(generate_series(min(bucket), max(bucket), interval 1 hour)) bucket
        from h group by symbol""",
    f="select symbol, bucket, " + ", ".join(
        f'last_value({c} ignore nulls) over (partition by symbol order by bucket) {c}'
        for c in ("mark_price", "funding_rate", "funding_timestamp", '"position"')
    ) + " from g left join h using (symbol, bucket)",
    w="""select *, lag("position") over s p0, lag(mark_price) over s m0, lag(funding_timestamp) over s f0 from f
        window s as (partition by symbol order by bucket)""",
    r=f"""select symbol, bucket, coalesce(p0*(mark_price-m0),0) price_pnl,
        case when bucket=f0 then p0*m0*funding_rate else 0 end funding_fee,
        {FEE}*mark_price*abs("position"-coalesce(p0,0)) commission from w""",
    t="""select *, 1e5-sum(funding_fee+commission) over s wallet,
        1e5-sum(funding_fee+commission) over s+sum(price_pnl) over s margin_balance from r
        window s as (partition by symbol order by bucket)""",
) + f"""
SELECT symbol, epoch_us(bucket) bucket, {r6('price_pnl', 'funding_fee', 'commission', 'wallet', 'margin_balance')} FROM t"""


def funding(spark, sf):
    rows = _hourly_ticker(spark, sf).withColumnRenamed("bucket", "ts")
    return report(joins.funding_events(rows, ["ts"]), "symbol", "ts", "mark_price", "funding_rate")


SQL_FUNDING = with_views(
    ["fx_ticker"], **TICKER_SQL,
    w="select *, lag(funding_timestamp) over (partition by symbol order by bucket) f0 from h",
) + f"""
SELECT symbol, epoch_us(bucket) ts, {r6('mark_price', 'funding_rate')} FROM w WHERE bucket = f0"""

QUERIES = {
    "trade_costs": (costs, SQL_COSTS),
    "margin_tiers": (margins, SQL_MARGINS),
    "reachable_positions": (reachable, SQL_REACHABLE),
    "transition_rewards": (transitions, SQL_TRANSITIONS),
    "path_costs": (path, SQL_PATH),
    "action_codes": (actions, SQL_ACTIONS),
    "funding_countdown": (countdowns, SQL_COUNTDOWN),
    "position_ledger": (ledgers, SQL_LEDGERS),
    "funding_events": (funding, SQL_FUNDING),
}
