"""Queries for run metrics, returns and trial selection (MT, SC, TR, PR10, PR11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import cut, ledger, r6, report, runs, trials, with_views
from barloom.operators import runs as metrics
from barloom.operators import trials as choice
from barloom.operators.ordering import Ordered
from barloom.session import settle

FREQ, TAIL, PENALTY, DISCOUNT, LAMBDA, STEPS = 48, 500, 0.5, 0.99, 0.95, 5
VIEWS = ["fx_ledger"]


def _required(spark, sf, log=None):
    return metrics.required_money(ledger(spark, sf, log))


def _log(spark, sf):
    return settle(runs(spark, sf), "runs")


REQUIRED = """select run_id, arg_min(wallet, step) - least(
    min(wallet+unrealized-initial_margin-need1), min(wallet+unrealized-maintenance)) required
    from (select *, lead(need) over (partition by run_id order by step) need1 from {0}) group by run_id"""
CURVE = {
    "rq": REQUIRED.format("fx_ledger"),
    "eq": """select run_id, step, reward, required+sum(reward) over (partition by run_id order by step) equity
        from fx_runs join rq using (run_id)""",
}
METRICS = CURVE | {
    "br": f"""select run_id, block, lead(equity) over (partition by run_id order by block)/(equity+1e-12)-1 x
        from (select run_id, (step-1)//{FREQ} block, equity from eq where (step-1)%{FREQ}=0)""",
    "sp": """select run_id, avg(x) m, stddev_pop(x) daily_vol, stddev_pop(x) filter (x<0) downside_deviation_daily
        from br where x is not null group by run_id""",
    "md": """select run_id, greatest(max((pk-equity)/(pk+1e-12)), 0) mdd, arg_max(equity, step)/(arg_min(equity, step)+1e-12)-1 tr
        from (select *, max(equity) over (partition by run_id order by step) pk from eq) group by run_id""",
    "mt": """select run_id, tr, m/daily_vol*sqrt(365) annual_sr, m*365/nullif(mdd,0) daily_cr,
        tr/nullif(downside_deviation_daily,0) daily_SoR, daily_vol, mdd, downside_deviation_daily from md left join sp using (run_id)""",
}
NAMES = ("tr", "annual_sr", "daily_cr", "daily_SoR", "daily_vol", "mdd", "downside_deviation_daily")


def required(spark, sf):
    return report(_required(spark, sf))


SQL_REQUIRED = with_views(VIEWS, rq=CURVE["rq"]) + f"\nSELECT run_id, {r6('required')} FROM rq"


def differences(spark, sf):
    series = Ordered.on_steps(ledger(spark, sf).select("run_id", "step", "wallet"), ["run_id"], "step")
    return report(metrics.differences(series, "wallet", "change"), "run_id", "step", "change")


SQL_DIFFERENCES = with_views(VIEWS, d="""select run_id, step,
    lead(wallet) over (partition by run_id order by step)-wallet change from fx_ledger""") + \
    f"\nSELECT run_id, step, {r6('change')} FROM d WHERE change IS NOT NULL"


def equity(spark, sf):
    log = _log(spark, sf)
    return report(metrics.equity(log, _required(spark, sf, log)).done(), "run_id", "step", "equity")


SQL_EQUITY = with_views(VIEWS, **CURVE) + f"\nSELECT run_id, step, {r6('equity')} FROM eq"


def returns(spark, sf):
    log = _log(spark, sf)
    curve = metrics.equity(log, _required(spark, sf, log)).done()
    return report(metrics.block_returns(curve, FREQ))


SQL_RETURNS = with_views(VIEWS, **METRICS) + f"\nSELECT run_id, block, {cut('x', 'block_return')} FROM br WHERE x IS NOT NULL"


def run_table(spark, sf):
    log = _log(spark, sf)
    return report(metrics.run_metrics(log, _required(spark, sf, log), FREQ))


SQL_METRICS = with_views(VIEWS, **METRICS) + f"\nSELECT run_id, {r6(*NAMES)} FROM mt"


def shown(spark, sf):
    log = _log(spark, sf)
    made = metrics.run_metrics(log, _required(spark, sf, log), FREQ)
    return metrics.presentation(made)


SQL_SHOWN = with_views(VIEWS, **METRICS) + """
SELECT run_id "Algorithm", round(tr*100,2) "TR(%)", round(annual_sr,2) "Annual SR", round(daily_cr,2) "Daily CR",
 round(daily_SoR,2) "Daily SoR", round(daily_vol*100,2) "Daily Vol(%)", round(mdd*100,2) "MDD(%)",
 round(downside_deviation_daily,2) "Downside Deviation(%)" FROM mt"""


def holding(spark, sf):
    log = _log(spark, sf)
    return report(metrics.holding_drawdown(settle(ledger(spark, sf, log), "ledger"), log, TAIL))


SQL_HOLDING = with_views(
    VIEWS,
    e="select run_id, max(step)-%d cut from fx_runs group by run_id" % TAIL,
    lt="select fx_ledger.* from fx_ledger join e using (run_id) where step > cut",
    rq=REQUIRED.format("lt"),
    eq="""select run_id, step, required+1e-12+sum(reward) over (partition by run_id order by step) equity
        from fx_runs join e using (run_id) join rq using (run_id) where step > cut""",
    md="""select run_id, greatest(max((pk-equity)/pk), 0) mdd
        from (select *, max(equity) over (partition by run_id order by step) pk from eq) group by run_id""",
) + f"\nSELECT run_id, {r6('mdd')} FROM md"


def turnover(spark, sf):
    return report(metrics.turnover(runs(spark, sf)))


SQL_TURNOVER = with_views(
    ["fx_runs"], t="""select run_id, sum(abs(action-w))/4.0::double turnover, count(*) filter (action<>w) changes
    from (select *, lag(action,1,4) over (partition by run_id order by step) w from fx_runs) group by run_id""",
) + f"\nSELECT run_id, {r6('turnover')}, changes FROM t"


def trades(spark, sf):
    return report(metrics.closed_trades(settle(runs(spark, sf), "runs")))


TRADES = {
    # Steps of a run one after the other: the sum carried over from the row before.
    "walk(run_id, step, acc, done)": """select run_id, 1::bigint, reward, false from fx_runs where step=1 union all
        select w.run_id, r.step, case when w.done then 0 else w.acc end + r.reward,
            r.action=4 and case when w.done then 0 else w.acc end <> 0
        from walk w join fx_runs r on r.run_id=w.run_id and r.step=w.step+1""",
    "ends": "select run_id, max(step) m from fx_runs group by run_id",
    "tr": """select run_id, step, acc trade_return, false is_open from walk where done union all
        select run_id, step, case when done then 0 else acc end, true from walk join ends using (run_id) where step=m""",
}


def _recursive(**views: str) -> str:
    return with_views(["fx_runs"], **views).replace("WITH ", "WITH RECURSIVE ", 1)


SQL_TRADES = _recursive(**TRADES) + f"\nSELECT run_id, step, {r6('trade_return')}, is_open FROM tr"


def trade_table(spark, sf):
    return report(metrics.trade_metrics(metrics.closed_trades(settle(runs(spark, sf), "runs"))))


SQL_TRADE_TABLE = _recursive(
    **TRADES,
    m="""select run_id, count(*) n_trades, count(*) filter (trade_return>0)/(count(*)+1e-12) win_rate,
        coalesce(sum(trade_return) filter (trade_return>0),0)/(abs(coalesce(sum(trade_return) filter (trade_return<0),0))+1e-12) reward_risk,
        coalesce(avg(trade_return) filter (trade_return>0),0)/(abs(coalesce(avg(trade_return) filter (trade_return<0),0))+1e-12) mean_reward_risk
        from tr group by run_id""",
) + f"\nSELECT run_id, n_trades, {r6('win_rate', 'reward_risk', 'mean_reward_risk')} FROM m"


def behaviour(spark, sf):
    """Behaviour of each run in one row: turnover, changes, trades, win rate and both reward ratios."""
    log = settle(runs(spark, sf), "runs")
    return report(metrics.behaviour(log))


SQL_BEHAVIOUR = SQL_TRADE_TABLE.rsplit("\nSELECT", 1)[0] + f""",
t as (select run_id, sum(abs(action-w))/4.0::double turnover, count(*) filter (action<>w) changes
    from (select *, lag(action,1,4) over (partition by run_id order by step) w from fx_runs) group by run_id)
SELECT run_id, {r6('turnover')}, changes, n_trades, {r6('win_rate', 'reward_risk', 'mean_reward_risk')} FROM m JOIN t USING (run_id)"""


def _terminal(spark, sf):
    return runs(spark, sf).withColumns({
        "terminal": F.col("step") % 37 == 0, "value": (F.col("action") * 10).cast("double")})


def n_step(spark, sf):
    return report(metrics.n_step_returns(_terminal(spark, sf), STEPS, DISCOUNT))


def _n_step_sql() -> str:
    value, stop = "0", str(STEPS)
    for i in range(STEPS - 1, -1, -1):
        value = f"(r{i}+{DISCOUNT}*(case when t{i} then 0 else {value} end))"
        stop = f"(case when t{i} then {i + 1} else {stop} end)"
    leads = ", ".join(f"lead(reward,{i}) over w r{i}, lead(step%37=0,{i}) over w t{i}" for i in range(STEPS))
    return with_views(
        ["fx_runs"], l=f"select run_id, step, {leads} from fx_runs window w as (partition by run_id order by step)",
        v=f"select run_id, step, {value} n_step_return, step+{stop} next_step, {' or '.join(f't{i}' for i in range(STEPS))} done from l where r{STEPS - 1} is not null",
    ) + f"\nSELECT run_id, step, {r6('n_step_return')}, next_step, done FROM v"


def to_go(spark, sf):
    return report(metrics.reward_to_go(runs(spark, sf), DISCOUNT))


def _discounted_sql(x: str, factor: float, source: str) -> str:
    """Discounted sums by a recursion from the last step to the first."""
    return f"""select run_id, max(step), arg_max({x}, step) from {source} group by run_id union all
        select g.run_id, s.step, s.{x}+{factor}*g.y from go g join {source} s on s.run_id=g.run_id and s.step=g.step-1"""


SQL_TO_GO = _recursive(**{"go(run_id, step, y)": _discounted_sql("reward", DISCOUNT, "fx_runs")}) + \
    f"\nSELECT run_id, step, {cut('y', 'reward_to_go')} FROM go"


def advantages(spark, sf):
    return report(metrics.advantages(settle(_terminal(spark, sf), "terminal"), DISCOUNT, LAMBDA))


SQL_ADVANTAGES = _recursive(**{
    "dl": f"""select run_id, step, action*10.0::double v, reward+{DISCOUNT}*coalesce(lead(action*10.0::double) over (partition by run_id order by step),0)
        *(case when step%37=0 then 0 else 1 end)-action*10.0::double d from fx_runs""",
    "go(run_id, step, y)": _discounted_sql("d", DISCOUNT * LAMBDA, "dl"),
    "av": "select run_id, step, y advantage, y+v value_target from go join dl using (run_id, step)",
}) + f"\nSELECT run_id, step, {r6('advantage', 'value_target')} FROM av"

KEYS = ["label", "initial_action", "bin_index", "epoch"]


def _summary(spark, sf):
    turned = trials(spark, sf).withColumn("turnover", F.col("df_length") / 10)
    return choice.trial_summary(turned, KEYS)


SUMMARY = {
    "tb": """select label, initial_action, bin_index, epoch, avg(reward_sum/df_length) reward_mean,
        stddev_pop(reward_sum/df_length) reward_std, avg(df_length/10) mean_turnover from fx_trials group by all""",
}
COLS = ("reward_mean", "reward_std", "mean_turnover")


def summary(spark, sf):
    return report(_summary(spark, sf).orderBy("epoch", "label", "initial_action", "bin_index"))


SQL_SUMMARY = with_views(["fx_trials"], **SUMMARY) + f"\nSELECT {', '.join(KEYS)}, {r6(*COLS)} FROM tb"


def best_trials(spark, sf):
    return report(choice.best_trials(_summary(spark, sf), PENALTY))


SQL_BEST_TRIALS = with_views(
    ["fx_trials"], **SUMMARY,
    k=f"""select *, row_number() over (partition by epoch, label, initial_action
        order by reward_mean-{PENALTY}*reward_std desc, bin_index) k from tb""",
) + f"\nSELECT {', '.join(KEYS)}, {r6(*COLS)} FROM k WHERE k = 1"


def best_conditions(spark, sf):
    made = _summary(spark, sf).withColumn("epoch_path", F.concat(F.lit("runs/epoch_"), F.col("epoch"), F.lit("/model")))
    made = choice.with_epoch(made.drop("epoch"), out="epoch")
    return report(choice.best_trials(made.drop("epoch_path"), 0.0, within=()))


SQL_BEST_CONDITIONS = with_views(
    ["fx_trials"], **SUMMARY,
    k="select *, row_number() over (partition by label, initial_action order by reward_mean desc, bin_index) k from tb",
) + f"\nSELECT {', '.join(KEYS)}, {r6(*COLS)} FROM k WHERE k = 1"


def best_labels(spark, sf):
    return report(choice.best_per_label(_summary(spark, sf)))


SQL_BEST_LABELS = with_views(
    ["fx_trials"], **SUMMARY,
    g="select label, bin_index, epoch, avg(reward_mean) reward_max from tb group by all",
    k="select *, row_number() over (partition by label order by reward_max desc, bin_index, epoch) k from g",
) + f"\nSELECT label, bin_index, epoch, {r6('reward_max')} FROM k WHERE k = 1"

EPOCHS = SUMMARY | {
    "ea": f"select epoch, initial_action, avg(reward_mean-{PENALTY}*reward_std) a from tb group by all",
    "es": "select epoch, avg(a) score from ea group by epoch",
}


def epochs(spark, sf):
    scores = settle(choice.epoch_scores(_summary(spark, sf), PENALTY), "epochs")
    best = choice.best_rows(scores, [], F.col("score"), ["epoch"]).select("epoch", F.lit(True).alias("is_best"))
    return report(scores.join(best, "epoch", "left").fillna(False, ["is_best"]))


SQL_EPOCHS = with_views(["fx_trials"], **EPOCHS) + f"""
SELECT epoch, {r6('score')}, epoch = (select arg_max(epoch, (score, -epoch)) from es) is_best FROM es"""


def best_bins(spark, sf):
    return report(choice.best_bins(settle(_summary(spark, sf), "summary"), PENALTY), *KEYS, *COLS)


SQL_BEST_BINS = with_views(
    ["fx_trials"], **EPOCHS,
    i="select * from tb where epoch = (select arg_max(epoch, (score, -epoch)) from es)",
    g="select label, bin_index, avg(reward_mean) m from i group by all",
    k="select *, row_number() over (partition by label order by m desc, bin_index) k from g",
) + f"\nSELECT {', '.join('i.' + k for k in KEYS)}, {r6(*COLS)} FROM i JOIN k ON k.label=i.label AND k.bin_index=i.bin_index WHERE k.k = 1"

HIGH, LOW = ("tr", "sr", "cr", "sor"), ("vol", "mdd", "down")


def _indicators(spark, sf):
    """Seven indicator columns per (bin, epoch) of the trials."""
    normal = F.col("reward_sum") / F.col("df_length")
    return trials(spark, sf).groupBy("bin_index", "epoch").agg(
        F.avg("reward_sum").alias("tr"), F.avg(normal).alias("sr"), F.max(normal).alias("cr"),
        F.avg("df_length").alias("sor"), F.stddev_pop(normal).alias("vol"), F.min("reward_sum").alias("mdd"),
        F.stddev_pop("reward_sum").alias("down"))


INDICATORS = {
    "nd": """select bin_index, epoch, avg(reward_sum) tr, avg(reward_sum/df_length) sr, max(reward_sum/df_length) cr,
        avg(df_length) sor, stddev_pop(reward_sum/df_length) vol, min(reward_sum) mdd, stddev_pop(reward_sum) down
        from fx_trials group by all""",
    "un": " union all ".join([f"select *, '{c}' indicator, {c} s from nd" for c in HIGH]
                             + [f"select *, '{c}', -{c} from nd" for c in LOW]),
    "rk": 'select *, row_number() over (partition by indicator order by s desc, bin_index, epoch) "rank" from un',
}


def top(spark, sf):
    made = choice.top_per_indicator(_indicators(spark, sf), HIGH, LOW, 5, ["bin_index", "epoch"])
    return report(made.withColumn("rank", F.col("rank").cast("long")))


SQL_TOP = with_views(["fx_trials"], **INDICATORS) + f"""
SELECT bin_index, epoch, indicator, "rank", {r6(*HIGH, *LOW)} FROM rk WHERE "rank" <= 5"""


def best(spark, sf):
    return report(choice.best_per_indicator(_indicators(spark, sf), HIGH, LOW, ["bin_index", "epoch"]))


SQL_BEST = with_views(["fx_trials"], **INDICATORS) + f"""
SELECT bin_index, epoch, indicator, {r6(*HIGH, *LOW)} FROM rk WHERE "rank" = 1"""

QUERIES = {
    "required_money": (required, SQL_REQUIRED),
    "wallet_differences": (differences, SQL_DIFFERENCES),
    "equity_curve": (equity, SQL_EQUITY),
    "block_returns": (returns, SQL_RETURNS),
    "run_metrics": (run_table, SQL_METRICS),
    "metric_presentation": (shown, SQL_SHOWN),
    "holding_drawdown": (holding, SQL_HOLDING),
    "turnover": (turnover, SQL_TURNOVER),
    "closed_trades": (trades, SQL_TRADES),
    "trade_metrics": (trade_table, SQL_TRADE_TABLE),
    "behaviour_metrics": (behaviour, SQL_BEHAVIOUR),
    "n_step_returns": (n_step, _n_step_sql()),
    "reward_to_go": (to_go, SQL_TO_GO),
    "advantages": (advantages, SQL_ADVANTAGES),
    "trial_summary": (summary, SQL_SUMMARY),
    "best_trials": (best_trials, SQL_BEST_TRIALS),
    "best_conditions": (best_conditions, SQL_BEST_CONDITIONS),
    "best_per_label": (best_labels, SQL_BEST_LABELS),
    "epoch_scores": (epochs, SQL_EPOCHS),
    "best_bins": (best_bins, SQL_BEST_BINS),
    "top_per_indicator": (top, SQL_TOP),
    "best_per_indicator": (best, SQL_BEST),
}
