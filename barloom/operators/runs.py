"""Metrics of backtest runs (MT1-MT14, PR11) and return recursions (TR1-TR3)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.ordering import BLOCK, GRID_ROWS_PER_BLOCK, Ordered, running_max, running_sum
from barloom.session import join_per_key, settle

TINY = 1e-12
FLAT = 4  # fixed code of the flat action
HALF_RANGE = 4.0
DAYS = 365


def differences(series: Ordered, value: str, out: str) -> DataFrame:
    """MT1: change to the next step; the last step has none."""
    made = series.with_frames(lambda w: {out: F.lead(value).over(w) - F.col(value)}, ahead=1).done()
    return made.where(F.col(out).isNotNull())


def required_money(ledger: DataFrame, key: str = "run_id", rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """MT2: money a run needs so that it can open its positions and keep its margin."""
    series = Ordered.on_steps(ledger, [key], "step", rows_per_block)
    rows = series.with_frames(lambda w: {"_need": F.lead("need").over(w)}, ahead=1).done()
    balance = F.col("wallet") + F.col("unrealized")
    return rows.groupBy(key).agg(
        (F.min_by("wallet", "step") - F.least(
            F.min(balance - F.col("initial_margin") - F.col("_need")),
            F.min(balance - F.col("maintenance")),
        )).alias("required"))


def equity(rewards: DataFrame, required: DataFrame, key: str = "run_id",
           rows_per_block: int = GRID_ROWS_PER_BLOCK) -> Ordered:
    """MT3: required money plus the running sum of rewards."""
    series = Ordered.on_steps(rewards.select(key, "step", "reward"), [key], "step", rows_per_block)
    summed = series.running(_sum=running_sum(F.col("reward")))
    return summed.on(join_per_key(summed.df, required, key).withColumn("equity", F.col("required") + F.col("_sum")).drop("_sum"))


def block_returns(curve: DataFrame, freq: int, key: str = "run_id",
                  rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """MT5: returns between every ``freq``-th step from the first; a part block has none."""
    every = curve.where((F.col("step") - 1) % freq == 0).select(
        key, F.floor((F.col("step") - 1) / freq).alias("block"), "equity")
    series = Ordered.on_steps(every, [key], "block", rows_per_block)
    made = series.with_frames(
        lambda w: {"block_return": F.lead("equity").over(w) / (F.col("equity") + TINY) - 1}, ahead=1).done()
    return made.where("block_return is not null").drop("equity")


def drawdowns(series: Ordered, key: str = "run_id", tiny: float = TINY) -> DataFrame:
    """MT7: largest fall from a running peak, as a share of the peak."""
    peaks = series.running(_peak=running_max(F.col("equity"))).done()
    fall = (F.col("_peak") - F.col("equity")) / (F.col("_peak") + tiny)
    return peaks.groupBy(key).agg(F.greatest(F.max(fall), F.lit(0.0)).alias("mdd"))


def run_metrics(rewards: DataFrame, required: DataFrame, freq: int, key: str = "run_id",
                rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """MT4-MT8, MT14: one row of metrics per run."""
    curve = equity(rewards, required, key, rows_per_block)
    # Read by the totals, the block returns and twice by the drawdown.
    curve = curve.on(settle(curve.df, "equity"))
    rows = curve.done()
    totals = rows.groupBy(key).agg(
        (F.max_by("equity", "step") / (F.min_by("equity", "step") + TINY) - 1).alias("tr"))
    returns = block_returns(rows, freq, key, rows_per_block)
    change = F.col("block_return")
    spread = returns.groupBy(key).agg(
        F.avg(change).alias("_mean"), F.stddev_pop(change).alias("daily_vol"),
        F.stddev_pop(F.when(change < 0, change)).alias("downside_deviation_daily"))
    return totals.join(spread, key, "left").join(drawdowns(curve, key), key).select(
        key, "tr",
        (ratio(F.col("_mean"), F.col("daily_vol")) * DAYS**0.5).alias("annual_sr"),
        ratio(F.col("_mean") * DAYS, F.col("mdd")).alias("daily_cr"),
        ratio(F.col("tr"), F.col("downside_deviation_daily")).alias("daily_SoR"),
        "daily_vol", "mdd", "downside_deviation_daily")


def presentation(metrics: DataFrame, key: str = "run_id") -> DataFrame:
    """PR11: percent scale for return, volatility and drawdown, two decimals."""
    scaled = metrics.withColumns({c: F.col(c) * 100 for c in ("tr", "daily_vol", "mdd")})
    numbers = [c for c in metrics.columns if c != key]
    # Fixed labels of the published table.
    return scaled.withColumns({c: F.round(c, 2) for c in numbers}).withColumnsRenamed({
        key: "Algorithm", "tr": "TR(%)", "annual_sr": "Annual SR", "daily_cr": "Daily CR",
        "daily_SoR": "Daily SoR", "daily_vol": "Daily Vol(%)", "mdd": "MDD(%)",
        "downside_deviation_daily": "Downside Deviation(%)",
    })


def holding_drawdown(ledger: DataFrame, rewards: DataFrame, rows: int, key: str = "run_id",
                     rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """MT9: drawdown over the last ``rows`` steps, with the money needed in them."""
    ends = settle(ledger.groupBy(key).agg(F.max("step").alias("_end")), "ends")

    def tail(df: DataFrame) -> DataFrame:
        return df.join(ends, key).where(F.col("step") > F.col("_end") - rows).drop("_end")

    needed = required_money(tail(ledger), key, rows_per_block).withColumn("required", F.col("required") + TINY)
    return drawdowns(equity(tail(rewards), needed, key, rows_per_block), key, 0.0)


def turnover(actions: DataFrame, key: str = "run_id", rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """MT11: moved share of the position range and number of changes, starting flat."""
    series = Ordered.on_steps(actions, [key], "step", rows_per_block)
    rows = series.with_frames(
        lambda w: {"_was": F.coalesce(F.lag("action").over(w), F.lit(FLAT))}, back=1).done()
    return rows.groupBy(key).agg(
        F.sum(F.abs(F.col("action") - F.col("_was")) / HALF_RANGE).alias("turnover"),
        F.count_if(F.col("action") != F.col("_was")).alias("changes"))


# Rewards count to this many decimals: sums of decimals do not depend on their order.
EXACT = "decimal(38,12)"


def closed_trades(log: DataFrame, key: str = "run_id", rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """MT12: (step, trade_return, is_open) of each trade; the last open sum is always a row.

    Rewards add up until a flat action finds a non-zero sum, which it closes with its own reward. A flat row
    that finds zero keeps its reward for the next trade. So between flat rows one bit travels: whether the
    last one was idle. Each flat row maps that bit by one of four functions (to a constant, kept, flipped), and
    the bit at a row is the last constant, flipped as often as was asked since.

    Only the first flat row of a block has to know what came before it. The rows after it are worked out inside
    the block for either bit; a block becomes one row (sums, first and last flat row, map of the bit, last close
    for either bit), windows over those rows find what enters each block, and one join brings it to the rows.
    """
    series = Ordered.on_steps(log.select(key, "step", "action", F.col("reward").cast(EXACT).alias("_r")),
                              [key], "step", rows_per_block)
    now = series.window.rowsBetween(Window.unboundedPreceding, 0)
    before = series.window.rowsBetween(Window.unboundedPreceding, -1)
    flat, later = F.col("action") == FLAT, F.col("_later")
    last = lambda c: F.last(c, ignorenulls=True)
    rows = series.df.withColumn("_sum", F.sum("_r").over(now))
    rows = rows.withColumns({
        "_was": last(F.when(flat, F.struct("_sum", "_r"))).over(before),
        "_first": F.first(F.when(flat, F.struct("_sum", "_r")), ignorenulls=True).over(now),
        "_next": F.lead("step").over(series.window)})
    gap = F.col("_sum") - F.col("_r") - F.col("_was._sum")
    rows = rows.withColumns({"_later": flat & F.col("_was").isNotNull(), "_busy": gap == 0, "_idle": gap + F.col("_was._r") == 0})
    rows = rows.withColumn("_flips", F.sum(F.when(later & F.col("_busy") & ~F.col("_idle"), 1).otherwise(0)).over(now))
    constant = later & (F.col("_busy") == F.col("_idle"))
    rows = rows.withColumn("_set", last(F.when(constant, (F.col("_busy").cast("long") + F.col("_flips")) % 2)).over(now))

    def bit(entry: Column) -> Column:
        """The bit at a row, if it is ``entry`` after the first flat row of the block."""
        return (F.coalesce(F.col("_set"), entry) + F.col("_flips")) % 2

    closed = {f"_c{e}": F.when(later & (bit(F.lit(e)) == 0), F.col("_sum")) for e in (0, 1)}
    rows = rows.withColumns({c: last(v).over(before) for c, v in closed.items()} | {f"_n{c}": v for c, v in closed.items()})

    end = F.struct("_sum", "_flips", "_set", "_first", F.coalesce("_n_c0", "_c0").alias("_c0"), F.coalesce("_n_c1", "_c1").alias("_c1"),
                   F.when(flat, F.struct("_sum", "_r")).otherwise(F.col("_was")).alias("_flat"))
    ends = rows.groupBy(key, BLOCK).agg(F.max_by(end, "step").alias("_e")).select(key, BLOCK, "_e.*")
    along = Window.partitionBy(key).orderBy(BLOCK)
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("_from", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).cast(EXACT))
    ends = ends.withColumns({
        "_flat": last(F.when(F.col("_flat").isNotNull(), F.struct((F.col("_from") + F.col("_flat._sum")).alias("_sum"), F.col("_flat._r")))).over(earlier),
        "_ends": F.lead(BLOCK).over(along).isNull()})
    gap = F.col("_from") + F.col("_first._sum") - F.col("_first._r") - F.coalesce("_flat._sum", F.lit(0))
    ends = ends.withColumns({"_busy": (gap == 0).cast("long"), "_idle": (gap + F.coalesce("_flat._r", F.lit(0)) == 0).cast("long")})
    fixed = F.when(F.col("_set").isNotNull(), (F.col("_set") + F.col("_flips")) % 2).when(
        F.col("_busy") == F.col("_idle"), (F.col("_busy") + F.col("_flips")) % 2)
    turned = F.when(fixed.isNotNull() | F.col("_first").isNull(), 0).otherwise((F.col("_flips") + F.col("_busy")) % 2)
    ends = ends.withColumns({"_fixed": fixed, "_turned": turned})
    ends = ends.withColumn("_turns", F.sum("_turned").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_enters", (F.coalesce(last(F.when(F.col("_fixed").isNotNull(), (F.col("_fixed") + F.col("_turns")) % 2)).over(earlier), F.lit(0))
                                       + F.col("_turns") - F.col("_turned")) % 2)
    ends = ends.withColumn("_bit", F.when(F.col("_enters") == 1, F.col("_idle")).otherwise(F.col("_busy")))
    shut = F.when(F.col("_bit") == 0, F.coalesce("_c0", "_first._sum")).otherwise(F.col("_c1"))
    ends = ends.withColumn("_shut", last(F.col("_from") + shut).over(earlier))

    rows = rows.join(ends.select(key, BLOCK, "_from", "_bit", "_shut", "_ends"), [key, BLOCK])
    closes = flat & F.when(later, bit(F.col("_bit")) == 0).otherwise(F.col("_bit") == 0)
    # The last close before the row: in this block after its first flat row, at that row, or in an earlier block.
    inside = F.when(F.col("_bit") == 1, F.col("_c1")).otherwise(F.coalesce("_c0", F.when(F.col("_was").isNotNull(), F.col("_first._sum"))))
    open_sum = F.col("_from") + F.col("_sum") - F.coalesce(F.col("_from") + inside, F.col("_shut"), F.lit(0))
    rows = rows.withColumns({"_closes": closes, "_open": open_sum.cast(EXACT), "_last": F.col("_next").isNull() & F.col("_ends")})
    made = F.array_compact(F.array(
        F.when(F.col("_closes"), F.struct(F.col("_open").alias("trade_return"), F.lit(False).alias("is_open"))),
        F.when(F.col("_last"), F.struct(F.when(F.col("_closes"), 0).otherwise(F.col("_open")).cast(EXACT).alias("trade_return"),
                                        F.lit(True).alias("is_open")))))
    return rows.select(key, "step", F.inline(made)).withColumn("trade_return", F.col("trade_return").cast("double"))


def trade_metrics(trades: DataFrame, key: str = "run_id") -> DataFrame:
    """MT13: number of trades, win rate, and reward-risk ratio of sums and of means."""
    r = F.col("trade_return")
    gain, loss = F.when(r > 0, r), F.when(r < 0, r)
    zero = F.lit(0.0)
    return trades.groupBy(key).agg(
        F.count(r).alias("n_trades"), (F.count(gain) / (F.count(r) + TINY)).alias("win_rate"),
        (F.coalesce(F.sum(gain), zero) / (F.abs(F.coalesce(F.sum(loss), zero)) + TINY)).alias("reward_risk"),
        (F.coalesce(F.avg(gain), zero) / (F.abs(F.coalesce(F.avg(loss), zero)) + TINY)).alias("mean_reward_risk"))


def behaviour(log: DataFrame, key: str = "run_id") -> DataFrame:
    """One row per run: turnover and changes of the position (MT11) with its trade metrics (MT13)."""
    return turnover(log, key).join(trade_metrics(closed_trades(log, key), key), key)


def n_step_returns(log: DataFrame, n: int, discount: float, key: str = "run_id",
                   rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """TR1: discounted sum of ``n`` rewards, cut at a terminal step, and the step it leads to.

    Only rows with ``n`` steps ahead of them have a value.
    """
    series = Ordered.on_steps(log, [key], "step", rows_per_block)

    def window(w) -> dict[str, Column]:
        f = w.rowsBetween(0, n - 1)
        return {"_w": F.collect_list(F.struct("reward", "terminal")).over(f)}

    rows = series.with_frames(window, ahead=n - 1).done().where(F.size("_w") == n)
    value = F.aggregate(
        F.reverse("_w"), F.lit(0.0),
        lambda acc, x: x["reward"] + discount * F.when(x["terminal"], 0.0).otherwise(acc))
    stop = F.array_position(F.transform("_w", lambda x: x["terminal"]), F.lit(True))
    length = F.when(stop > 0, stop).otherwise(F.lit(n))
    return rows.select(
        key, "step", value.alias("n_step_return"), (F.col("step") + length).alias("next_step"), (stop > 0).alias("done"))


def _discounted(series: Ordered, value: str, factor: float, out: str) -> DataFrame:
    """y[t] = value[t] + factor * y[t+1] along each series of dense steps.

    Steps are cut into stretches in which no discount falls below 1e-8: inside
    one, sums are plain window sums of scaled values; the stretches after it come
    in as one row each, from as many of them as double precision can tell.
    """
    step, keys = series.order[0], list(series.keys)
    if not 0.0 < factor <= 1.0:
        raise ValueError("the discount must be above 0 and at most 1")
    if factor == 1.0:
        return series.running(**{out: running_sum(F.col(value), backward=True)}).done().select(*keys, step, out)
    length = max(1, int(-math.log(1e8) / math.log(factor)))
    ahead = int(-math.log(1e17) / math.log(factor)) // length + 2
    rows = series.df.select(*keys, step, F.col(value).cast("double").alias("_x")).withColumns({
        "_part": F.floor(F.col(step) / length), "_at": F.pmod(F.col(step), F.lit(length))})
    scaled = F.col("_x") * F.pow(F.lit(factor), F.col("_at"))
    # From the last row of a stretch backwards: a frame that grows, not one that is summed again for each row.
    rest = Window.partitionBy(*keys, "_part").orderBy(F.col(step).desc()).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy(*keys, "_part").agg(F.sum(scaled).alias("_t"))
    before = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(ahead))).alias("_j"))
    carried = before.groupBy(*keys, (F.col("_part") - F.col("_j")).alias("_part")).agg(
        F.sum(F.col("_t") * F.pow(F.lit(factor), length * (F.col("_j") - 1))).alias("_c"))
    joined = rows.withColumn("_s", F.sum(scaled).over(rest)).join(carried, [*keys, "_part"], "left")
    later = F.coalesce("_c", F.lit(0.0)) * F.pow(F.lit(factor), length - F.col("_at"))
    return joined.select(*keys, step, (F.col("_s") / F.pow(F.lit(factor), F.col("_at")) + later).alias(out))


def reward_to_go(log: DataFrame, discount: float, key: str = "run_id",
                 rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """TR2: discounted sum of this and all later rewards of the run."""
    series = Ordered.on_steps(log.select(key, "step", "reward"), [key], "step", rows_per_block)
    return _discounted(series, "reward", discount, "reward_to_go")


def advantages(log: DataFrame, discount: float, decay: float, key: str = "run_id",
               rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """TR3: generalised advantage and value target; the value after the last step is 0."""
    series = Ordered.on_steps(log, [key], "step", rows_per_block)
    alive = F.when(F.col("terminal"), 0.0).otherwise(1.0)

    def delta(w) -> dict[str, Column]:
        ahead = F.coalesce(F.lead("value").over(w), F.lit(0.0))
        return {"_delta": F.col("reward") + discount * ahead * alive - F.col("value")}

    made = series.with_frames(delta, ahead=1)
    sums = _discounted(made.on(made.df.select(key, "step", "_delta", "_block")), "_delta", discount * decay, "advantage")
    return sums.join(log.select(key, "step", "value"), [key, "step"]).select(
        key, "step", "advantage", (F.col("advantage") + F.col("value")).alias("value_target"))


