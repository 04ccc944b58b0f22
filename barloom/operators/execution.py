"""Execution cost, margin and ledger columns (EX1-EX11, JN9)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import gap_seconds
from barloom.operators.joins import tier
from barloom.operators.ordering import GRID_ROWS_PER_BLOCK, Ordered, last_set, running_sum

# Fixed values of the trading rules.
DUST = 1e-5
PENALTY = -1e10
WALLET = 1e5


def sweep(prices: Column, sizes: Column, quantity: Column) -> Column:
    """EX1, EX2: struct (value, filled) of taking ``quantity`` level by level.

    A rest below the dust bound counts as filled but is not paid for.
    """
    levels = F.zip_with(prices, sizes, lambda p, s: F.struct(p.alias("p"), s.alias("s")))
    start = F.struct(quantity.cast("double").alias("rest"), F.lit(0.0).alias("value"))

    def take(acc: Column, x: Column) -> Column:
        last = acc["rest"] <= x["s"]
        pays = ~last | (acc["rest"] > DUST)
        part = F.when(last, acc["rest"]).otherwise(x["s"])
        return F.struct(
            F.when(last, 0.0).otherwise(acc["rest"] - x["s"]).alias("rest"),
            F.when(pays, acc["value"] + part * x["p"]).otherwise(acc["value"]).alias("value"),
        )

    return F.aggregate(levels, start, take, lambda acc: F.struct(
        acc["value"].alias("value"),
        F.when(acc["rest"] > DUST, quantity - acc["rest"]).otherwise(quantity).alias("filled"),
    ))


def open_loss(prices: Column, sizes: Column, quantity: Column, mark: Column, rate: float, long: bool) -> Column:
    """EX3: what opening costs beyond margin, level by level against the mark price."""
    def loss(price: Column) -> Column:
        against = price * (1 + rate) - mark
        return F.greatest(F.lit(0.0), against if long else -against)

    return sweep(F.transform(prices, loss), sizes, quantity)["value"]


def trade_costs(book: DataFrame, quantity: Column, mark: Column, commission: float) -> DataFrame:
    """EX1, EX2, EX4: buy and sell value, fill, slippage and commission per snapshot.

    Slippage is what the fill costs against the mark price, for both sides.
    """
    swept = book.withColumns({
        "_buy": sweep(F.col("ask_price"), F.col("ask_size"), quantity),
        "_sell": sweep(F.col("bid_price"), F.col("bid_size"), quantity),
    })
    return swept.withColumns({
        "buy_value": F.col("_buy.value"), "buy_filled": F.col("_buy.filled"),
        "sell_value": F.col("_sell.value"), "sell_filled": F.col("_sell.filled"),
        "buy_slippage": F.col("_buy.value") - mark * F.col("_buy.filled"),
        "sell_slippage": mark * F.col("_sell.filled") - F.col("_sell.value"),
        "buy_commission": commission * F.col("_buy.value"),
        "sell_commission": commission * F.col("_sell.value"),
    }).drop("_buy", "_sell")


def maintenance_margin(value: Column, tiers: Sequence[tuple]) -> Column:
    """EX5: value x ratio - deduction of the value's tier."""
    found = tier(value, tiers)
    return value * found["ratio"] - found["deduction"]


def is_liquidated(wallet: Column, unrealized: Column, mark: Column, position: Column,
                  tiers: Sequence[tuple]) -> Column:
    """EX6: margin balance not above the maintenance margin."""
    return wallet + unrealized <= maintenance_margin(F.abs(mark * position), tiers)


def _quantity(change: Column) -> Column:
    return F.abs(change).cast("double")


def reachable(book: DataFrame, positions: Sequence[int], leverages: Sequence[int], mark: Column,
              position: Column, leverage: Column, wallet: Column, unrealized: Column,
              rate: float, commission: float) -> DataFrame:
    """EX7: (target, target_leverage) pairs reachable from each row's account state.

    A target needs enough depth, no change of sign, and enough margin at its
    leverage; the current leverage is exempt from the margin test except for
    opening.
    """
    pairs = F.array(*[
        F.struct(F.lit(p).alias("target"), F.lit(v).alias("target_leverage"))
        for p in positions for v in leverages
    ])
    state = book.withColumns({
        "_mark": mark, "_pos": position, "_lev": leverage, "_wallet": wallet, "_upnl": unrealized,
    }).select("*", F.inline(pairs))
    pos, to, lev = F.col("_pos"), F.col("target"), F.col("target_leverage")
    up = F.least(pos + F.aggregate("ask_size", F.lit(0.0), lambda a, x: a + x), F.lit(max(positions)))
    down = F.greatest(pos - F.aggregate("bid_size", F.lit(0.0), lambda a, x: a + x), F.lit(min(positions)))
    up = F.when(pos < 0, F.least(F.lit(0.0), up)).otherwise(up)
    down = F.when(pos > 0, F.greatest(F.lit(0.0), down)).otherwise(down)
    balance = F.col("_wallet") + F.col("_upnl")
    size = _quantity(to - pos)
    loss = F.when(
        to > 0, open_loss(F.col("ask_price"), F.col("ask_size"), size, F.col("_mark"), rate, True)
    ).otherwise(open_loss(F.col("bid_price"), F.col("bid_size"), size, F.col("_mark"), rate, False))
    same_leverage = lev == F.col("_lev")
    held = F.abs(F.col("_mark") * pos / lev)
    opening = (same_leverage | (balance >= held)) & (balance - held >= loss + size * F.col("_mark") / lev)
    value = F.when(
        pos > 0, sweep(F.col("bid_price"), F.col("bid_size"), size)["value"]
    ).otherwise(sweep(F.col("ask_price"), F.col("ask_size"), size)["value"])
    sign = F.when(pos > 0, 1.0).otherwise(-1.0)
    # Realised and remaining unrealised profit sum to the old one: only the
    # trade itself and its fee change the balance.
    after = balance + sign * (value - F.col("_mark") * size) - commission * value
    target_margin = F.abs(F.col("_mark") * to / lev)
    closing = same_leverage | (after >= target_margin)
    ok = (
        F.when(to == pos, same_leverage | (balance >= target_margin))
        .when(F.abs(to) > F.abs(pos), opening).otherwise(closing)
    )
    return state.where(to.between(down, up)).where(ok).drop("_mark", "_pos", "_lev", "_wallet", "_upnl")


def _coded(positions: Sequence[int], leverages: Sequence[int]) -> Column:
    """The (position, leverage) of each action in turn: flat is listed once, with the first leverage."""
    listed = [(p, v) for p in positions for v in (leverages if p else leverages[:1])]
    return F.array(*[F.struct(F.lit(p).alias("position"), F.lit(v).alias("leverage")) for p, v in listed])


def action_parts(action: Column, positions: Sequence[int], leverages: Sequence[int]) -> Column:
    """EX8: struct (position, leverage) of an action; null for actions there are not."""
    return F.get(_coded(positions, leverages), action.cast("int"))


def action_of(position: Column, leverage: Column, positions: Sequence[int], leverages: Sequence[int]) -> Column:
    """EX8 inverse; any leverage will do for the flat position."""
    held = F.when(position == 0, F.lit(leverages[0])).otherwise(leverage)
    wanted = F.struct(position.cast("int").alias("position"), held.cast("int").alias("leverage"))
    return F.array_position(_coded(positions, leverages), wanted) - 1


def nearest(wanted: Column, choices: Column) -> Column:
    """EX9: the choice closest to ``wanted``, the smaller one on a tie."""
    return F.array_min(F.transform(
        choices, lambda x: F.struct(F.abs(x - wanted).alias("d"), x.alias("x"))))["x"]


def smaller_position(target: Column, positions: Sequence[int]) -> Column:
    """EX9: the largest listed position nearer to flat than ``target``, 0 for flat."""
    listed = F.array(*[F.lit(p) for p in positions])
    return (
        F.when(target > 0, F.array_max(F.filter(listed, lambda p: p < target)))
        .when(target < 0, F.array_min(F.filter(listed, lambda p: p > target)))
        .otherwise(0)
    )


def countdown(later: Column, ts: Column) -> Column:
    """EX10: struct (hours, minutes, seconds) until ``later``."""
    left = gap_seconds(later, ts)
    return F.struct(
        F.floor(left / 3600).alias("hours"),
        F.floor(F.pmod(left, F.lit(3600.0)) / 60).alias("minutes"),
        F.pmod(left, F.lit(60.0)).alias("seconds"),
    )


def ledger(path: DataFrame, seconds: int, commission: float, wallet: float = WALLET,
           ts: str = "bucket", rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """EX11: accounts of a given position path on a grid of bars.

    The position held into a row earns the price change, pays funding where the
    row is at the funding time announced one row before, and pays commission on
    its change. No rejection or liquidation feeds back.
    """
    series = Ordered.on_grid(path, ["symbol"], ts, seconds, rows_per_block)
    before = F.struct("position", "mark_price", "funding_timestamp")
    steps = series.running(_was=last_set(before, strict=True))
    was = F.col("_was")
    rows = steps.df.withColumns({
        "price_pnl": F.coalesce(
            was["position"] * (F.col("mark_price") - was["mark_price"]), F.lit(0.0)),
        "funding_fee": F.when(
            F.col(ts) == was["funding_timestamp"],
            was["position"] * was["mark_price"] * F.col("funding_rate"),
        ).otherwise(0.0),
        "commission": commission * F.col("mark_price") * F.abs(
            F.col("position") - F.coalesce(was["position"], F.lit(0.0))),
    })
    totals = steps.on(rows.drop("_was")).running(
        _pnl=running_sum(F.col("price_pnl")),
        _cost=running_sum(F.col("funding_fee") + F.col("commission")),
    ).done()
    return totals.withColumn("wallet", wallet - F.col("_cost")).withColumn(
        "margin_balance", F.col("wallet") + F.col("_pnl")).drop("_pnl", "_cost")


def transition_rewards(book: DataFrame, positions: Sequence[int], leverages: Sequence[int],
                       rate: float, commission: float, wallet: float = WALLET) -> DataFrame:
    """JN9: reward of moving from each account position to each other one.

    ``book`` carries ``mark``, ``next_mark``, ``funding_rate`` (of the next row)
    and ``funds`` (the next row is the announced funding time). Grids are
    literals, so the table grows only with the snapshots. Changes of sign,
    unfilled moves, and moves or leverages the balance cannot carry get the
    penalty. Leverage changes before opening and after closing.
    """
    def states(name: str) -> Column:
        return F.array(*[
            F.struct(F.lit(p).alias(f"{name}_position"), F.lit(v).alias(f"{name}_leverage"))
            for p in positions for v in (leverages if p else leverages[:1])
        ])

    grid = book.select("*", F.inline(states("from"))).select("*", F.inline(states("to")))
    was, now = F.col("from_position"), F.col("to_position")
    mark, lev = F.col("mark"), F.col("to_leverage")
    size = _quantity(now - was)
    buys = now > was
    trade = F.when(buys, sweep(F.col("ask_price"), F.col("ask_size"), size)).otherwise(
        sweep(F.col("bid_price"), F.col("bid_size"), size))
    grid = grid.withColumn("_t", F.when(size > 0, trade).otherwise(
        F.struct(F.lit(0.0).alias("value"), F.lit(0.0).alias("filled"))))
    opens = F.abs(now) > F.abs(was)
    loss = F.when(
        buys, open_loss(F.col("ask_price"), F.col("ask_size"), size, mark, rate, True)
    ).otherwise(open_loss(F.col("bid_price"), F.col("bid_size"), size, mark, rate, False))
    value = F.col("_t.value")
    trade_gain = F.when(buys, mark * size - value).otherwise(value - mark * size)
    held = F.abs(mark * was / lev)
    same_leverage = F.col("from_leverage") == lev
    can_open = (same_leverage | (wallet >= held)) & (mark * size / lev + loss <= wallet - held)
    balance = wallet + trade_gain - commission * value
    can_close = same_leverage | (balance >= F.abs(mark * now / lev))
    possible = F.when(opens, can_open).otherwise(can_close)
    funding = F.when(F.col("funds"), now * F.col("next_mark") * F.col("funding_rate")).otherwise(0.0)
    reward = trade_gain - commission * value + now * (F.col("next_mark") - mark) - funding
    barred = (was * now < 0) | (F.col("_t.filled") != size) | ~possible
    return grid.withColumn("reward", F.when(barred, F.lit(PENALTY)).otherwise(reward)).drop("_t")


def path_costs(path: Ordered, mark: str, position: str, leverage: str, rate: float, commission: float) -> DataFrame:
    """EX1-EX4 along a given path: what each row's change of position costs, and what the row then earns.

    ``path`` holds one snapshot of the book per step with the position and leverage chosen there. The change from the step
    before is taken from the levels of its side: ``filled``, ``slippage`` against the mark price, ``commission``,
    ``open_loss`` beyond margin when the position grows, ``margin`` of what is held after it; ``price_pnl`` is the move of
    the mark price to the next step on the new position (null at the last step). The first change is from flat.
    """
    rows = path.with_frames(lambda w: {"_was": F.coalesce(F.lag(position).over(w), F.lit(0)), "_next": F.lead(mark).over(w)},
                            back=1, ahead=1).done()
    now, was, price = F.col(position), F.col("_was"), F.col(mark)
    size, buys = _quantity(now - was), now > was
    rows = rows.withColumn("_t", F.when(buys, sweep(F.col("ask_price"), F.col("ask_size"), size)).otherwise(
        sweep(F.col("bid_price"), F.col("bid_size"), size)))
    loss = F.when(buys, open_loss(F.col("ask_price"), F.col("ask_size"), size, price, rate, True)).otherwise(
        open_loss(F.col("bid_price"), F.col("bid_size"), size, price, rate, False))
    value, filled = F.col("_t.value"), F.col("_t.filled")
    return rows.withColumns({
        "filled": filled, "slippage": F.when(buys, value - price * filled).otherwise(price * filled - value),
        "commission": commission * value, "open_loss": F.when(F.abs(now) > F.abs(was), loss).otherwise(0.0),
        "margin": F.abs(price * now / F.col(leverage)), "price_pnl": now * (F.col("_next") - price),
    }).drop("_t", "_was", "_next")
