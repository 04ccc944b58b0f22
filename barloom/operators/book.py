"""Order-book features on four level arrays (CS7-CS12)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import dot, ratio, total

TINY = 1e-15
LEVELS = 25


def level(side: str, field: str, i: int) -> Column:
    """Price or size of level ``i`` (1 is the best)."""
    return F.get(f"{side}_{field}", F.lit(i - 1))


def _cross_price(i: int) -> Column:
    """Level price weighted by the size of the other side."""
    ask_size, bid_size = level("ask", "size", i), level("bid", "size", i)
    crossed = ask_size * level("bid", "price", i) + bid_size * level("ask", "price", i)
    return ratio(crossed, ask_size + bid_size)


def largest_levels(side: str, k: int) -> Column:
    """The ``k`` levels of largest size, smallest of them first; ties by level."""
    rows = F.zip_with(
        F.arrays_zip(F.col(f"{side}_size").alias("size"), F.sequence(F.lit(1), F.size(f"{side}_size")).alias("level")),
        F.col(f"{side}_price"),
        lambda a, p: F.struct(a["size"].alias("size"), a["level"].alias("level"), p.alias("price")),
    )
    return F.slice(F.array_sort(rows), -k, k)


def snapshot_features(book: DataFrame, keep: Sequence[str], k: int = 5, levels: int = LEVELS) -> DataFrame:
    """CS7-CS12: one row of price, depth and size features per snapshot.

    Side totals and top-k arrays are made once and then used by all columns.
    """
    sides = book.withColumns({
        "_ask_total": total(F.col("ask_size")), "_bid_total": total(F.col("bid_size")),
        "_ask_top": largest_levels("ask", k), "_bid_top": largest_levels("bid", k),
        "wap_1": _cross_price(1), "wap_2": _cross_price(2),
    })
    ask_total, bid_total = F.col("_ask_total"), F.col("_bid_total")
    sides = sides.withColumns({
        "sell_wap": ratio(dot(F.col("ask_size"), F.col("ask_price")), ask_total),
        "buy_wap": ratio(dot(F.col("bid_size"), F.col("bid_price")), bid_total),
    })
    # Fixed column names.
    out = {
        "midprice": (level("ask", "price", 1) + level("bid", "price", 1)) / 2,
        "wap_1": F.col("wap_1"), "wap_2": F.col("wap_2"),
        "wap_balance": F.col("wap_1") - F.col("wap_2"),
        "sell_wap": F.col("sell_wap"), "buy_wap": F.col("buy_wap"),
        "buy_sell_wap_spread": F.col("buy_wap") - F.col("sell_wap"),
        "buy_spread_oe_max": F.abs(level("bid", "price", 1) - level("bid", "price", levels)),
        "sell_spread_oe_max": F.abs(level("ask", "price", 1) - level("ask", "price", levels)),
    }
    for side in ("ask", "bid"):
        for field in ("price", "size"):
            for i in range(k):
                top = F.get(f"_{side}_top", F.lit(i))[field]
                out[f"{side}_{field}_topk_size_{i + 1}_increments"] = top - level(side, field, 1)
    out |= {
        "buy_volume_oe": bid_total, "sell_volume_oe": ask_total,
        "imblance_volume_oe": ratio(bid_total - ask_total, bid_total + ask_total + TINY),
    }
    for i in range(1, levels + 1):
        for side, whole in (("ask", ask_total), ("bid", bid_total)):
            out[f"{side}{i}_size_n"] = ratio(level(side, "size", i), whole)
    return sides.select(*keep, *[value.alias(name) for name, value in out.items()])
