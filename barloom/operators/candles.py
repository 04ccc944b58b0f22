"""Single-row bar features: candle shapes and shares of a whole (CS1-CS6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.functions.names import CANDLE, families, share_families

TINY = 1e-15
# Differences below this share of the price are rounding noise of an average;
# over a candle without range they would be blown up by 1 / TINY.
NOISE = 1e-12


def _difference(price: Column, average: Column) -> Column:
    gap = price - average
    return F.when(F.abs(gap) <= NOISE * F.abs(price), 0.0).otherwise(gap)


def candle_columns(prefix: str, suffix: str, has_vwap: bool) -> dict[str, Column]:
    """CS1, CS2: nine shape measures, and open and close against each average price."""
    def col(word: str) -> Column:
        return F.col(f"{prefix}{word}{suffix}")

    open_, high, low, close = (col(w) for w in ("open", "high", "low", "close"))
    of_open, of_range, of_close = open_ + TINY, high - low + TINY, close + TINY
    upper = high - F.greatest(open_, close)
    lower = F.least(open_, close) - low
    lean = 2 * close - high - low
    shapes = {
        "klen": ratio(high - low, of_open),
        "kmid": ratio(close - open_, of_open), "kmid2": ratio(close - open_, of_range),
        "kup": ratio(upper, of_open), "kup2": ratio(upper, of_range),
        "klow": ratio(lower, of_open), "klow2": ratio(lower, of_range),
        "ksft": ratio(lean, of_open), "ksft2": ratio(lean, of_range),
    }
    for average in ("twap", "awap") + (("vwap",) if has_vwap else ()):
        from_open, from_close = _difference(open_, col(average)), _difference(close, col(average))
        shapes |= {
            f"ko{average}": ratio(from_open, of_open),
            f"ko{average}2": ratio(from_open, of_range),
            f"kc{average}": ratio(from_close, of_close),
            f"kc{average}2": ratio(from_close, of_range),
        }
    return {f"{prefix}{name}{suffix}": value for name, value in shapes.items()}


def candle_expressions(columns: Sequence[str]) -> dict[str, Column]:
    """CS1, CS2 for every candle family among the columns."""
    out: dict[str, Column] = {}
    for (prefix, suffix), members in families(columns, CANDLE, 6).items():
        out |= candle_columns(prefix, suffix, "vwap" in members)
    return out


def candle_features(bars: DataFrame, keep: Sequence[str] = ("symbol", "bucket")) -> DataFrame:
    """CS1, CS2: the columns to keep and the candle features."""
    return bars.select(*keep, *[v.alias(k) for k, v in candle_expressions(bars.columns).items()])


def _buy_sell(f: dict[str, str]) -> dict[str, Column]:
    """CS3."""
    whole, buy, sell = F.col(f["total"]) + TINY, F.col(f["buy"]), F.col(f["sell"])
    return {
        f"{f['total']}_buy_bsnorm": ratio(buy, whole),
        f"{f['total']}_sell_bsnorm": ratio(sell, whole),
        f"{f['total']}_buysell_imbalance_bsnorm": ratio(buy - sell, whole),
    }


def _up_down(f: dict[str, str]) -> dict[str, Column]:
    """CS4."""
    whole, up, down = F.col(f["total"]) + TINY, F.col(f["up"]), F.col(f["down"])
    shares = {
        f"{f['total']}_up_udnorm": ratio(up, whole),
        f"{f['total']}_down_udnorm": ratio(down, whole),
        f"{f['total']}_updown_imbalance_udnorm": ratio(up - down, whole),
    }
    if "flat" in f:
        flat = F.col(f["flat"])
        shares[f"{f['total']}_flat_udnorm"] = ratio(flat, whole)
        shares[f"{f['total']}_updownflat_vol_udnorm"] = ratio(up + down - flat, whole)
    return shares


def _bid_ask(f: dict[str, str]) -> dict[str, Column]:
    """CS5: against the given whole, or against bid + ask."""
    bid, ask = F.col(f["bid"]), F.col(f["ask"])
    if "total" in f:
        whole, name = F.col(f["total"]) + TINY, f["total"]
        names = (f"{name}_bid_abnorm", f"{name}_ask_abnorm", f"{name}_askbid_imbalance_abnorm")
    else:
        whole = bid + ask + TINY
        names = (f"{f['bid']}_abnorm", f"{f['ask']}_abnorm", f"{f['ask']}_bid_imbalance_abnorm")
    return dict(zip(names, (ratio(bid, whole), ratio(ask, whole), ratio(bid - ask, whole)), strict=True))


def share_expressions(columns: Sequence[str]) -> dict[str, Column]:
    """CS6: CS3, CS4 and CS5 for every family among the columns."""
    found = share_families(columns)
    out: dict[str, Column] = {}
    for f in found["buy_sell"]:
        if {"total", "buy", "sell"} <= f.keys():
            out |= _buy_sell(f)
    for f in found["up_down"]:
        if {"total", "up", "down"} <= f.keys():
            out |= _up_down(f)
    for f in found["bid_ask"]:
        if {"bid", "ask"} <= f.keys():
            out |= _bid_ask(f)
    return out


def share_features(bars: DataFrame, keep: Sequence[str] = ("symbol", "bucket")) -> DataFrame:
    """CS6: the columns to keep and the share features."""
    found = share_expressions([c for c in bars.columns if c not in keep])
    return bars.select(*keep, *[v.alias(k) for k, v in found.items()])


def cross_section(bars: DataFrame, keys: Sequence[str] = ("symbol", "bucket")) -> DataFrame:
    """The bars with all their single-row features: one projection, no join."""
    base = [c for c in bars.columns if c not in keys]
    made = candle_expressions(base) | share_expressions(base)
    return bars.select("*", *[v.alias(k) for k, v in made.items()])
