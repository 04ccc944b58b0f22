"""Column families found from column names (PR4, PR5). No data is read."""

from __future__ import annotations

import re
from collections.abc import Sequence

# Fixed member words of each family kind.
OHLCV = ("open", "high", "low", "close", "volume")
OHLC = ("open", "high", "low", "close")
CANDLE = ("open", "high", "low", "close", "twap", "awap", "vwap")
BUY_SELL = ("sell", "buy")
UP_DOWN = ("up", "down", "flat")
BID_ASK = ("bid", "ask")

Family = dict[str, str]


def families(columns: Sequence[str], words: Sequence[str], at_least: int = 1) -> dict[tuple[str, str], Family]:
    """Group columns named ``prefix + word + suffix`` by (prefix, suffix).

    The first occurrence of a word decides. Families with fewer than
    ``at_least`` members are left out.
    """
    pattern = re.compile(rf"(.*?)({'|'.join(words)})(.*)")
    found: dict[tuple[str, str], Family] = {}
    for column in columns:
        if match := pattern.fullmatch(column):
            prefix, word, suffix = match.groups()
            found.setdefault((prefix, suffix), {})[word] = column
    return {key: members for key, members in found.items() if len(members) >= at_least}


def ohlcv_families(columns: Sequence[str]) -> dict[tuple[str, str], Family]:
    return families(columns, OHLCV, 5)


def ohlc_families(columns: Sequence[str]) -> dict[tuple[str, str], Family]:
    return families(columns, OHLC, 4)


def share_families(columns: Sequence[str]) -> dict[str, list[Family]]:
    """Families whose members are shares of a whole, with the whole as ``total``.

    Looks only at columns outside the candle families. The whole is the column
    named by the prefix without its trailing underscore, plus (except for
    buy/sell) the suffix.
    """
    candle = {c for members in families(columns, CANDLE).values() for c in members.values()}
    rest = [c for c in columns if c not in candle]
    result: dict[str, list[Family]] = {}
    for kind, words in (("buy_sell", BUY_SELL), ("up_down", UP_DOWN), ("bid_ask", BID_ASK)):
        result[kind] = []
        for (prefix, suffix), members in families(rest, words).items():
            stem = prefix.removesuffix("_")
            whole = prefix[:-1] if kind == "buy_sell" else stem + suffix
            if whole in rest and whole not in members.values():
                members = {"total": whole, **members}
            if len(members) > 1:
                result[kind].append(members)
    return result
