"""Queries over bars: names, candle shapes, shares and rolling features (PR, CS1-6, RW)."""

from __future__ import annotations

from pyspark.sql import functions as F

from barloom.catalog.fixtures import HOUR, hourly_bars, quotes, r6, report, trades, with_views
from barloom.functions.columns import clean
from barloom.functions.names import ohlc_families, ohlcv_families
from barloom.operators import candles, resample, rolling
from barloom.operators.ordering import Ordered
from barloom.session import settle

WINDOWS = rolling.WINDOWS
BARS = ["fx_bars"]


def candle_shapes(spark, sf):
    return report(candles.candle_features(hourly_bars(spark, sf)))


def _candle_sql() -> str:
    o, h, l, c = '"open"', "high", "low", '"close"'
    tops = {"klen": f"{h}-{l}", "kmid": f"{c}-{o}", "kup": f"{h}-greatest({o},{c})",
            "klow": f"least({o},{c})-{l}", "ksft": f"2*{c}-{h}-{l}"}
    cols = [f"({tops['klen']})/({o}+1e-15) klen"]
    for name in ("kmid", "kup", "klow", "ksft"):
        cols += [f"({tops[name]})/({o}+1e-15) {name}", f"({tops[name]})/({h}-{l}+1e-15) {name}2"]
    for a in ("twap", "awap", "vwap"):
        for short, x in (("o", o), ("c", c)):
            d = f"(case when abs({x}-{a}) <= 1e-12*abs({x}) then 0 else {x}-{a} end)"
            cols += [f"{d}/({x}+1e-15) k{short}{a}", f"{d}/({h}-{l}+1e-15) k{short}{a}2"]
    names = [x.rsplit(" ", 1)[1] for x in cols]
    return with_views(BARS, k=f"select symbol, bucket, {', '.join(cols)} from fx_bars") + \
        f"\nSELECT symbol, epoch_us(bucket) bucket, {r6(*names)} FROM k"


def trade_shares(spark, sf):
    bars = resample.trade_bars(trades(spark, sf), HOUR, by_side=True)
    return report(candles.share_features(bars))


def _shares(total: str, kind: str, members: tuple[str, ...]) -> list[tuple[str, str]]:
    t, a, b = f"({total}+1e-15)", members[0], members[1]
    if kind == "bs":
        return [(f"{total}_buy_bsnorm", f"{a}/{t}"), (f"{total}_sell_bsnorm", f"{b}/{t}"),
                (f"{total}_buysell_imbalance_bsnorm", f"({a}-{b})/{t}")]
    if kind == "ud":
        out = [(f"{total}_up_udnorm", f"{a}/{t}"), (f"{total}_down_udnorm", f"{b}/{t}"),
               (f"{total}_updown_imbalance_udnorm", f"({a}-{b})/{t}")]
        if len(members) == 3:
            out += [(f"{total}_flat_udnorm", f"{members[2]}/{t}"),
                    (f"{total}_updownflat_vol_udnorm", f"({a}+{b}-{members[2]})/{t}")]
        return out
    return [(f"{total}_bid_abnorm", f"{a}/{t}"), (f"{total}_ask_abnorm", f"{b}/{t}"),
            (f"{total}_askbid_imbalance_abnorm", f"({a}-{b})/{t}")]


def _pair(bid: str, ask: str) -> list[tuple[str, str]]:
    t = f"({bid}+{ask}+1e-15)"
    return [(f"{bid}_abnorm", f"{bid}/{t}"), (f"{ask}_abnorm", f"{ask}/{t}"),
            (f"{ask}_bid_imbalance_abnorm", f"({bid}-{ask})/{t}")]


def _trade_shares_sql() -> str:
    from barloom.catalog.ticks import _side_sql

    cols = []
    for total in ("volume", "tradeval", "ntrade", "ntrade_up", "ntrade_down", "ntrade_flat"):
        cols += _shares(total, "bs", (f"{total}_buy", f"{total}_sell"))
    for suffix in ("", "_buy", "_sell"):
        cols += _shares(f"ntrade{suffix}", "ud", tuple(f"ntrade_{d}{suffix}" for d in ("up", "down", "flat")))
    return with_views(
        ["fx_gaps"],
        own="select *, us-lag(us) over (partition by symbol, side, bucket order by ts, id) sdus from fx_gaps",
        a=f"""select symbol, bucket, sum(amount) volume, sum(price*amount) tradeval, count(*) ntrade,
            count(*) filter (move>0) ntrade_up, count(*) filter (move<0) ntrade_down,
            count(*) filter (move=0) ntrade_flat, {_side_sql('buy')}, {_side_sql('sell')}
            from own group by symbol, bucket""",
        s="select symbol, bucket, " + ", ".join(f"{v} {n}" for n, v in cols) + " from a",
    ) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6(*[n for n, _ in cols])} FROM s"


def quote_shares(spark, sf):
    bars = resample.quote_bars(quotes(spark, sf), HOUR, ["ts", "event_id"], ohlc=False)
    return report(candles.share_features(bars))


def _quote_shares_sql() -> str:
    from barloom.catalog.ticks import SQL_QUOTE_COUNTS

    cols = []
    for side in ("bid", "ask", "bidsize", "asksize"):
        cols += _shares(f"nquote_{side}", "ud", (f"nquote_{side}_up", f"nquote_{side}_down"))
    cols += _shares("nquote_bid_askflat", "ud", ("nquote_bidup_askflat", "nquote_biddown_askflat"))
    cols += _shares("nquote_ask_bidflat", "ud", ("nquote_askup_bidflat", "nquote_askdown_bidflat"))
    cols += _shares("nquote", "ba", ("nquote_bid", "nquote_ask"))
    for word in ("_up", "_down", "size", "size_up", "size_down"):
        cols += _pair(f"nquote_bid{word}", f"nquote_ask{word}")
    inner = SQL_QUOTE_COUNTS
    return f"""WITH n AS ({inner}), s AS (SELECT symbol, bucket, {', '.join(f'{v} {n}' for n, v in cols)} FROM n)
SELECT symbol, bucket, {r6(*[n for n, _ in cols])} FROM s"""


def rolling_ohlcv(spark, sf):
    names = dict(zip(("open", "high", "low", "close", "volume"),
                     ("open", "high", "low", "close", "volume"), strict=True))
    bars = hourly_bars(spark, sf)
    made = rolling.rolling_groups(bars, HOUR, {"": names}, WINDOWS)
    return report(rolling.trim_start(made, max(WINDOWS) + 10, HOUR, source=bars))


def _rw(w: int, volume: bool, tag: str = "", p: str = "") -> list[tuple[str, str]]:
    """Feature expressions of one window over the columns made by ``_rw_frames``."""
    c, h, l, v = f'"{p}close"', f"{p}high", f"{p}low", f"{p}volume"
    g = {k: f"{k}_{w}" for k in (
        "back", "mean", "sd", "mx", "mn", "qu", "qd", "cs", "hs", "ls", "n", "up", "dn", "gain", "path",
        "corr", "cord", "vmean", "vsd", "cmean", "csd", "vgain", "vpath")}
    lo = f"case when {g['back']} is not null then least({l},{g['back']}) end"
    hi = f"case when {g['back']} is not null then greatest({h},{g['back']}) end"
    imax = f"(list_position({g['hs']}, list_max({g['hs']}))-1)"
    imin = f"(list_position({g['ls']}, list_min({g['ls']}))-1)"
    less = f"len(list_filter({g['cs']}, lambda x: x < {c}))"
    equal = f"len(list_filter({g['cs']}, lambda x: x = {c}))"
    sump = f"({g['gain']}/({g['path']}+1e-12))"
    up = f"(case when {g['n']}={w} then {g['up']}/{w} end)"
    dn = f"(case when {g['n']}={w} then {g['dn']}/{w} end)"
    sd = f"({g['sd']}+1e-12)"
    out = [
        ("roc", f"{g['back']}/{c}"), ("ma", f"{g['mean']}/{c}"), ("std", f"{g['sd']}/{c}"),
        ("beta", f"({g['back']}-{c})/({w}*{c})"), ("max", f"{g['mx']}/{c}"), ("min", f"{g['mn']}/{c}"),
        ("qtlu", f"{g['qu']}/{c}"), ("qtld", f"{g['qd']}/{c}"),
        ("rank", f"case when {g['cs']} is not null then ({less}+({equal}+1)/2)/{w}/{w} end"),
        ("imax", f"{imax}/{w}"), ("imin", f"{imin}/{w}"), ("imxd", f"({imax}-{imin})/{w}"),
        ("rsv", f"({c}-({lo}))/(({hi})-({lo})+1e-12)"),
        ("cntp", up), ("cntn", dn), ("cntd", f"{up}-{dn}"),
        ("sump", sump), ("sumn", f"1-{sump}"), ("sumd", f"2*{sump}-1"),
    ]
    scaled = [
        ("roc", f"{g['back']}/{sd}"), ("ma", f"{g['mean']}/{sd}"), ("beta", f"({g['back']}-{c})/({w}*{sd})"),
        ("max", f"{g['mx']}/{sd}"), ("min", f"{g['mn']}/{sd}"), ("qtlu", f"{g['qu']}/{sd}"),
        ("qtld", f"{g['qd']}/{sd}"),
    ]
    if volume:
        vsump = f"({g['vgain']}/({g['vpath']}+1e-12))"
        out += [
            ("corr", g["corr"]), ("cord", g["cord"]), ("vma", f"{g['vmean']}/({v}+1e-12)"),
            ("vstd", f"{g['vsd']}/({v}+1e-12)"), ("wvma", f"{g['csd']}/({g['cmean']}+1e-12)"),
            ("vsump", vsump), ("vsumn", f"1-{vsump}"), ("vsumd", f"2*{vsump}-1"),
        ]
        scaled += [("rsv", f"({c}-({lo}))/({sd}+1e-12)"), ("vma", f"{g['vmean']}/({g['vsd']}+2e-12)")]
    # Null and infinite values are 0.
    finite = "case when isfinite(({0})::double) then {0} else 0 end".format
    return [(f"{k}_{w}{tag}", finite(e)) for k, e in out] + [(f"{k}_{w}_std_norm{tag}", finite(e)) for k, e in scaled]


def _rw_frames(w: int, volume: bool, p: str = "") -> str:
    c, h, l, v = f'"{p}close"', f"{p}high", f"{p}low", f"{p}volume"

    def full(x: str, e: str) -> str:
        return f"case when count({x}) over f{w} = {w} then {e} over f{w} end"

    cols = [
        f"lag({c},{w}) over s back_{w}", f"{full(c, f'avg({c})')} mean_{w}",
        f"{full(c, f'stddev_samp({c})')} sd_{w}", f"{full(c, f'max({c})')} mx_{w}",
        f"{full(c, f'min({c})')} mn_{w}", f"{full(c, f'quantile_cont({c},0.8)')} qu_{w}",
        f"{full(c, f'quantile_cont({c},0.2)')} qd_{w}", f"{full(c, f'list({c})')} cs_{w}",
        f"{full(h, f'list({h})')} hs_{w}", f"{full(l, f'list({l})')} ls_{w}",
        f"count(*) over f{w} n_{w}", f"count(*) filter (ret>0) over f{w} up_{w}",
        f"count(*) filter (ret<0) over f{w} dn_{w}", f"{full('ret', 'sum(greatest(ret,0))')} gain_{w}",
        f"{full('ret', 'sum(abs(ret))')} path_{w}",
    ]
    if volume:
        vary = "max({0}) over f{1} > min({0}) over f{1}".format
        cols += [
            f"case when count({c}) over f{w}={w} and {vary(c, w)} and {vary('lvol', w)} "
            f"then corr({c},lvol) over f{w} end corr_{w}",
            f"case when count(move) over f{w}={w} and count(lvmove) over f{w}={w} and {vary('move', w)} "
            f"and {vary('lvmove', w)} then corr(move,lvmove) over f{w} end cord_{w}",
            f"{full(v, f'avg({v})')} vmean_{w}", f"{full(v, f'stddev_samp({v})')} vsd_{w}",
            f"{full('churn', 'avg(churn)')} cmean_{w}", f"{full('churn', 'stddev_samp(churn)')} csd_{w}",
            f"{full('vchg', 'sum(greatest(vchg,0))')} vgain_{w}", f"{full('vchg', 'sum(abs(vchg))')} vpath_{w}",
        ]
    return ", ".join(cols)


def _rolling_sql(volume: bool, trim: int, p: str = "", tag: str = "", source: str = "fx_bars",
                 views: dict | None = None, needs: tuple[str, ...] = tuple(BARS)) -> str:
    c, v = f'"{p}close"', f"{p}volume"
    steps = f"{c}/nullif(lag({c}) over s,0) move, {c}/nullif(lag({c}) over s,0)-1 ret"
    if volume:
        steps += f""", {v}-lag({v}) over s vchg, ln({v}+1) lvol, ln({v}/nullif(lag({v}) over s,0)+1) lvmove,
            abs({c}/nullif(lag({c}) over s,0)-1)*{v} churn"""
    frames = ", ".join(
        f"f{w} as (partition by symbol order by bucket rows between {w - 1} preceding and current row)"
        for w in WINDOWS)
    feats = [x for w in WINDOWS for x in _rw(w, volume, tag, p)]
    if volume:
        feats.append((f"log_volume{tag}", "coalesce(lvol,0)"))
    return with_views(
        needs, **(views or {}),
        s1=f"""select *, {steps}, row_number() over s rn from {source}
            window s as (partition by symbol order by bucket)""",
        s2=f"""select *, {', '.join(_rw_frames(w, volume, p) for w in WINDOWS)} from s1
            window s as (partition by symbol order by bucket), {frames}""",
        s3=f"select symbol, bucket, {', '.join(f'{e} {n}' for n, e in feats)} from s2 where rn > {trim}",
    ) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6(*[n for n, _ in feats])} FROM s3"


def rolling_ohlc(spark, sf):
    """The OHLC-only set, over the bars of the mid price."""
    sparse = resample.quote_bars(quotes(spark, sf), HOUR, ["ts", "event_id"], counts=False)
    mid = sparse.select("symbol", "bucket", *[f"{w}_mid" for w in ("open", "high", "low", "close")])
    return report(rolling.rolling_features(resample.complete_bars(mid, HOUR), HOUR, WINDOWS))


SQL_ROLLING_OHLC = _rolling_sql(
    False, max(WINDOWS) + 1, "", "_mid", "mid_bars", {
        "fx_quotes": """select event_type symbol, ts, event_id, value bid_price,
            value+cast(1+user_id%5 as double)/cast(100 as double) ask_price from events""",
        "mids": """select symbol, date_trunc('hour', ts) bucket, arg_min((ask_price+bid_price)/2, ts) "open",
            max((ask_price+bid_price)/2) high, min((ask_price+bid_price)/2) low,
            arg_max((ask_price+bid_price)/2, ts) "close" from fx_quotes group by 1, 2""",
        "mid_bars": "select symbol, bucket, " + ", ".join(
            f"last_value({c} ignore nulls) over (partition by symbol order by bucket) {c}"
            for c in ('"open"', "high", "low", '"close"')) + " from fx_grid left join mids using (symbol, bucket)",
    })


def rolling_families(spark, sf):
    """Every family found by its column names, over all columns of the bars: three with volume, the others without."""
    bars = resample.base_features(trades(spark, sf), quotes(spark, sf), HOUR, ["ts", "event_id"])
    # Differences of prices carry noise of the last digits, which a division by their spread over a window would show.
    bars = bars.withColumns({f"{w}_spread": F.round(f"{w}_spread", 9) for w in ("open", "high", "low", "close")})
    made = rolling.rolling_features(settle(bars, "base"), HOUR, WINDOWS)
    return report(made, "symbol", "bucket", *[n for _, volume, tag in _FAMILIES for n in _family_names(volume, tag)])


_FAMILIES = [("", True, "_origin"), ("_buy", True, "_buy"), ("_sell", True, "_sell"),
             *[(f"_{n}", False, f"_{n}") for n in resample.QUOTE_INDICATORS]]


def _family_names(volume: bool, tag: str) -> list[str]:
    names = [n for w in WINDOWS for n, _ in _rw(w, volume, tag)]
    return names + ([f"log_volume{tag}"] if volume else [])


def _families_sql() -> str:
    from barloom.catalog.ticks import base_views

    parts = []
    for suffix, volume, tag in _FAMILIES:
        words = ("open", "high", "low", "close", *(["volume"] if volume else []))
        shown = 'round("{0}", 9)' if suffix == "_spread" else '"{0}"'
        one = "select symbol, bucket, " + ", ".join(f'{shown.format(c + suffix)} AS "{c}"' for c in words) + " from base"
        parts.append(f"({_rolling_sql(volume, max(WINDOWS) + 10, '', tag, 'family', {'family': one}, ())})")
    head = with_views(["fx_grid", "fx_sparse", "fx_quotes"], **{k: v for k, v in base_views().items()})
    return f"{head}\nSELECT * FROM {parts[0]} " + " ".join(f"JOIN {p} USING (symbol, bucket)" for p in parts[1:])


def price_trends(spark, sf):
    return report(rolling.price_features(hourly_bars(spark, sf), HOUR, ["close", "vwap"], WINDOWS))


def _trend_sql() -> str:
    cols, names = [], []
    for q, c in (('"close"', "close"), ("vwap", "vwap")):
        cols.append(f"ln({q}/(lag({q}) over s+1e-12))*1000 {c}_log_return")
        names.append(f"{c}_log_return")
        for w in WINDOWS:
            cols.append(f"({q}-avg({q}) over f{w})/(stddev_samp({q}) over f{w}+1e-12) {c}_trend_{w}")
            names.append(f"{c}_trend_{w}")
    frames = ", ".join(
        f"f{w} as (partition by symbol order by bucket rows between {w - 1} preceding and current row)"
        for w in WINDOWS)
    return with_views(BARS, t=f"""select symbol, bucket, row_number() over s rn, {', '.join(cols)} from fx_bars
        window s as (partition by symbol order by bucket), {frames}""") + \
        f"\nSELECT symbol, epoch_us(bucket) bucket, {r6(*names)} FROM t WHERE rn > {max(WINDOWS) + 1}"


def exponential(spark, sf):
    made = rolling.exponential_means(hourly_bars(spark, sf), "close", {"ewm_9": 9, "ewm_26": 26}, HOUR)
    return report(made, "symbol", "bucket", "ewm_9", "ewm_26")


def _ewm(lst: str, span: int) -> str:
    k = f"pow(1-2.0/{span + 1}, len({lst})-i)"
    return f"list_sum(list_transform({lst}, lambda v, i: v*{k}))/list_sum(list_transform({lst}, lambda v, i: {k}))"


SQL_EWM = with_views(
    BARS,
    lists='select symbol, bucket, list("close") over (partition by symbol order by bucket) l from fx_bars',
    e=f"select symbol, bucket, {_ewm('l', 9)} ewm_9, {_ewm('l', 26)} ewm_26 from lists",
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6('ewm_9', 'ewm_26')} FROM e"

MACD_VIEWS = {
    "lists": 'select symbol, bucket, "close", list("close") over (partition by symbol order by bucket) l from fx_bars',
    "dif0": f"""select symbol, bucket, "close", {_ewm('l', 12)} - {_ewm('l', 26)} d from lists""",
    "difs": """select symbol, bucket, "close", case when abs(d) > 1e-12*abs("close") then d else 0 end dif from dif0""",
    "dlists": "select *, list(dif) over (partition by symbol order by bucket) l from difs",
    "mac0": f"""select symbol, bucket, "close", dif, {_ewm('l', 9)} dea, dif - {_ewm('l', 9)} m from dlists""",
    "macds": """select *, case when abs(m) > 1e-12*abs("close") then m else 0 end macd from mac0""",
}


def decayed(spark, sf):
    series = Ordered.on_grid(hourly_bars(spark, sf).select("symbol", "bucket", "close"), ["symbol"], "bucket", HOUR)
    return report(rolling.decayed_mean(series, "close", 12, 0.9, "decayed").done(), "symbol", "bucket", "decayed")


SQL_DECAYED = with_views(
    BARS,
    l="""select symbol, bucket, list("close") over (partition by symbol order by bucket
        rows between 11 preceding and current row) l from fx_bars""",
    d="""select symbol, bucket, case when len(l)=12 then
        list_sum(list_transform(l, lambda v, i: v*pow(0.9, 12-i)))/
        list_sum(list_transform(l, lambda v, i: pow(0.9, 12-i))) end decayed from l""",
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6('decayed')} FROM d"


def matrix(spark, sf):
    made = rolling.window_matrix(hourly_bars(spark, sf), ["close", "volume"], 4, HOUR)
    flat = F.flatten("window")
    return report(made.select("symbol", "bucket", *[F.get(flat, F.lit(i)).alias(f"x{i}") for i in range(8)]))


SQL_MATRIX = with_views(
    BARS,
    m="select symbol, bucket, row_number() over w rn, " + ", ".join(
        f'lag("close",{3 - i}) over w x{2 * i}, lag(volume,{3 - i}) over w x{2 * i + 1}' for i in range(4)
    ) + " from fx_bars window w as (partition by symbol order by bucket)",
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6(*[f'x{i}' for i in range(8)])} FROM m WHERE rn >= 4"


def changes(spark, sf):
    made = rolling.percent_change(hourly_bars(spark, sf), "close", HOUR)
    return report(made, "symbol", "bucket", "pct_return")


SQL_CHANGES = with_views(
    BARS, p='''select symbol, bucket, coalesce("close"/lag("close") over (partition by symbol order by bucket)-1, 0)
        pct_return from fx_bars''',
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6('pct_return')} FROM p"


def cleaned(spark, sf):
    bars = hourly_bars(spark, sf)
    share = F.try_divide(F.col("ntrade_up"), F.col("ntrade_flat")).cast("double")
    return report(bars.select("symbol", "bucket", clean(share).alias("up_per_flat"), clean(F.col("twap")).alias("twap")))


SQL_CLEANED = with_views(
    BARS, c="select symbol, bucket, coalesce(ntrade_up/nullif(ntrade_flat,0),0) up_per_flat, coalesce(twap,0) twap from fx_bars",
) + f"\nSELECT symbol, epoch_us(bucket) bucket, {r6('up_per_flat', 'twap')} FROM c"


def name_families(spark, sf):
    """Families found in the names of the side bars, with rows per bar as data."""
    bars = resample.trade_bars(trades(spark, sf), HOUR, by_side=True)
    found = [("ohlcv", f"{p}|{s}", len(m)) for (p, s), m in ohlcv_families(bars.columns).items()]
    found += [("ohlc", f"{p}|{s}", len(m)) for (p, s), m in ohlc_families(bars.columns).items()]
    rows = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(f).alias("family"), F.lit(n).alias("members"))
                     for k, f, n in found])
    return bars.agg(F.count(F.lit(1)).alias("n_bars")).select("n_bars", F.inline(rows))


SQL_FAMILIES = with_views(["fx_sparse"]) + """
SELECT (SELECT count(*) FROM fx_sparse) n_bars, kind, family, members FROM (VALUES
 ('ohlcv', '|', 5), ('ohlcv', '|_buy', 5), ('ohlcv', '|_sell', 5),
 ('ohlc', '|', 4), ('ohlc', '|_buy', 4), ('ohlc', '|_sell', 4)) t(kind, family, members)"""

QUERIES = {
    "candle_shapes": (candle_shapes, _candle_sql()),
    "trade_shares": (trade_shares, _trade_shares_sql()),
    "quote_shares": (quote_shares, _quote_shares_sql()),
    "rolling_ohlcv": (rolling_ohlcv, _rolling_sql(True, max(WINDOWS) + 10)),
    "rolling_families": (rolling_families, _families_sql()),
    "rolling_ohlc": (rolling_ohlc, SQL_ROLLING_OHLC),
    "price_trends": (price_trends, _trend_sql()),
    "exponential_means": (exponential, SQL_EWM),
    "decayed_mean": (decayed, SQL_DECAYED),
    "window_matrix": (matrix, SQL_MATRIX),
    "percent_change": (changes, SQL_CHANGES),
    "clean_values": (cleaned, SQL_CLEANED),
    "name_families": (name_families, SQL_FAMILIES),
}
