"""Rolling features over dense bars (RW1-RW26, PR7).

Row frames run inside grid blocks with the reach of the largest window, all on
one window specification, so a table of many windows is shuffled and sorted
once. A value exists only when its frame holds ``w`` values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.functions.columns import clean_sql, log, ratio, total
from barloom.functions.names import ohlc_families, ohlcv_families
from barloom.operators.order_stats import window_stats
from barloom.operators.ordering import GRID_ROWS_PER_BLOCK, Ordered
from barloom.session import join_per_key, settle

TINY = 1e-12
# Fixed default windows, in bars.
WINDOWS = (2, 6, 12, 16, 24, 48)
# Windows above this many rows take their order statistics from a tree over the block, not from a list per row.
LONG = 128
# Spans of exponential means up to this many times the shortest one are made together.
TOGETHER = 4
# Columns per select; wider projections leave whole-stage code generation anyway
# and slow down analysis.
PER_BLOCK = 200


class _Group:
    """Expressions of one (open, high, low, close[, volume]) group, as SQL text.

    The default set is thousands of columns; text is parsed in the JVM, where
    building the same trees call by call would take the driver minutes.
    """

    def __init__(self, tag: str, names: Mapping[str, str], spec: str):
        self.tag, self.spec, self.volume = tag, spec, "volume" in names
        self.col = {word: f"`{name}`" for word, name in names.items()}

    def own(self, name: str) -> str:
        return f"`_{name}{self.tag}`"

    def frame(self, w: int) -> str:
        return f"OVER ({self.spec} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"

    def steps(self) -> dict[str, str]:
        """One-step changes."""
        close = self.col["close"]
        before = f"lag({close}) OVER ({self.spec})"
        out = {"move": f"try_divide({close}, {before})", "ret": f"try_divide({close}, {before}) - 1"}
        if self.volume:
            volume = self.col["volume"]
            volume_before = f"lag({volume}) OVER ({self.spec})"
            growth = f"try_divide({volume}, {volume_before}) + 1"
            out |= {
                "vchg": f"{volume} - {volume_before}",
                "lvol": f"CASE WHEN {volume} > -1 THEN ln({volume} + 1) END",
                "lvmove": f"CASE WHEN {growth} > 0 THEN ln({growth}) END",
                "churn": f"abs(try_divide({close}, {before}) - 1) * {volume}",
            }
        return {self.own(k): v for k, v in out.items()}

    def frames(self, w: int) -> dict[str, str]:
        """Everything that needs the frame of ``w`` rows."""
        over, close = self.frame(w), self.col["close"]
        ret = self.own("ret")

        def full(value: str, *columns: str) -> str:
            whole = " AND ".join(f"count({c}) {over} = {w}" for c in columns)
            return f"CASE WHEN {whole} THEN {value} END"

        def of(function: str, column: str) -> str:
            return full(f"{function}({column}) {over}", column)

        def correlation(x: str, y: str) -> str:
            varies = " AND ".join(f"max({c}) {over} > min({c}) {over}" for c in (x, y))
            spread = f"stddev_pop({x}) {over} * stddev_pop({y}) {over}"
            value = f"CASE WHEN {varies} THEN try_divide(covar_pop({x}, {y}) {over}, {spread}) END"
            return full(value, x, y)

        out = {
            "back": f"lag({close}, {w}) OVER ({self.spec})",
            "mean": of("avg", close), "std": of("stddev_samp", close),
            "max": of("max", close), "min": of("min", close),
            "n": f"count(1) {over}",
            "ups": f"count_if({ret} > 0) {over}", "downs": f"count_if({ret} < 0) {over}",
            "gain": full(f"sum(greatest({ret}, 0D)) {over}", ret),
            "path": full(f"sum(abs({ret})) {over}", ret),
        }
        if self.volume:
            volume, vchg = self.col["volume"], self.own("vchg")
            out |= {
                "corr": correlation(close, self.own("lvol")),
                "cord": correlation(self.own("move"), self.own("lvmove")),
                "vmean": of("avg", volume), "vstd": of("stddev_samp", volume),
                "cmean": of("avg", self.own("churn")), "cstd": of("stddev_samp", self.own("churn")),
                "vgain": full(f"sum(greatest({vchg}, 0D)) {over}", vchg),
                "vpath": full(f"sum(abs({vchg})) {over}", vchg),
            }
        if w <= LONG:  # longer ones come from ``long_frames``
            out |= {
                "qu": full(f"percentile({close}, 0.8D) {over}", close),
                "qd": full(f"percentile({close}, 0.2D) {over}", close),
                "closes": of("collect_list", close),
                "highs": of("collect_list", self.col["high"]),
                "lows": of("collect_list", self.col["low"]),
            }
        return {self.own(f"{k}_{w}"): v for k, v in out.items()}

    def long_frames(self, pdf: pd.DataFrame, windows: Sequence[int]) -> dict[str, np.ndarray]:
        """Order statistics of the windows above ``LONG``, where a list of the window per row would not do."""
        found = window_stats(*[pdf[self.col[c].strip("`")].to_numpy(float) for c in ("close", "high", "low")], tuple(windows))
        return {self.own(k).strip("`"): v for k, v in found.items()}

    def features(self, w: int) -> dict[str, str]:
        """RW1-RW19 from the frame columns, null and infinite values 0."""
        def g(name: str) -> str:
            return self.own(f"{name}_{w}")

        def per(top: str, bottom: str) -> str:
            return f"try_divide({top}, {bottom})"

        close, high, low = (self.col[c] for c in ("close", "high", "low"))
        back, std = g("back"), f"({g('std')} + {TINY}D)"
        floor_ = f"CASE WHEN {back} IS NOT NULL THEN least({low}, {back}) END"
        roof = f"CASE WHEN {back} IS NOT NULL THEN greatest({high}, {back}) END"
        seen, less = f"{g('closes')} IS NOT NULL", f"size(filter({g('closes')}, x -> x < {close}))"
        equal = f"size(filter({g('closes')}, x -> x = {close}))"
        first_high = f"(array_position({g('highs')}, array_max({g('highs')})) - 1)"
        first_low = f"(array_position({g('lows')}, array_min({g('lows')})) - 1)"
        if w > LONG:
            seen, less, equal, first_high, first_low = f"{g('less')} IS NOT NULL", g("less"), g("equal"), g("fh"), g("fl")
        up, down = (f"CASE WHEN {g('n')} = {w} THEN {g(c)} / {w} END" for c in ("ups", "downs"))
        gain = per(g("gain"), f"{g('path')} + {TINY}D")
        # Fixed column names.
        out = {
            "roc": per(back, close), "ma": per(g("mean"), close), "std": per(g("std"), close),
            "beta": per(f"{back} - {close}", f"{w} * {close}"),
            "max": per(g("max"), close), "min": per(g("min"), close),
            "qtlu": per(g("qu"), close), "qtld": per(g("qd"), close),
            "rank": f"CASE WHEN {seen} THEN ({less} + ({equal} + 1) / 2) / {w} / {w} END",
            "imax": f"{first_high} / {w}", "imin": f"{first_low} / {w}",
            "imxd": f"({first_high} - {first_low}) / {w}",
            "rsv": per(f"{close} - {floor_}", f"{roof} - {floor_} + {TINY}D"),
            "cntp": up, "cntn": down, "cntd": f"{up} - {down}",
            "sump": gain, "sumn": f"1 - {gain}", "sumd": f"2 * {gain} - 1",
        }
        scaled = {
            "roc": f"{back} / {std}", "ma": f"{g('mean')} / {std}",
            "beta": f"({back} - {close}) / ({w} * {std})",
            "max": f"{g('max')} / {std}", "min": f"{g('min')} / {std}",
            "qtlu": f"{g('qu')} / {std}", "qtld": f"{g('qd')} / {std}",
        }
        if self.volume:
            volume = f"{self.col['volume']} + {TINY}D"
            vgain = per(g("vgain"), f"{g('vpath')} + {TINY}D")
            out |= {
                "corr": g("corr"), "cord": g("cord"),
                "vma": per(g("vmean"), volume), "vstd": per(g("vstd"), volume),
                "wvma": per(g("cstd"), f"{g('cmean')} + {TINY}D"),
                "vsump": vgain, "vsumn": f"1 - {vgain}", "vsumd": f"2 * {vgain} - 1",
            }
            scaled |= {
                "rsv": f"({close} - {floor_}) / ({std} + {TINY}D)",
                "vma": f"{g('vmean')} / ({g('vstd')} + {TINY}D + {TINY}D)",
            }
        named = {f"{k}_{w}{self.tag}": v for k, v in out.items()}
        named |= {f"{k}_{w}_std_norm{self.tag}": v for k, v in scaled.items()}
        if self.volume:
            named[f"log_volume{self.tag}"] = self.own("lvol")
        return {k: clean_sql(v) for k, v in named.items()}


def trim_start(df: DataFrame, rows: int, seconds: int, keys: Sequence[str] = ("symbol",),
               ts: str = "bucket", source: DataFrame | None = None) -> DataFrame:
    """PR7: drop the first ``rows`` grid rows of each series.

    ``source`` is a cheaper table with the same series, such as the bars that
    ``df`` was made from.
    """
    starts = (df if source is None else source).groupBy(*keys).agg(F.min(ts).alias("_start"))
    late = F.unix_seconds(ts) - F.unix_seconds("_start") >= rows * seconds
    return join_per_key(df, starts, keys).where(late).drop("_start")


def rolling_groups(bars: DataFrame, seconds: int, groups: Mapping[str, Mapping[str, str]],
                   windows: Sequence[int] = WINDOWS, keys: Sequence[str] = ("symbol",),
                   ts: str = "bucket", rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RW1-RW19, RW21: all features of the given groups (tag to column names)."""
    used = dict.fromkeys([*keys, ts, *[c for names in groups.values() for c in names.values()]])
    series = Ordered.on_grid(bars.select(*used), keys, ts, seconds, rows_per_block)
    made = [_Group(tag, names, series.window_sql) for tag, names in groups.items()]

    def plus(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
        return df.selectExpr("*", *[f"{v} AS {k}" for k, v in columns.items()])

    if long := [w for w in windows if w > LONG]:
        names = [g.own(f"{k}_{w}") for g in made for w in long for k in ("less", "equal", "qu", "qd", "fh", "fl")]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.select(*used).schema.fields)
        # NaN from pandas is null again.
        ranked = series.map_blocks(
            lambda pdf: pdf[[*used]].assign(**{k: v for g in made for k, v in g.long_frames(pdf, long).items()}),
            schema + "".join(f", {c} double" for c in names), back=max(long))
        ranked = ranked.selectExpr(*[f"`{c}`" for c in used], *[f"nanvl({c}, NULL) AS {c}" for c in names])
        series = Ordered.on_grid(ranked, keys, ts, seconds, rows_per_block)
    framed = series.with_frames_sql(
        lambda df: plus(df, {k: v for g in made for k, v in g.steps().items()}),
        lambda df: plus(df, {k: v for g in made for w in windows for k, v in g.frames(w).items()}),
        back=max(windows) + 1,
    ).done()
    features = {k: v for g in made for w in windows for k, v in g.features(w).items()}
    return framed.selectExpr(*keys, ts, *[f"{v} AS `{k}`" for k, v in features.items()])


def rolling_features(bars: DataFrame, seconds: int, windows: Sequence[int] = WINDOWS,
                     keys: Sequence[str] = ("symbol",), ts: str = "bucket",
                     rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RW22: features of every OHLCV group and every other OHLC group, warm-up trimmed.

    Groups are handled a few at a time to keep each select at a bounded width.
    """
    ohlcv = ohlcv_families(bars.columns)
    both = dict(ohlcv) | {k: v for k, v in ohlc_families(bars.columns).items() if k not in ohlcv}
    groups = {f"{p}{s}" or "_origin": members for (p, s), members in both.items()}
    step = max(1, PER_BLOCK // (36 * len(windows)))
    tags, result = list(groups), None
    for i in range(0, len(tags), step):
        some = {t: groups[t] for t in tags[i : i + step]}
        part = rolling_groups(bars, seconds, some, windows, keys, ts, rows_per_block)
        if len(tags) > step:
            part = settle(part, "rolling")
        result = part if result is None else result.join(part, [*keys, ts])
    margin = 10 if ohlcv else 1
    return trim_start(result, max(windows) + margin, seconds, keys, ts, bars)


def price_features(df: DataFrame, seconds: int, columns: Sequence[str],
                   windows: Sequence[int] = WINDOWS, keys: Sequence[str] = ("symbol",),
                   ts: str = "bucket", rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RW20: log return x 1000 and distance to the rolling mean in std units.

    The log return does not depend on the window, so it is made once.
    """
    series = Ordered.on_grid(df.select(*keys, ts, *columns), keys, ts, seconds, rows_per_block)

    def features(spec: WindowSpec) -> dict[str, Column]:
        out = {}
        for c in columns:
            x = F.col(c)
            out[f"{c}_log_return"] = log(ratio(x, F.lag(x).over(spec) + TINY)) * 1000
            for w in windows:
                f = spec.rowsBetween(1 - w, 0)
                trend = (x - F.avg(x).over(f)) / (F.stddev_samp(x).over(f) + TINY)
                if w > 1:
                    out[f"{c}_trend_{w}"] = F.when(F.count(x).over(f) == w, trend)
        return out

    made = series.with_frames(features, back=max(windows)).done().drop(*columns)
    return trim_start(made, max(windows) + 1, seconds, keys, ts, df)


def _ewm_reach(span: int) -> int:
    """Rows after which the weight of an exponential mean is below 1e-17."""
    reach, weight = 0, 1.0
    while weight > 1e-17:
        weight *= 1 - 2 / (span + 1)
        reach += 1
    return reach


def exponential_columns(df: DataFrame, means: Mapping[str, tuple[str, int]], seconds: int,
                        keys: Sequence[str] = ("symbol",), ts: str = "bucket") -> DataFrame:
    """RW23: exponentially weighted means (``adjust=True``): ``means`` gives a name its (column, span).

    A mean is a discounted sum over the discounted number of values; unset
    values only age the others. Rows are cut into stretches in which no weight
    falls below 1e-8: inside one, discounted sums are plain window sums of
    values scaled by their place. The sums of the stretches before come in as
    one row per stretch, from as many of them as double precision can tell.
    Spans within a factor of ``TOGETHER`` share stretches, so neither many short
    stretches reach back nor do weights vanish inside one. Needs a dense grid.
    """
    if min(span for _, span in means.values()) <= 1:
        raise ValueError("a span must be above 1")
    classes: list[dict[str, tuple[str, int]]] = []
    for name, (column, span) in sorted(means.items(), key=lambda m: m[1][1]):
        if not classes or span > TOGETHER * min(s for _, s in classes[-1].values()):
            classes.append({})
        classes[-1][name] = (column, span)
    parts = [_stretched(df, some, seconds, keys, ts) for some in classes]
    made = parts[0]
    for part in parts[1:]:
        made = made.join(part.drop(*[c for c in df.columns if c not in {*keys, ts}]), [*keys, ts])
    return made.select(*df.columns, *means)


def _stretched(df: DataFrame, means: Mapping[str, tuple[str, int]], seconds: int, keys: Sequence[str], ts: str) -> DataFrame:
    keep = {name: 1.0 - 2.0 / (span + 1.0) for name, (_, span) in means.items()}
    length = max(1, int(-math.log(1e8) / math.log(min(keep.values()))))
    back = max(_ewm_reach(span) for _, span in means.values()) // length + 2
    place = F.floor(F.unix_seconds(ts) / seconds)
    rows = df.withColumns({"_part": F.floor(place / length), "_at": F.pmod(place, F.lit(length))})
    inside = Window.partitionBy(*keys, "_part").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    terms = {}
    for name, w in keep.items():
        value, scale = F.col(means[name][0]), F.pow(F.lit(w), F.col("_at"))
        terms[name] = (F.coalesce(value, F.lit(0.0)) / scale, value.isNotNull().cast("double") / scale)
    totals = rows.groupBy(*keys, "_part").agg(*[
        (F.sum(t[i]) * w ** (length - 1)).alias(f"_{'vn'[i]}_{name}")
        for name, w in keep.items() for t in (terms[name],) for i in (0, 1)])
    later = totals.select("*", F.explode(F.sequence(F.lit(1), F.lit(back))).alias("_j"))
    carried = later.groupBy(*keys, (F.col("_part") + F.col("_j")).alias("_part")).agg(*[
        F.sum(F.col(f"_{x}_{name}") * F.pow(F.lit(w), length * (F.col("_j") - 1))).alias(f"_c{x}_{name}")
        for name, w in keep.items() for x in "vn"])
    summed = rows.withColumns({f"_{'vn'[i]}_{name}": F.sum(terms[name][i]).over(inside) for name in keep for i in (0, 1)})
    joined = summed.join(carried, [*keys, "_part"], "left")

    def total(x: str, name: str, w: float) -> Column:
        aged = F.coalesce(F.col(f"_c{x}_{name}"), F.lit(0.0)) * F.pow(F.lit(w), F.col("_at") + 1)
        return F.col(f"_{x}_{name}") * F.pow(F.lit(w), F.col("_at")) + aged

    return joined.select(*df.columns, *[ratio(total("v", name, w), total("n", name, w)).alias(name) for name, w in keep.items()])


def exponential_means(df: DataFrame, column: str, spans: Mapping[str, int], seconds: int,
                      keys: Sequence[str] = ("symbol",), ts: str = "bucket") -> DataFrame:
    """RW23: exponentially weighted means of one column, one per span."""
    return exponential_columns(df.select(*keys, ts, column), {name: (column, span) for name, span in spans.items()}, seconds, keys, ts)


def _difference(a: str, b: str, column: str) -> Column:
    """Difference of two columns; rounding noise of the price (a series that does not move) is exactly 0."""
    apart = F.col(a) - F.col(b)
    return F.when(F.abs(apart) > TINY * F.abs(F.col(column)), apart).otherwise(F.lit(0.0))


def macd_sets(df: DataFrame, column: str, seconds: int, sets: Mapping[str, tuple[int, int, int]],
              keys: Sequence[str] = ("symbol",), ts: str = "bucket") -> DataFrame:
    """SG1, JN10: ``dif``, ``dea`` and ``macd`` of every (short, mid, long) set, as columns ending in its name.

    All sets share the passes over the rows: one for the means of the price, one
    for the means of the differences. No row is copied per set.
    """
    spans = {f"_e{n}": (column, n) for n in sorted({n for s in sets.values() for n in s[1:]})}
    means = exponential_columns(df.select(*keys, ts, column), spans, seconds, keys, ts)
    fast = means.select(*keys, ts, column, *[
        _difference(f"_e{mid}", f"_e{long}", column).alias(f"dif{name}") for name, (_, mid, long) in sets.items()])
    both = exponential_columns(fast, {f"dea{name}": (f"dif{name}", short) for name, (short, _, _) in sets.items()}, seconds, keys, ts)
    return both.withColumns({f"macd{name}": _difference(f"dif{name}", f"dea{name}", column) for name in sets})


def macd(df: DataFrame, column: str, seconds: int, short: int = 9, mid: int = 12, long: int = 26,
         keys: Sequence[str] = ("symbol",), ts: str = "bucket") -> DataFrame:
    """SG1: DIF, its exponential mean DEA, and MACD = DIF - DEA.

    Decisions turn on the sign of DIF and MACD, so differences that are rounding
    noise of the price (a series that does not move) are exactly 0.
    """
    return macd_sets(df, column, seconds, {"": (short, mid, long)}, keys, ts)


def decayed_mean(series: Ordered, column: str, length: int, decay: float, out: str) -> Ordered:
    """RW24: mean of the last ``length`` rows, weights ``decay`` per row of age."""
    weights = F.array(*[F.lit(decay ** (length - 1 - i)) for i in range(length)])
    norm = sum(decay**i for i in range(length))

    def stage(spec: WindowSpec) -> dict[str, Column]:
        f = spec.rowsBetween(1 - length, 0)
        values = F.collect_list(column).over(f)
        mean = total(F.zip_with(values, weights, lambda v, k: v * k)) / norm
        return {out: F.when(F.count(column).over(f) == length, mean)}

    return series.with_frames(stage, back=length)


def window_matrix(df: DataFrame, columns: Sequence[str], length: int, seconds: int,
                  keys: Sequence[str] = ("symbol",), ts: str = "bucket",
                  rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RW25: the last ``length`` feature rows as one nested array; full frames only."""
    series = Ordered.on_grid(df.select(*keys, ts, *columns), keys, ts, seconds, rows_per_block)

    def stage(spec: WindowSpec) -> dict[str, Column]:
        rows = F.collect_list(F.array(*columns)).over(spec.rowsBetween(1 - length, 0))
        return {"window": rows}

    made = series.with_frames(stage, back=length).done()
    return made.where(F.size("window") == length).select(*keys, ts, "window")


def percent_change(df: DataFrame, column: str, seconds: int, out: str = "pct_return",
                   keys: Sequence[str] = ("symbol",), ts: str = "bucket",
                   rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RW26: one-step relative change, 0 in the first row."""
    series = Ordered.on_grid(df, keys, ts, seconds, rows_per_block)

    def stage(spec: WindowSpec) -> dict[str, Column]:
        return {out: F.coalesce(ratio(F.col(column), F.lag(column).over(spec)) - 1, F.lit(0.0))}

    return series.with_frames(stage, back=1).done()
