"""Hand-written rows against plain Python definitions, and invariants."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions.names import ohlc_families, ohlcv_families, share_families
from barloom.operators import candles, dedup, execution, joins, resample, rolling, runs, sampling, selection, signals, weights
from barloom.operators.book import snapshot_features
from barloom.operators.ordering import Ordered
from barloom.operators.quantiles import quantile_values
from barloom.operators.weights import density_weights
from barloom.sources import tables

T0 = dt.datetime(2024, 1, 1)


def hours(n):
    return [T0 + dt.timedelta(hours=i) for i in range(n)]


def test_side_gap_differs_from_global_gap(spark):
    rows = [("s", T0 + dt.timedelta(minutes=m), i, side, p, 1.0) for i, (m, side, p) in enumerate(
        [(50, "buy", 10.0), (65, "buy", 20.0), (70, "sell", 30.0), (80, "buy", 40.0)])]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, id int, side string, price double, amount double")
    bar = resample.trade_bars(df, 3600, by_side=True).orderBy("bucket").collect()
    # Global gaps reach over the hour; the first row has none.
    assert bar[0].twap is None
    assert bar[1].twap == pytest.approx((20 * 15 + 30 * 5 + 40 * 10) / 30)
    # A side's gaps stay inside its bucket.
    assert bar[1].twap_buy == pytest.approx(40.0)
    assert bar[1].twap_sell is None
    assert (bar[1].ntrade_up_buy, bar[1].ntrade_up, bar[0].volume_sell) == (2, 3, 0.0)


def test_first_quote_of_a_bucket_counts_as_changed(spark):
    rows = [("s", T0 + dt.timedelta(minutes=m), b, b + 1, 1.0, 1.0) for m, b in ((10, 5.0), (20, 5.0), (61, 5.0), (62, 6.0))]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, bid_price double, ask_price double, "
                                     "bid_amount double, ask_amount double")
    bar = resample.quote_bars(df, 3600, ohlc=False).orderBy("bucket").collect()
    assert [(r.nquote, r.nquote_bid, r.nquote_bid_up, r.nquote_bidsize) for r in bar] == [(2, 1, 0, 1), (2, 2, 1, 1)]
    assert bar[1].nquote_bid_askflat == 0


def test_rank_and_argmax_against_pandas(spark):
    close = [5.0, 3.0, 3.0, 8.0, 3.0, 9.0, 9.0, 1.0]
    pdf = pd.DataFrame({"symbol": "s", "bucket": hours(8), "open": close, "high": [c + 1 for c in close],
                        "low": [c - 1 for c in close], "close": close, "volume": [1.0] * 8})
    groups = {"": {c: c for c in ("open", "high", "low", "close", "volume")}}
    got = rolling.rolling_groups(spark.createDataFrame(pdf), 3600, groups, (4,)).orderBy("bucket").toPandas()
    r = pdf["close"].rolling(4)
    want = r.apply(lambda x: pd.Series(x).rank(pct=True).iloc[-1]) / 4
    assert np.allclose(got["rank_4"], want.fillna(0))
    assert np.allclose(got["imax_4"], (pdf["high"].rolling(4).apply(np.argmax) / 4).fillna(0))
    assert np.allclose(got["qtlu_4"], (r.quantile(0.8) / pdf["close"]).fillna(0))
    # Constant volume: no correlation, no infinite values.
    assert (got[["corr_4", "cord_4"]] == 0).all().all()
    full = got.iloc[4:]
    assert (full["cntp_4"] + full["cntn_4"] <= 1).all()
    assert np.allclose(full["sump_4"] + full["sumn_4"], 1)


def test_warm_up_rows(spark):
    pdf = pd.DataFrame({"symbol": "s", "bucket": hours(30), **{c: 1.0 for c in ("open", "high", "low", "close", "volume")}})
    assert rolling.rolling_features(spark.createDataFrame(pdf), 3600, (3, 6)).count() == 30 - 16
    ohlc = spark.createDataFrame(pdf.drop(columns="volume"))
    assert rolling.rolling_features(ohlc, 3600, (3, 6)).count() == 30 - 7


def test_families():
    names = ["open", "high", "low", "close", "volume", "open_mid", "high_mid", "low_mid", "close_mid", "x"]
    assert list(ohlcv_families(names)) == [("", "")]
    assert list(ohlc_families(names)) == [("", ""), ("", "_mid")]
    shares = share_families(["ntrade", "ntrade_up", "ntrade_down", "ntrade_buy", "ntrade_sell", "nquote_bid_up", "nquote_ask_up"])
    assert shares["up_down"] == [{"total": "ntrade", "up": "ntrade_up", "down": "ntrade_down"}]
    assert shares["buy_sell"][0]["total"] == "ntrade"
    assert shares["bid_ask"] == [{"bid": "nquote_bid_up", "ask": "nquote_ask_up"}]


def test_flat_candle_has_no_noise(spark):
    df = spark.createDataFrame([("s", T0, *[0.1 + 0.2] * 4, 0.3, 0.3)],
                               "symbol string, bucket timestamp, open double, high double, low double, close double, "
                               "twap double, awap double")
    row = candles.candle_features(df).first().asDict()
    assert all(abs(v) < 1e-9 for k, v in row.items() if k.startswith("k"))


def sweep(prices, sizes, q):
    value, rest = 0.0, q
    for p, s in zip(prices, sizes, strict=True):
        take = min(rest, s)
        value, rest = value + take * p, rest - take
    return value, q - rest


@pytest.mark.parametrize("quantity", [0.5, 1.0, 3.0, 99.0])
def test_sweep(spark, quantity):
    prices, sizes = [10.0, 11.0, 12.0], [1.0, 1.5, 2.0]
    df = spark.createDataFrame([(prices, sizes, quantity)], "p array<double>, s array<double>, q double")
    got = df.select(execution.sweep(F.col("p"), F.col("s"), F.col("q")).alias("x")).first().x
    assert (got.value, got.filled) == pytest.approx(sweep(prices, sizes, quantity))
    assert got.filled <= sum(sizes)


def test_dust_counts_as_filled(spark):
    df = spark.createDataFrame([([10.0], [1.0], 1.000005)], "p array<double>, s array<double>, q double")
    got = df.select(execution.sweep(F.col("p"), F.col("s"), F.col("q")).alias("x")).first().x
    assert (got.value, got.filled) == (10.0, 1.000005)


def test_book_sizes_sum_to_one(spark):
    rng = np.random.default_rng(1)
    row = ("s", 1, *[rng.random(25).tolist() for _ in range(4)])
    df = spark.createDataFrame([row], "symbol string, id int, ask_price array<double>, ask_size array<double>, "
                                      "bid_price array<double>, bid_size array<double>")
    got = snapshot_features(df, ["symbol"]).first().asDict()
    for side in ("ask", "bid"):
        assert sum(got[f"{side}{i}_size_n"] for i in range(1, 26)) == pytest.approx(1)
    assert got["ask_size_topk_size_5_increments"] == pytest.approx(max(row[3]) - row[3][0])


def test_kernel_density_against_brute_force(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=300), np.full(150, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"i": range(450), "x": x}))
    h = weights.silverman_bandwidth(df, "x")
    q75, q25 = np.quantile(x, [0.75, 0.25])
    assert h == pytest.approx(1.06 * min(x.std(), (q75 - q25) / 1.34) * 450 ** -0.2)
    got = weights.density_weights(df, "x").orderBy("i").toPandas()["weight"]
    density = np.exp(-((x[:, None] - x) ** 2) / (2 * h * h)).sum(1) / (450 * h * math.sqrt(2 * math.pi))
    want = 1 / density / (1 / density).sum()
    assert np.allclose(got, want, rtol=1e-9)
    assert got.sum() == pytest.approx(1)


def test_stratified_sample_has_one_row_per_part(spark):
    df = spark.range(200).select("id", F.when(F.col("id") == 50, 1000.0).otherwise(1.0).alias("p"))
    for size in (16, 10**6):
        got = weights.stratified_sample(df, "id", "p", 40, 0.4, rows_per_block=size).orderBy("draw").toPandas()
        assert got["draw"].tolist() == list(range(40))
        assert (got["id"] == 50).sum() >= 30
        assert got["importance"].max() == 1


def test_pruning_keeps_first_of_close_features(spark):
    corr = spark.createDataFrame([("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", -0.8)], "f1 string, f2 string, corr double")
    assert selection.prune_correlated(["a", "b", "c"], corr, 0.7) == ["a", "c"]
    assert selection.prune_correlated(["b", "a", "c"], corr, 0.7) == ["b"]


def test_lasso_and_trees_find_the_signal(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=3 * x[:, 0] + 0.01 * rng.normal(size=400))
    df = spark.createDataFrame(pdf)
    names = {r.feature for r in selection.lasso_features(df, ["a", "b", "c"], "y", (0.5, 5.0), 3).collect()}
    assert names == {"a"}
    top = selection.tree_importance(df, ["a", "b", "c"], "y", 3, 3).orderBy(F.desc("importance")).first()
    assert top.feature == "a"


def test_twin_columns_are_dropped(spark):
    df = spark.createDataFrame([(1, 1.0, 1.0, None), (2, 2.0, 2.0, 2.0)], "k int, a double, b double, c double")
    assert dedup.drop_equal_columns(df, ["k"], ["a", "b", "c"]).columns == ["k", "a", "c"]
    assert dedup.move_column(df, "c", 1).columns == ["k", "c", "a", "b"]


def test_point_in_time_never_sees_its_own_bar(spark):
    now = spark.createDataFrame([("s", t, float(i)) for i, t in enumerate(hours(5)) if i != 2], "symbol string, bucket timestamp, m double")
    later = spark.createDataFrame([("s", t, 10.0 * i) for i, t in enumerate(hours(5))], "symbol string, bucket timestamp, x double")
    got = joins.point_in_time(now, later, 3600, ["x"]).orderBy("bucket").collect()
    assert [(r.m, r.x) for r in got] == [(1.0, 0.0), (1.0, 10.0), (3.0, 20.0), (4.0, 30.0)]


def test_chunks_are_full(spark):
    df = spark.range(1, 31).select(F.lit("s").alias("symbol"), F.col("id").alias("rn"))
    got = sampling.overlapping_chunks(df, 8, 2, ["symbol"], "rn").groupBy("chunk_id").agg(
        F.min("rn").alias("a"), F.max("rn").alias("b"), F.count("*").alias("n")).orderBy("chunk_id").collect()
    assert [(r.a, r.b, r.n) for r in got] == [(1, 10, 10), (9, 18, 10), (17, 26, 10)]


def test_audits(spark):
    df = spark.createDataFrame([("a", T0), ("b", T0 + dt.timedelta(days=1))], "symbol string, ts timestamp")
    gone = tables.missing_days({"t": df}, "2024-01-01", "2024-01-02")
    assert {(r.symbol, str(r.day)) for r in gone.collect()} == {("a", "2024-01-02"), ("b", "2024-01-01")}
    full = tables.completeness(df, "2024-01-01", "2024-01-01", 86400).collect()
    assert {(r.symbol, r.complete) for r in full} == {("a", True), ("b", False)}


def test_actions_round_trip(spark):
    positions, levers = (-4, 0, 4), (1, 5)
    df = spark.range(5).select(F.col("id").cast("int").alias("a"))
    part = execution.action_parts(F.col("a"), positions, levers)
    got = df.withColumn("p", part).select("a", "p", execution.action_of(F.col("p.position"), F.col("p.leverage"), positions, levers).alias("b")).collect()
    assert all(r.a == r.b for r in got)
    assert [(r.p.position, r.p.leverage) for r in got] == [(-4, 1), (-4, 5), (0, 1), (4, 1), (4, 5)]


def test_events_need_no_cut_when_small(spark):
    df = spark.range(10).select(F.lit("s").alias("k"), "id")
    assert not Ordered.on_events(df, ["k"], ["id"]).split


def test_correlations_in_tiles_with_nulls(spark):
    rng = np.random.default_rng(12)
    pdf = pd.DataFrame(rng.normal(size=(200, 7)).round(3), columns=list("abcdefg"))
    pdf["b"] += pdf["a"]
    pdf["f"] = 3.25  # constant
    values = pdf.astype(object)
    for i, c in enumerate("abc"):
        values.loc[values.index % (i + 3) == 0, c] = None
    values.loc[values.index >= 2, "g"] = None
    rows = [tuple(None if x is None else float(x) for x in r) for r in values.itertuples(index=False)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in pdf.columns))
    want = values.astype(float).corr(min_periods=2)
    for tile in (2, 3, 256):
        got = {(r.f1, r.f2): r["corr"] for r in selection.correlations(df.repartition(5), list(pdf.columns), tile).collect()}
        assert len(got) == 21
        for (a, b), c in got.items():
            expected = want.loc[a, b]
            assert c is None if "f" in (a, b) or math.isnan(expected) else abs(c - expected) < 1e-9, (a, b)


def test_rank_coefficients_leave_nulls_out(spark):
    rng = np.random.default_rng(13)
    pdf = pd.DataFrame({"x": rng.integers(0, 20, 150), "z": rng.normal(size=150), "target_1": rng.integers(0, 9, 150)}).astype(object)
    pdf.loc[pdf.index % 3 == 0, "x"] = None
    pdf.loc[pdf.index % 7 == 0, "target_1"] = None
    rows = [tuple(None if x is None else float(x) for x in r) for r in pdf.itertuples(index=False)]
    df = spark.createDataFrame(rows, "x double, z double, target_1 double")
    got = {r.feature: r.ic for r in selection.rank_coefficients(df, ["x", "z"], (1,)).collect()}
    for f in "xz":
        both = pdf[[f, "target_1"]].dropna().astype(float).rank()
        assert abs(got[f] - both[f].corr(both["target_1"])) < 1e-9


def test_closed_trades_of_fractional_rewards(spark):
    rewards = [.3, 0, .1, -.4, 1, 2, .5, 0, .1, .2, -.3, .7]
    actions = [1, 2, 3, 1, 4, 2, 4, 4, 1, 2, 4, 4]
    state, want = 0, []
    for i, (r, a) in enumerate(zip(rewards, actions)):
        closes = a == 4 and round(state, 9) != 0
        state += r
        if closes:
            want.append((i + 1, round(state, 9), False))
            state = 0
    want.append((len(rewards), round(state, 9), True))
    log = spark.createDataFrame([("r", i + 1, a, float(r)) for i, (r, a) in enumerate(zip(rewards, actions))],
                                "run_id string, step long, action int, reward double")
    for size in (1, 2, 3, 5, 100):
        got = sorted((r.step, r.trade_return, r.is_open) for r in runs.closed_trades(log, rows_per_block=size).collect())
        assert got == sorted(want), size


def test_series_without_keys_in_blocks(spark):
    df = spark.range(1000).selectExpr("cast((id * 7919) % 1000 as double) / 8 v")
    assert quantile_values(df, "v", (0.25, 0.5), rows_per_block=50) == [31.21875, 62.4375]


def test_constant_columns_and_short_runs(spark):
    df = spark.createDataFrame([(i, 2.0, "k", i) for i in range(5)], "id long, v double, k string, pos long")
    table, _ = sampling.histogram(df, "v", 4)
    assert [r.n for r in table.orderBy("bin").collect()] == [0, 0, 5, 0]
    assert sampling.densest_bin(df.where("false"), "v", 4).count() == 0
    weights = {r.weight for r in density_weights(df, "v").collect()}
    assert len(weights) == 1 and abs(weights.pop() - 0.2) < 1e-9
    shares = signals.chunk_shares(df, ["k"], "pos", "id", 8, [0]).collect()
    assert [(r.chunk, r.percent) for r in shares] == [(7, 20.0)]
