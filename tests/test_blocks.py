"""Cutting a series into blocks must not change any result.

The ticks put half of all rows on one symbol, and a third on one time.
"""

import datetime as dt
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import dedup, execution, regimes, resample, rolling, runs, sampling, selection, signals
from barloom.operators.order_stats import window_stats
from barloom.operators.ordering import Ordered, last_set, next_set, running_max, running_product, running_sum
from barloom.operators.quantiles import exact_quantiles
from barloom.session import settle
from compare import differences

T0 = dt.datetime(2024, 1, 1)
BIG = 10**6


def frame(spark, pdf):
    return spark.createDataFrame(pdf)


def same(a, b, digits=9):
    a, b = a.toPandas(), b.toPandas()
    for pdf in (a, b):
        for c in pdf.select_dtypes("float"):
            pdf[c] = pdf[c].round(digits) + 0.0
    assert len(a) > 0
    assert differences(a, b[a.columns]) == ""


@pytest.fixture(scope="module")
def ticks(spark):
    rng = np.random.default_rng(5)
    n = 900
    seconds = np.sort(rng.integers(0, 40_000, n))
    seconds[300:600] = seconds[300]  # a third of all rows at one time
    pdf = pd.DataFrame({
        "symbol": np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b"], n)),
        "ts": [T0 + dt.timedelta(seconds=int(s)) for s in seconds],
        "id": rng.permutation(n),
        "side": rng.choice(["buy", "sell"], n),
        "price": rng.integers(90, 110, n) / 4,
        "amount": rng.integers(1, 9, n).astype(float),
    })
    pdf["bid_price"], pdf["ask_price"] = pdf["price"], pdf["price"] + rng.integers(1, 3, n) / 4
    pdf["bid_amount"], pdf["ask_amount"] = pdf["amount"], rng.integers(1, 9, n).astype(float)
    return frame(spark, pdf).cache()


@pytest.fixture(scope="module")
def bars(spark):
    rng = np.random.default_rng(6)
    rows = []
    for symbol, n in (("hot", 300), ("a", 40), ("b", 7)):
        close = (100 + rng.normal(size=n).cumsum().round(2)).tolist()
        for i in range(n):
            rows.append((symbol, T0 + dt.timedelta(hours=i), close[i] - 1, close[i] + 2, close[i] - 2, close[i],
                         float(rng.integers(1, 20)), None if rng.random() < 0.3 else float(i)))
    return spark.createDataFrame(rows, "symbol string, bucket timestamp, open double, high double, low double, "
                                       "close double, volume double, gap double").cache()


@pytest.fixture(scope="module")
def log(spark):
    rng = np.random.default_rng(7)
    rows = []
    for run, n in (("hot", 400), ("x", 25), ("y", 3)):
        for step in range(1, n + 1):
            rows.append((run, step, float(rng.integers(-2, 3)), int(rng.integers(3, 6)),
                         bool(rng.random() < 0.05), float(rng.integers(0, 9))))
    return spark.createDataFrame(
        rows, "run_id string, step long, reward double, action int, terminal boolean, value double").cache()


def test_hot_series_is_cut(ticks):
    cut = Ordered.on_events(ticks, ["symbol"], ["ts", "id"], 50)
    assert cut.split
    sizes = cut.df.groupBy("symbol", "_block").count().toPandas()
    assert len(sizes) > 8 and sizes["count"].max() <= 200
    # Blocks follow the order.
    ends = cut.df.groupBy("symbol", "_block").agg(
        F.min(F.struct("ts", "id")).alias("lo"), F.max(F.struct("ts", "id")).alias("hi")).orderBy("symbol", "_block").collect()
    for a, b in zip(ends, ends[1:], strict=False):
        assert a.symbol != b.symbol or a.hi < b.lo


def test_small_series_is_not_cut(ticks):
    assert not Ordered.on_events(ticks, ["symbol"], ["ts", "id"], BIG).split


@pytest.mark.parametrize("size", [20, 137])
def test_trade_bars(ticks, size):
    same(resample.trade_bars(ticks, 3600, True, size), resample.trade_bars(ticks, 3600, True, BIG))


def test_quote_bars(ticks):
    order = ["ts", "id"]
    same(resample.quote_bars(ticks, 3600, order, rows_per_block=40), resample.quote_bars(ticks, 3600, order, rows_per_block=BIG))


def test_row_ids_and_ties(ticks):
    same(dedup.row_ids(ticks, ["symbol"], ["ts", "id"], "n", 30), dedup.row_ids(ticks, ["symbol"], ["ts", "id"], "n", BIG))
    same(dedup.spread_ties(ticks, ["symbol"], "ts", ["id"], 30), dedup.spread_ties(ticks, ["symbol"], "ts", ["id"], BIG))


def test_every_fold(bars):
    folds = dict(
        s=running_sum(F.col("close")), b=running_sum(F.col("close"), backward=True), m=running_max(F.col("close")),
        p=running_product(F.lit(1.001)), f=last_set(F.col("gap")), fs=last_set(F.col("gap"), strict=True),
        n=next_set(F.col("gap")), ns=next_set(F.col("gap"), strict=True))

    def made(size):
        return Ordered.on_grid(bars, ["symbol"], "bucket", 3600, size).running(**folds).done()

    same(made(16), made(BIG), 6)


def test_folds_against_pandas(bars):
    got = Ordered.on_grid(bars, ["symbol"], "bucket", 3600, 16).running(
        s=running_sum(F.col("close")), m=running_max(F.col("close")), f=last_set(F.col("gap")),
        n=next_set(F.col("gap"))).done().toPandas().sort_values(["symbol", "bucket"])
    g = got.groupby("symbol")
    assert np.allclose(got["s"], g["close"].cumsum())
    assert np.allclose(got["m"], g["close"].cummax())
    assert np.allclose(got["f"], g["gap"].ffill(), equal_nan=True)
    assert np.allclose(got["n"], g["gap"].bfill(), equal_nan=True)


def test_grid_and_fills(bars):
    sparse = bars.where(F.col("volume") > 8).select("symbol", "bucket", "close", "volume", "gap")
    same(resample.densify(sparse, 3600, rows_per_block=10), resample.densify(sparse, 3600))
    for size in (10, BIG):
        whole = resample.complete_bars(sparse, 3600, ["volume"], rows_per_block=size)
        dense = resample.densify(sparse, 3600).fillna(0, ["volume"])
        same(whole, resample.fill_forward(dense, 3600, ["close", "gap"]))
    same(resample.fill_both(bars, 3600, ["gap"], rows_per_block=9), resample.fill_both(bars, 3600, ["gap"]))


def test_rolling(bars):
    names = {"": {c: c for c in ("open", "high", "low", "close", "volume")}}
    same(rolling.rolling_groups(bars, 3600, names, (2, 5), rows_per_block=8),
         rolling.rolling_groups(bars, 3600, names, (2, 5)), 4)
    same(rolling.price_features(bars, 3600, ["close"], (3,), rows_per_block=8), rolling.price_features(bars, 3600, ["close"], (3,)), 6)


def test_exponential_means(bars):
    got = rolling.exponential_means(bars, "close", {"e": 5}, 3600).toPandas().sort_values(["symbol", "bucket"])
    want = got.groupby("symbol")["close"].transform(lambda x: x.ewm(span=5).mean())
    assert np.allclose(got["e"], want, rtol=1e-13)


def test_reach_beyond_block_is_refused(bars):
    with pytest.raises(ValueError, match="exceeds block size"):
        rolling.price_features(bars, 3600, ["close"], (48,), rows_per_block=8)


@pytest.mark.parametrize("size", [1, 7, 64])
def test_closed_trades(log, size):
    got = runs.closed_trades(log, rows_per_block=size).toPandas().sort_values(["run_id", "step", "is_open"])
    want = []
    for run, part in log.toPandas().sort_values("step").groupby("run_id"):
        total, last = 0.0, 0
        for row in part.itertuples():
            closes = row.action == 4 and total != 0
            total, last = total + row.reward, row.step
            if closes:
                want.append((run, row.step, total, False))
                total = 0.0
        want.append((run, last, total, True))
    assert [tuple(r) for r in got.itertuples(index=False)] == sorted(want, key=lambda r: (r[0], r[1], r[3]))


def test_discounted(log):
    same(runs.reward_to_go(log, 0.97, rows_per_block=13), runs.reward_to_go(log, 0.97))
    same(runs.advantages(log, 0.97, 0.9, rows_per_block=13), runs.advantages(log, 0.97, 0.9))
    same(runs.n_step_returns(log, 4, 0.9, rows_per_block=13), runs.n_step_returns(log, 4, 0.9))
    got = runs.reward_to_go(log, 0.97, rows_per_block=13).where("run_id = 'x'").orderBy("step").toPandas()
    y, want = 0.0, []
    for r in log.where("run_id = 'x'").orderBy(F.desc("step")).toPandas()["reward"]:
        y = r + 0.97 * y
        want.append(y)
    assert np.allclose(got["reward_to_go"], want[::-1])


def test_run_metrics(spark, log):
    money = spark.createDataFrame([("hot", 500.0), ("x", 90.0), ("y", 60.0)], "run_id string, required double")
    same(runs.run_metrics(log, money, 8, rows_per_block=10), runs.run_metrics(log, money, 8))
    same(runs.turnover(log, rows_per_block=10), runs.turnover(log))


@pytest.mark.parametrize("length", [1, 4, 11])
def test_segments(spark, length):
    rng = np.random.default_rng(8)
    flags = {"hot": rng.random(500) < 0.3, "few": rng.random(60) < 0.02, "none": np.zeros(20, bool)}
    rows = [(k, i, bool(v)) for k, f in flags.items() for i, v in enumerate(f)]
    df = spark.createDataFrame(rows, "symbol string, pos long, turn boolean")
    want = {}
    for k, f in flags.items():
        last = 0
        for i, v in enumerate(f):
            if v and i - last >= length:
                last = i
            want[k, i] = last
    for size in (12, BIG):
        got = regimes.segments(Ordered.on_steps(df, ["symbol"], "pos", size), length).collect()
        assert {(r.symbol, r.pos): r.segment_start for r in got} == want


def test_segment_moves_and_runs(bars):
    starts = bars.groupBy("symbol").agg(F.min("bucket").alias("s"))
    rows = bars.join(starts, "symbol").select(
        "symbol", "bucket", "close", ((F.unix_seconds("bucket") - F.unix_seconds("s")) / 3600).cast("long").alias("pos"))
    rows = rows.withColumn("segment_start", (F.floor(F.col("pos") / 90) * 90).cast("long"))
    same(regimes.segment_moves(rows, ["symbol"], "pos", "close", 7), regimes.segment_moves(rows, ["symbol"], "pos", "close"))
    labelled = rows.withColumn("label", F.when(F.col("close") > 100, 1).otherwise(0)).select("symbol", "bucket", "label")

    def made(size):
        return sampling.label_runs(Ordered.on_grid(labelled, ["symbol"], "bucket", 3600, size), "label")

    same(made(6), made(BIG))
    idx = rows.where("close > 100").select("symbol", "pos")
    same(sampling.index_runs(idx, ["symbol"], "pos", 9), sampling.index_runs(idx, ["symbol"], "pos", BIG))


def test_quantiles_and_ranks(spark):
    rng = np.random.default_rng(9)
    x = rng.integers(0, 40, 600).astype(float)
    x[:200] = 7.0  # a third of all rows is one value
    pdf = pd.DataFrame({"k": rng.choice(["p", "q"], 600), "x": x, "target_1": rng.integers(0, 9, 600).astype(float)})
    df = frame(spark, pdf)
    for size in (5, BIG):
        got = exact_quantiles(df, ["k"], "x", (0.05, 0.5, 0.9), size).toPandas().set_index("k")
        for k, part in pdf.groupby("k"):
            assert np.allclose(got.loc[k], np.quantile(part["x"], [0.05, 0.5, 0.9]))
        rank = selection.rank_coefficients(df, ["x"], (1,), size).first()["ic"]
        assert np.isclose(rank, pdf["x"].rank().corr(pdf["target_1"].rank()))


def test_score_metrics(spark):
    rng = np.random.default_rng(10)
    pdf = pd.DataFrame({"model": 0, "score": rng.integers(0, 50, 400) / 50, "y_true": rng.integers(0, 2, 400)})
    df = frame(spark, pdf)
    pos, neg = pdf[pdf.y_true == 1].score.to_numpy(), pdf[pdf.y_true == 0].score.to_numpy()
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    for size in (6, BIG):
        assert np.isclose(signals.ranking_metrics(df, ["model"], size).first()["roc_auc"], auc)
        found = signals.score_positions(df, df.where("y_true = 1"), ["model"], size).toPandas()
        want = [np.searchsorted(np.sort(pos), v, side="right") / len(pos) for v in found["score"]]
        assert np.allclose(found["quantile"], want)


def test_ledger(spark, bars):
    path = bars.select("symbol", "bucket", F.col("close").alias("mark_price"), (F.hour("bucket") % 5 - 2.0).alias("position"),
                       F.lit(0.0001).alias("funding_rate"), F.timestamp_seconds(
                           (F.floor(F.unix_seconds("bucket") / 28800) + 1) * 28800).alias("funding_timestamp"))
    same(execution.ledger(path, 3600, 0.001, rows_per_block=10), execution.ledger(path, 3600, 0.001), 6)


@pytest.mark.parametrize("size", [16, 10_000])
def test_long_windows_from_a_tree(spark, monkeypatch, size):
    names = {c: c for c in ("open", "high", "low", "close", "volume")}
    rows = spark.range(400).select(
        F.lit("x").alias("symbol"), F.timestamp_seconds(F.col("id") * 3600).alias("bucket"),
        *[F.when(F.rand(i) > 0.02, F.floor(F.rand(i + 9) * 12) + 5).cast("double").alias(c) for i, c in enumerate(names)])
    rows = settle(rows, "bars")
    by_list = rolling.rolling_groups(rows, 3600, {"": names}, (5, 13), rows_per_block=size).toPandas()
    monkeypatch.setattr(rolling, "LONG", 4)
    by_tree = rolling.rolling_groups(rows, 3600, {"": names}, (5, 13), rows_per_block=size).toPandas()
    a, b = (x.sort_values("bucket", ignore_index=True) for x in (by_list, by_tree))
    assert list(a.columns) == list(b.columns) and np.allclose(a.drop(columns=["symbol", "bucket"]), b.drop(columns=["symbol", "bucket"]), rtol=1e-12)


def test_window_of_ten_thousand_rows():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 5000, 100_000).astype(float)
    start = time.time()
    got = window_stats(x, x, x, (10_000,))
    assert time.time() - start < 5
    for i in (9_999, 10_000, 54_321, 99_999):
        part = x[i - 9_999:i + 1]
        assert got["less_10000"][i] == (part < x[i]).sum() and got["equal_10000"][i] == (part == x[i]).sum()
        assert np.allclose([got["qu_10000"][i], got["qd_10000"][i]], np.quantile(part, [0.8, 0.2]))
        assert got["fh_10000"][i] == part.argmax() and got["fl_10000"][i] == part.argmin()
    assert np.isnan(got["less_10000"][9_998])
