"""The way from raw ticks to the feature table."""

import math
import re
import time
from dataclasses import replace

from pyspark.sql import functions as F

from barloom.catalog import fixtures
from barloom.operators import joins, resample, rolling, runs, sampling
from barloom.operators.ordering import Ordered, next_set, running_sum
from barloom.plans.features import FeatureOptions, concurrent_side, feature_table
from tests.conftest import SF

OPTIONS = FeatureOptions(
    seconds=3600, windows=(3,), horizons=(1,), ic_threshold=0.02, method="rank_ic",
    quote_order=("ts", "event_id"), ticker_order=("ts", "event_id"))


def test_concurrent_side_holds_book_features(spark):
    book = fixtures.book(spark, SF).withColumn("symbol", F.lit("click")).drop("book_id")
    ticker = fixtures.ticker(spark, SF).where("symbol = 'click'")
    side = concurrent_side(ticker, book, OPTIONS)
    assert {"mark_price", "ask_price", "midprice", "bid25_size_n"} <= set(side.columns)
    both = side.where("mark_price is not null and midprice is not null")
    assert both.count() > 0
    assert both.agg(F.max(F.abs(F.col("midprice") - 100))).first()[0] < 1e-9


def test_feature_table(spark):
    made = feature_table(fixtures.trades(spark, SF), fixtures.quotes(spark, SF), fixtures.ticker(spark, SF), options=OPTIONS)
    assert made.features and not set(made.features) & set(made.environment)
    assert set(made.rows.columns) == {*made.environment, *made.features}
    scores = {r.feature: r.ic for r in made.scores.collect()}
    best = max(scores, key=lambda f: abs(scores[f] or 0))
    assert made.features[0] == best
    assert all(abs(scores[f]) > OPTIONS.ic_threshold for f in made.features)
    stats = made.rows.agg(*[F.stddev_samp(f"`{f}`") for f in made.features]).first()
    assert all(s is None or s == 0 or 1 - 1e-9 <= s < 10 for s in stats if s is None or not math.isnan(s))


def test_feature_table_by_trees(spark):
    options = replace(OPTIONS, method="tree", trees=2, depth=2, ic_threshold=5.0)
    made = feature_table(fixtures.trades(spark, SF), fixtures.quotes(spark, SF), fixtures.ticker(spark, SF), options=options)
    scores = {r.feature: r.ic for r in made.scores.collect()}
    assert made.features and all(scores[f] > 5 for f in made.features) and abs(sum(scores.values()) - 100) < 1e-6
    assert made.features[0] == max(scores, key=scores.get)


def test_rows_are_not_dealt_by_the_series_key(spark):
    """A key may hold a third of all rows: per-key tables come to the rows, not the other way round."""
    bars = fixtures.settle(fixtures.hourly_bars(spark, SF).select("symbol", "bucket", "close"), "bars")
    steps = fixtures.settle(fixtures.runs(spark, SF), "runs")
    for made in (rolling.trim_start(bars, 3, 3600), joins.right_aligned(steps, "reward"),
                 sampling.overlapping_chunks(steps, 50, 10, ["run_id"], "step")):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"hashpartitioning\((symbol|run_id)#\d+, \d+\)", plan), plan


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_backward_folds_grow_from_the_end(spark):
    bars = fixtures.settle(fixtures.hourly_bars(spark, SF).select("symbol", "bucket", "close"), "bars")
    log = fixtures.settle(fixtures.runs(spark, SF).withColumns({"value": F.col("reward"), "terminal": F.lit(False)}), "runs")
    series = Ordered.on_steps(log, ["run_id"], "step", 100)
    for made in (resample.fill_both(bars, 3600, ["close"]), resample.complete_bars(bars, 3600), runs.reward_to_go(log, 0.99),
                 runs.advantages(log, 0.99, 0.9), series.running(x=running_sum(F.col("reward"), backward=True)).done(),
                 series.running(x=next_set(F.col("reward"), strict=True)).done(), runs.closed_trades(log)):
        assert "unboundedfollowing" not in _plan(made).lower().replace(" ", "").replace("specifiedwindowframe(rowframe,unboundedpreceding$(),unboundedfollowing$())", "")


def test_chains_of_folds_read_their_table_twice(spark):
    log = fixtures.settle(fixtures.runs(spark, SF), "runs")
    for made in (runs.closed_trades(log), Ordered.on_steps(log, ["run_id"], "step", 100).running(a=running_sum(F.col("reward"))).running(
            b=running_sum(F.col("a"))).running(c=running_sum(F.col("b"))).done()):
        assert _plan(made).count("Relation [") <= 2, _plan(made)


def test_a_full_block_folded_backwards(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("run_id"), F.col("id").alias("step"), F.when(F.col("id") % 1000 == 999, F.col("id")).alias("x"))
    series = Ordered.on_steps(fixtures.settle(rows, "rows"), ["run_id"], "step")
    series.running(y=next_set(F.col("x"))).done().agg(F.sum("y")).first()  # the first run compiles
    start = time.time()
    got = series.running(y=next_set(F.col("x")), n=running_sum(F.lit(1), backward=True)).done().agg(F.sum("y"), F.sum("n")).first()
    assert tuple(got) == (sum(1000 * (1000 * k + 999) for k in range(100)), 100_000 * 100_001 // 2)
    assert time.time() - start < 3
