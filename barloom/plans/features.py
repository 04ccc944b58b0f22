"""The whole way from raw ticks to the scaled feature table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from barloom.operators import candles, joins, resample, rolling, selection
from barloom.operators.book import snapshot_features
from barloom.operators.ordering import BLOCK, GRID_ROWS_PER_BLOCK, ROWS_PER_BLOCK, Ordered
from barloom.session import configure, settle

KEY = ("symbol", "bucket")


@dataclass(frozen=True)
class FeatureOptions:
    """What a feature table is made of; defaults are the usual settings."""

    seconds: int = 3600
    windows: Sequence[int] = rolling.WINDOWS
    horizons: Sequence[int] = selection.HORIZONS
    ic_threshold: float = 0.01
    correlation_threshold: float = 0.7
    method: str = "ic"  # or "rank_ic", or "tree": importance of boosted trees, in percent
    price: str = "mark_price"
    quote_order: Sequence[str] = ("ts",)
    ticker_order: Sequence[str] = ("ts",)
    rolling_columns: Sequence[str] = field(default_factory=lambda: ("mark_price",))
    trees: int = 20
    depth: int = 6
    rows_per_block: int = ROWS_PER_BLOCK
    grid_rows: int = GRID_ROWS_PER_BLOCK


@dataclass(frozen=True)
class FeatureTable:
    """Environment and scaled feature columns, by name, and the scores behind them."""

    rows: DataFrame
    environment: list[str]
    features: list[str]
    scores: DataFrame


def concurrent_side(ticker: DataFrame, book: DataFrame | None, options: FeatureOptions) -> DataFrame:
    """Ticker (and book) downscaled to the grid, with the book's features."""
    columns = [c for c in ("funding_timestamp", "funding_rate", "index_price", "mark_price") if c in ticker.columns]
    marks = resample.downscale(ticker, options.seconds, columns, order=options.ticker_order)
    if book is None:
        return marks
    arrays = ["ask_price", "ask_size", "bid_price", "bid_size"]
    snapshots = resample.downscale(book, options.seconds, arrays)
    return joins.side_by_side([marks, snapshots, snapshot_features(snapshots, KEY)])


def lagged_side(trades: DataFrame, quotes: DataFrame, options: FeatureOptions) -> DataFrame:
    """Bars with their candle shapes and shares: known only at the end of the bar."""
    bars = settle(resample.base_features(
        trades, quotes, options.seconds, options.quote_order, options.rows_per_block, options.grid_rows), "base")
    return candles.cross_section(bars, KEY)


def feature_table(trades: DataFrame, quotes: DataFrame, ticker: DataFrame, book: DataFrame | None = None,
                  options: FeatureOptions | None = None) -> FeatureTable:
    """Bars, cross-section features, point-in-time join, rolling features, selection, scaling.

    Tables that later steps branch on are written to the scratch folder: the
    bars, the joined table, the rolling features and the full table.
    """
    options = options or FeatureOptions()
    configure(trades.sparkSession)
    seconds = options.seconds
    now = settle(concurrent_side(ticker, book, options), "now")
    later = lagged_side(trades, quotes, options)
    predictors = [c for c in later.columns if c not in KEY]
    # The bars are complete already; only the concurrent side has gaps to carry.
    gaps = [c for c in now.columns if c not in KEY]
    joined = settle(joins.point_in_time(
        now, later, seconds, predictors, carry=gaps, rows_per_block=options.grid_rows), "joined")
    # Targets look ahead only, so they may be made before the warm-up rows go.
    prices = Ordered.on_grid(joined.select(*KEY, options.price), KEY[:1], KEY[1], seconds, options.grid_rows)
    targets = selection.forward_targets(prices, options.price, options.horizons).drop(options.price, BLOCK)
    parts = [
        joined,
        rolling.rolling_features(joined, seconds, options.windows, rows_per_block=options.grid_rows),
        rolling.price_features(joined, seconds, options.rolling_columns, options.windows,
                               rows_per_block=options.grid_rows),
        targets,
    ]
    full = joins.side_by_side(parts, how="inner")
    environment = [*KEY, *[c for c in now.columns if c not in KEY]]
    aims = [c for c in targets.columns if c not in KEY]
    numeric = {f.name for f in full.schema.fields if f.dataType.simpleString() in ("double", "bigint", "int")}
    candidates = [c for c in full.columns if c not in {*environment, *aims} and c in numeric]
    casts = [f"CAST(`{c}` AS DOUBLE) AS `{c}`" for c in candidates]
    full = settle(full.selectExpr(*environment, *aims, *casts), "full")
    if options.method == "tree":
        found = selection.tree_importance(full, candidates, options.horizons, trees=options.trees, depth=options.depth)
        found = found.withColumnRenamed("importance", "ic")
    else:
        score = selection.rank_coefficients if options.method == "rank_ic" else selection.information_coefficients
        found = score(full, candidates, options.horizons)
    scores = settle(found, "scores")
    chosen = selection.select_features(full, scores, options.ic_threshold, options.correlation_threshold)
    names = [row["feature"] for row in chosen.orderBy("rank").collect() if row["feature"]]
    table = full.select(*environment, *names)
    rows = selection.power_of_ten_scale(table, names) if names else table
    return FeatureTable(rows, environment, names, scores)
