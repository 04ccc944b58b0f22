"""Signals, routing and score metrics (SG2-SG11); MACD itself is in ``rolling``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators import rolling
from barloom.operators.joins import parameter_grid
from barloom.operators.ordering import (
    GRID_ROWS_PER_BLOCK,
    ROWS_PER_BLOCK,
    Ordered,
    last_set,
    running_product,
    running_sum,
)
from barloom.operators.quantiles import exact_quantiles
from barloom.session import join_per_key, settle


def macd_decision(dif: Column, macd: Column) -> Column:
    """SG2: buy when both are positive, sell when both are negative."""
    return F.when((macd > 0) & (dif > 0), "buy").when(macd * dif <= 0, "hold").otherwise("sell")


def imbalance_decision(value: Column, upper: Column, lower: Column, strict: bool = False) -> Column:
    """SG3: buy above the upper bound, sell below the lower one; bounds count unless ``strict``."""
    buy, sell = (value > upper, value < lower) if strict else (value >= upper, value <= lower)
    return F.when(buy, "buy").when(sell, "sell").otherwise("hold")


def hold_position(series: Ordered, decision: str, out: str, start: str = "flat") -> Ordered:
    """SG4: a hold keeps the last decision that was not a hold."""
    acted = F.when(F.col(decision) != "hold", F.col(decision))
    held = series.running(**{out: last_set(acted)})
    return held.on(held.df.withColumn(out, F.coalesce(out, F.lit(start))))


def sweep_profit(bars: DataFrame, seconds: int, grid: Sequence[Mapping[str, float]],
                 rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """JN10 with SG3 and SG4: profit of the held side for each pair of thresholds."""
    keys = ["symbol", "upper", "lower"]
    tilt = F.coalesce(ratio((F.col("ntrade_up") - F.col("ntrade_down")).cast("double"), F.col("ntrade").cast("double")), F.lit(0.0))
    base = Ordered.on_grid(bars.select("symbol", "bucket", "close", tilt.alias("tilt")), ["symbol"], "bucket", seconds, rows_per_block)
    gains = base.with_frames(lambda w: {"gain": F.lead("close").over(w) - F.col("close")}, ahead=1).done()
    rows = parameter_grid(gains, grid)
    rows = rows.withColumn("decision", imbalance_decision(F.col("tilt"), F.col("upper"), F.col("lower")))
    held = hold_position(Ordered.on_grid(rows, keys, "bucket", seconds, rows_per_block), "decision", "held").done()
    side = F.when(F.col("held") == "buy", 1).when(F.col("held") == "sell", -1).otherwise(0)
    return held.groupBy(*keys).agg(
        F.sum(side * F.coalesce("gain", F.lit(0.0))).alias("profit"), F.count_if(side != 0).alias("held_rows"))


def span_sweep(bars: DataFrame, seconds: int, sets: Sequence[tuple[int, int, int]], rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """JN10 with SG1, SG2 and SG4: (symbol, short, mid, long, profit, held_rows): profit of the held side for each set of spans.

    The sets are columns until they are summed: means, decisions, held sides and sums of all of them take the same passes.
    """
    named = {f"_{i}": s for i, s in enumerate(sets)}
    rows = settle(rolling.macd_sets(bars, "close", seconds, named), "spans")
    series = Ordered.on_grid(rows, ["symbol"], "bucket", seconds, rows_per_block)
    series = series.with_frames(lambda w: {"gain": F.lead("close").over(w) - F.col("close")}, ahead=1)
    decided = {c: macd_decision(F.col(f"dif{c}"), F.col(f"macd{c}")) for c in named}
    held = series.running(**{f"held{c}": last_set(F.when(d != "hold", F.when(d == "buy", 1).otherwise(-1))) for c, d in decided.items()}).done()
    gain = F.coalesce("gain", F.lit(0.0))
    sums = held.groupBy("symbol").agg(*[x for c in named for x in (
        F.sum(F.coalesce(f"held{c}", F.lit(0)) * gain).alias(f"profit{c}"), F.count(f"held{c}").alias(f"held_rows{c}"))])
    out = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("short", "mid", "long"), s, strict=True)],
                             F.col(f"profit{c}").alias("profit"), F.col(f"held_rows{c}").alias("held_rows")) for c, s in named.items()])
    return sums.select("symbol", F.inline(out))


def expert_weights(votes: Ordered, flat: int, right: float, wrong: float) -> DataFrame:
    """SG5: running product of ``right`` or ``wrong`` per expert.

    ``votes`` is keyed by expert and carries ``move`` (the price change a row
    tells about) and ``action``; flat actions and flat prices change nothing.
    """
    agrees = F.signum("move") * F.signum(F.col("action") - flat)
    factor = F.when(agrees > 0, right).when(agrees < 0, wrong).otherwise(1.0)
    return votes.running(weight=running_product(factor)).done()


def score_positions(scores: DataFrame, reference: DataFrame, keys: Sequence[str],
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """SG6: share of the reference sample not above each distinct score.

    Both sides are first reduced to distinct scores with counts; one ordered
    pass over their union then replaces a search per row.
    """
    values = (
        scores.select(*keys, "score", F.lit(0).alias("_ref"))
        .unionByName(reference.select(*keys, "score", F.lit(1).alias("_ref")))
        .groupBy(*keys, "score").agg(F.sum("_ref").alias("n"))
    )
    values = settle(values, "scores")
    ranked = Ordered.on_events(values, keys, ["score"], rows_per_block).running(_upto=running_sum(F.col("n"))).done()
    sizes = values.groupBy(*keys).agg(F.sum("n").alias("_size"))
    return join_per_key(ranked, sizes, keys).select(
        *keys, "score", ratio(F.col("_upto").cast("double"), F.col("_size").cast("double")).alias("quantile"))


def route(weights: DataFrame, step: str, model: str, weight: str, threshold: float, fallback: int) -> DataFrame:
    """SG7: model of the largest weight per step, the fallback when that is below the threshold.

    The lowest model wins a tie. One map-side combined aggregate; null weights
    (windows not yet full) do not take part.
    """
    best = F.max(F.when(F.col(weight).isNotNull(), F.struct(F.col(weight).alias("w"), (-F.col(model)).alias("m"))))
    picked = weights.groupBy(step).agg(best.alias("_b")).where("_b is not null")
    return picked.select(
        step, F.col("_b.w").alias("best_weight"),
        F.when(F.col("_b.w") < threshold, F.lit(fallback)).otherwise(-F.col("_b.m")).alias("chosen"))


def reject_rates(scores: DataFrame, reference: DataFrame, keys: Sequence[str], percent: float) -> DataFrame:
    """SG8: share of scores below a percentile of the reference sample."""
    bounds = exact_quantiles(reference, keys, "score", (percent / 100,)).withColumnRenamed("q0", "threshold")
    return join_per_key(scores, bounds, keys).groupBy(*keys, "threshold").agg(
        F.avg((F.col("score") < F.col("threshold")).cast("double")).alias("reject_rate"))


def ranking_metrics(scores: DataFrame, keys: Sequence[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """SG9: ROC AUC, average precision and false-positive rate at 80 % recall.

    Works on distinct scores with their positive and negative counts, so tied
    scores are one step of the curve.
    """
    steps = scores.groupBy(*keys, "score").agg(
        F.sum("y_true").cast("double").alias("pos"), F.sum(1 - F.col("y_true")).cast("double").alias("neg"))
    steps = settle(steps.withColumn("_down", -F.col("score")), "steps")
    ranked = Ordered.on_events(steps, keys, ["_down"], rows_per_block).running(
        tp=running_sum(F.col("pos")), fp=running_sum(F.col("neg"))).done()
    sizes = steps.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = join_per_key(ranked, sizes, keys)
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    precision = F.col("tp") / (F.col("tp") + F.col("fp"))
    return rows.groupBy(*keys, "p", "n").agg(
        F.sum(area).alias("_a"), F.sum(F.col("pos") * precision).alias("_ap"),
        F.min(F.when(F.col("tp") / F.col("p") >= 0.8, F.col("fp"))).alias("_fp"),
    ).select(
        *keys, ratio(F.col("_a"), F.col("p") * F.col("n")).alias("roc_auc"),
        ratio(F.col("_ap"), F.col("p")).alias("average_precision"), ratio(F.col("_fp"), F.col("n")).alias("fpr80"))


def chunk_shares(df: DataFrame, keys: Sequence[str], position: str, value: str, chunks: int,
                 classes: Sequence[int]) -> DataFrame:
    """SG10: percent of each class in each of ``chunks`` equal parts; the last takes the rest.

    ``position`` is 0-based. Classes that do not occur in a chunk get 0. A run
    of fewer rows than chunks is all rest: it has the last chunk only.
    """
    sizes = df.groupBy(*keys).agg((F.max(position) + 1).alias("_n"))
    length = F.floor(F.col("_n") / chunks)
    chunk = F.when(length > 0, F.least(F.floor(F.col(position) / F.greatest(length, F.lit(1))), F.lit(chunks - 1))).otherwise(chunks - 1)
    counted = join_per_key(df, sizes, keys).groupBy(*keys, chunk.alias("chunk")).agg(
        F.count(F.lit(1)).alias("_all"), *[F.count_if(F.col(value) == c).alias(f"_c{c}") for c in classes])
    shares = F.inline(F.array(*[
        F.struct(F.lit(c).alias("class"), (100.0 * F.col(f"_c{c}") / F.col("_all")).alias("percent")) for c in classes
    ]))
    return counted.select(*keys, "chunk", shares)


def markers(series: Ordered, position: str) -> DataFrame:
    """SG11: rows before a rise (buy) or a fall (sell) of the position."""
    made = series.with_frames(lambda w: {"_d": F.lead(position).over(w) - F.col(position)}, ahead=1).done()
    side = F.when(F.col("_d") > 0, "buy").when(F.col("_d") < 0, "sell")
    return made.withColumn("marker", side).where("marker is not null").drop("_d")


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key; the rank limit also runs before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
