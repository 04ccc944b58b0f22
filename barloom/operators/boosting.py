"""Boosted trees of absolute loss for every key and horizon at once, as aggregates over bins (FS7, FS12)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.quantiles import exact_quantiles
from barloom.session import settle

# Bins of a feature; their borders are its quantiles.
BINS = 16
# Least gain of a split, in squared signs per row.
LEAST_GAIN = 1e-9


@dataclass(frozen=True)
class Boosted:
    """Fitted trees: ``rows`` (key columns, horizon, y, prediction) and ``importance`` (keys, horizon, feature, importance)."""

    rows: DataFrame
    importance: DataFrame
    keys: list[str]

    def errors(self) -> DataFrame:
        """(keys, horizon, error, base_error): mean absolute error of the prediction and of the median alone."""
        return self.rows.groupBy(*self.keys, "horizon").agg(
            F.avg(F.abs(F.col("y") - F.col("prediction"))).alias("error"), F.avg(F.abs(F.col("y") - F.col("_start"))).alias("base_error"))


def _binned(df: DataFrame, features: Sequence[str], keys: Sequence[str], bins: int) -> DataFrame:
    """``df`` with ``_b``, the bin of each feature: how many of its borders lie below the value. Unset values count 0."""
    values = F.array(*[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)) for f in features])
    rows = df.withColumn("_x", values)
    long = rows.select(*keys, F.posexplode("_x").alias("_pos", "_v"))
    found = exact_quantiles(long, [*keys, "_pos"], "_v", [i / bins for i in range(1, bins)])
    borders = found.select(*keys, F.struct("_pos", F.array(*[f"q{i}" for i in range(bins - 1)]).alias("q")).alias("_q"))
    borders = settle(borders.groupBy(*keys).agg(F.array_sort(F.collect_list("_q"))["q"].alias("_q")), "borders")
    rows = rows.join(borders, list(keys)) if keys else rows.join(F.broadcast(borders))
    bin_of = F.transform("_x", lambda x, i: F.size(F.filter(F.get("_q", i), lambda q: q < x)).cast("byte"))
    return rows.withColumn("_b", bin_of).drop("_x", "_q")


def _splits(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, _pos, _cut, _gain): the best split of each node, from sums over (node, feature, bin). Rows of bins up to
    ``_cut`` go left. Sums of signs are integers, so equal data split alike; ties go to the first feature and bin."""
    sums = rows.select(*by, F.signum(F.col("y") - F.col("prediction")).cast("long").alias("_g"), F.posexplode("_b").alias("_pos", "_cut"))
    sums = sums.groupBy(*by, "_pos", "_cut").agg(F.sum("_g").alias("_g"), F.count(F.lit(1)).alias("_n"))
    of_feature = Window.partitionBy(*by, "_pos")
    upto = of_feature.orderBy("_cut").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(*by, "_pos", "_cut", F.sum("_g").over(upto).alias("gl"), F.sum("_n").over(upto).alias("nl"),
                       F.sum("_g").over(of_feature).alias("g"), F.sum("_n").over(of_feature).alias("n")).where("nl < n")
    gain = F.expr("double(gl) * gl / nl + double(g - gl) * (g - gl) / (n - nl) - double(g) * g / n")
    best = F.max(F.struct(gain.alias("gain"), (-F.col("_pos")).alias("p"), (-F.col("_cut")).alias("c")))
    return sums.groupBy(*by).agg(best.alias("_s")).where(F.col("_s.gain") > LEAST_GAIN).select(
        *by, (-F.col("_s.p")).alias("_pos"), (-F.col("_s.c")).alias("_cut"), F.col("_s.gain").alias("_gain"))


def boosted(df: DataFrame, features: Sequence[str], targets: dict[int, str], keys: Sequence[str] = (), ids: Sequence[str] = (),
            trees: int = 20, depth: int = 6, rate: float = 0.1, bins: int = BINS) -> Boosted:
    """Boosted trees of ``targets`` (horizon to column) by ``features``, of every key and horizon by itself.

    A level of all trees is one aggregate of signs of residuals by (key, horizon, node, feature, bin), combined before it
    is shuffled; the best splits are a small table that is joined back, so a level takes one job whatever the number of
    keys and horizons. A leaf's value is the median of its residuals, shrunk by ``rate``. The rows are written after each
    tree. ``ids`` are carried to the predictions. Rows with a null key or target are left out. Importance is a feature's share of all gains, in percent.
    """
    features, keys, ids = list(features), list(keys), [c for c in ids if c not in keys]
    aims = F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"`{c}`").cast("double").alias("y")) for h, c in targets.items()]))
    rows = _binned(df, features, keys, bins).select(*keys, *ids, "_b", aims).where("y IS NOT NULL")
    series = [*keys, "horizon"]
    rows = settle(rows, "binned")
    start = settle(exact_quantiles(rows, series, "y", (0.5,)).withColumnRenamed("q0", "_start"), "start")
    rows = rows.join(start, series).withColumn("prediction", F.col("_start"))
    gains = []
    for _ in range(trees):
        rows = rows.withColumn("_node", F.lit(1))
        for _ in range(depth):
            split = settle(_splits(rows, [*series, "_node"]), "splits")
            gains.append(split.select(*series, "_pos", "_gain"))
            child = 2 * F.col("_node") + (F.get("_b", F.col("_pos")) > F.col("_cut")).cast("int")
            rows = rows.join(split, [*series, "_node"], "left").withColumn("_node", F.coalesce(child, "_node")).drop("_pos", "_cut", "_gain")
        rows = settle(rows, "tree")
        leaves = exact_quantiles(rows.withColumn("_r", F.col("y") - F.col("prediction")), [*series, "_node"], "_r", (0.5,))
        step = F.col("prediction") + F.lit(rate) * F.col("q0")
        rows = rows.join(settle(leaves, "leaves"), [*series, "_node"]).withColumn("prediction", step).drop("q0", "_node")
        rows = settle(rows, "boosted")
    total = gains[0]
    for more in gains[1:]:
        total = total.unionByName(more)
    total = total.groupBy(*series, "_pos").agg(F.sum("_gain").alias("_gain"))
    every = start.select(*series, F.posexplode(F.array(*[F.lit(f) for f in features])).alias("_pos", "feature"))
    share = 100 * F.col("_gain") / F.sum("_gain").over(Window.partitionBy(*series))
    importance = every.join(total, [*series, "_pos"], "left").select(*series, "feature", F.coalesce(share, F.lit(0.0)).alias("importance"))
    return Boosted(rows.drop("_b"), importance, keys)
