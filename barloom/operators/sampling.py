"""Splits, chunks, runs of equal labels and samples (SL1-SL10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.ordering import GRID_ROWS_PER_BLOCK, Ordered, running_sum
from barloom.operators.quantiles import quantile_values
from barloom.session import join_per_key, settle


def chronological_split(df: DataFrame, shares: Sequence[tuple[str, int]], keys: Sequence[str], position: str) -> DataFrame:
    """SL1, SL3: consecutive parts of floor(n / k) rows each; what is left over is dropped.

    ``position`` is the 1-based row number of each series; ``shares`` lists
    (name, k) in time order.
    """
    sizes = df.groupBy(*keys).agg(F.max(position).alias("_n")) if keys else df.agg(F.max(position).alias("_n"))
    # Without keys the size is a single row, read once and used as a value.
    joined = join_per_key(df, sizes, keys) if keys else df.withColumn("_n", F.lit(sizes.first()[0]))
    end, label = F.lit(0), F.lit(None).cast("string")
    bounds = []
    for name, k in shares:
        start, end = end, end + F.floor(F.col("_n") / k)
        bounds.append((name, start, end))
    for name, start, stop in reversed(bounds):
        label = F.when((F.col(position) > start) & (F.col(position) <= stop), name).otherwise(label)
    return joined.withColumn("split", label).where("split is not null").drop("_n")


def overlapping_chunks(df: DataFrame, length: int, overlap: int, keys: Sequence[str], position: str) -> DataFrame:
    """SL2, SL3: full chunks of ``length + overlap`` rows starting every ``length`` rows.

    Each row lists the few chunks that hold it, which replaces a range join.
    """
    sizes = df.groupBy(*keys).agg(F.max(position).alias("_n"))
    reach = length + overlap
    p = F.col(position) - 1
    last = F.least(F.floor(p / length), F.floor((F.col("_n") - reach) / length))
    first = F.greatest(F.lit(0), F.ceil((p - reach + 1) / length))
    chunks = F.when(last >= first, F.sequence(first, last))
    return join_per_key(df, sizes, keys).withColumn("chunk_id", F.explode(chunks)).drop("_n")


def label_runs(series: Ordered, label: str) -> DataFrame:
    """SL4: runs of equal label, numbered per label from 0; ``is_last`` marks the open run."""
    step = series.order[0]
    before = series.with_frames(
        lambda w: {"_before": F.lag(label).over(w), "_next": F.lead(label).over(w)}, back=1, ahead=1)
    starts = ~F.col(label).eqNullSafe(F.col("_before")) | F.col("_before").isNull()
    numbered = before.on(before.df.withColumn("_starts", starts.cast("int"))).running(
        _run=running_sum(F.col("_starts"))).done()
    numbered = settle(numbered, "runs")
    runs = numbered.groupBy(*series.keys, "_run", label).agg(F.min(step).alias("_first"))
    # One row per run: ranked within its label by another ordered pass.
    ranked = Ordered.on_events(runs, [*series.keys, label], ["_run"]).running(
        run_id=running_sum(F.lit(1))).done()
    last = runs.groupBy(*series.keys).agg(F.max("_run").alias("_last")) if series.keys else None
    out = numbered.join(
        ranked.select(*series.keys, "_run", (F.col("run_id") - 1).alias("run_id")), [*series.keys, "_run"])
    if last is not None:
        out = join_per_key(out, last, series.keys).withColumn("is_last", F.col("_run") == F.col("_last")).drop("_last")
    return out.drop("_run", "_starts", "_before", "_next")


def index_runs(df: DataFrame, keys: Sequence[str], index: str,
               rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """SL5: (start, stop) of runs of consecutive index values within each key."""
    series = Ordered.on_events(df.select(*keys, index), keys, [index], rows_per_block)
    ranked = series.running(_n=running_sum(F.lit(1))).done()
    return (
        ranked.groupBy(*keys, (F.col(index) - F.col("_n")).alias("_gap"))
        .agg(F.min(index).alias("start"), F.max(index).alias("stop"), F.count(F.lit(1)).alias("n"))
        .drop("_gap")
    )


def feature_vectors(df: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """SL6: feature columns as one array per row, next to the columns to keep."""
    return df.select(*keep, F.array(*columns).alias("features"))


def supervised_pairs(series: Ordered, columns: Sequence[str], price: str) -> DataFrame:
    """SL7: features of a row with the price change to the next row."""
    made = series.with_frames(lambda w: {"y": F.lead(price).over(w) - F.col(price)}, ahead=1).done()
    return made.where("y is not null").select(*series.keys, *series.order, F.array(*columns).alias("x"), "y")


def hash_sample(df: DataFrame, identity: Sequence[str], n: int, seed: int = 0) -> DataFrame:
    """SL8: ``n`` rows without replacement, the same ones on every run.

    The draw order is a hash of the row's identity. Two counting passes over the hash's first digits find the least
    beginning that leaves enough rows; rows below it are taken by a filter, and only those that share it, a part in
    16**8 of the table, are put in order.
    """
    draw = F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in identity], F.lit(str(seed))))
    rows, below, edge = df.withColumn("_draw", draw), 0, ""
    for width in (4, 8):
        start = F.substring("_draw", 1, width)
        counts = rows.where(F.col("_draw").startswith(edge)).groupBy(start.alias("p")).agg(F.count(F.lit(1)).alias("c"))
        # At most 16**4 rows.
        upto = counts.withColumn("u", F.sum("c").over(Window.orderBy("p"))).where(F.col("u") >= n - below).agg(F.min(F.struct("p", "u", "c"))).first()[0]
        if upto is None:
            return df
        edge, below = upto["p"], below + upto["u"] - upto["c"]
    sure, rest = rows.where(start < edge), rows.where(start == edge).orderBy("_draw", *identity).limit(n - below)
    return sure.unionByName(rest).drop("_draw")


def clip(df: DataFrame, column: str, low: float, high: float, out: str) -> DataFrame:
    """SL9: values outside the given percentiles are moved to them."""
    bounds = quantile_values(df, column, (low, high))
    return df.withColumn(out, F.least(F.greatest(F.col(column), F.lit(bounds[0])), F.lit(bounds[1])))


def histogram(df: DataFrame, column: str, bins: int) -> tuple[DataFrame, Column]:
    """SL10: (bin, start, stop, n, density) of equal-width bins, and the bin column.

    The last bin includes its upper edge. A constant column takes bins of a
    whole unit around its value; a column without values has no bins.
    """
    lo, hi, n = df.agg(F.min(column), F.max(column), F.count(column)).first()
    if not n:
        empty = df.sparkSession.range(0).select(
            F.col("id").alias("bin"), *[F.lit(0.0).alias(c) for c in ("start", "stop")], F.lit(0).cast("long").alias("n"),
            F.lit(0.0).alias("density"))
        return empty, F.lit(None).cast("long")
    if lo == hi:
        lo, hi = lo - 0.5, hi + 0.5
    width = (hi - lo) / bins
    index = F.least(F.floor((F.col(column) - lo) / width), F.lit(bins - 1))
    counts = df.where(F.col(column).isNotNull()).groupBy(index.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    all_bins = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left")
    table = all_bins.select(
        "bin", (lo + F.col("bin") * width).alias("start"), (lo + (F.col("bin") + 1) * width).alias("stop"),
        F.coalesce("n", F.lit(0)).alias("n"),
    ).withColumn("density", ratio(F.col("n"), F.lit(n * width)))
    return table, index


def densest_bin(df: DataFrame, column: str, bins: int) -> DataFrame:
    """SL10: rows strictly inside the fullest bin (the first one on a tie)."""
    table, _ = histogram(df, column, bins)
    best = table.orderBy(F.desc("n"), "bin").first()
    if best is None:
        return df.limit(0)
    return df.where((F.col(column) > best["start"]) & (F.col(column) < best["stop"]))
