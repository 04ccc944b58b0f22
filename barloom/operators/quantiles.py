"""Exact quantiles of columns too large for one task."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ordering import ROWS_PER_BLOCK, Ordered, running_sum
from barloom.session import settle


# Bins of a counting pass; two passes tell BINS squared stretches of a column's range apart.
BINS = 4096
# Rows that are selected from without being counted in bins first.
REFINED = 1_000_000


def _place(value: Column, lo: Column, hi: Column) -> Column:
    """Position of a value between the least and the greatest finite one, in bins; never falls where values rise."""
    v = value.cast("double")
    inside = F.when(hi > lo, F.least(F.greatest((v / 2 - lo / 2) / (hi / 2 - lo / 2) * BINS, F.lit(0.0)), F.lit(BINS - 0.5))).otherwise(0.0)
    return F.when(F.isnan(v), F.lit(BINS + 1.0)).when(v == float("inf"), F.lit(float(BINS))).when(
        v == float("-inf"), F.lit(-1.0)).otherwise(inside)


def _wanted(counts: DataFrame, by: Sequence[str], step: str, offsets: DataFrame) -> DataFrame:
    """The bin ``step`` that holds each of ``offsets`` (by, name, at), the offset in it and its rows. Bins have counts ``_n``."""
    upto = F.sum("_n").over(Window.partitionBy(*by).orderBy(step))
    bins = counts.withColumn("_upto", upto)
    inside = (F.col("at") >= F.col("_upto") - F.col("_n")) & (F.col("at") < F.col("_upto"))
    found = bins.join(offsets.select(*by, "name", "at"), list(by)).where(inside)
    return found.select(*by, step, "name", (F.col("at") - F.col("_upto") + F.col("_n")).alias("at"), F.col("_n").alias("_held"))


def values_at_ranks(df: DataFrame, keys: Sequence[str], column: str,
                    ranks: Mapping[str, Callable[[Column], Column]],
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Per key that is not null, the values at 0-based ranks given as functions of the group size.

    Spark's ``percentile`` holds all distinct values of a group in one buffer. Here a pass finds each key's range and
    rows; while more than ``REFINED`` rows are in question they are counted in bins, and the wanted bins in finer ones; the last selects the values of the few stretches that hold
    a wanted rank: only bin counts and those values are shuffled, whatever the number of rows and distinct values. The
    values of a stretch are counted and ranked in blocks, so one that holds a third of all rows is one row, and a
    stretch that takes in nearly the whole column (its range set by outliers) is still ranked exactly.
    """
    own = [*keys] or ["_all"]
    rows = df.where(F.col(column).isNotNull()).select(*keys, *([] if keys else [F.lit(0).alias("_all")]), F.col(column).alias("_v"))
    finite = F.when(~F.isnan(F.col("_v").cast("double")) & (F.abs(F.col("_v").cast("double")) < float("inf")), F.col("_v").cast("double"))
    ends = [F.coalesce(f(finite), F.lit(0.0)).alias(c) for f, c in ((F.min, "_lo"), (F.max, "_hi"))] + [F.count(F.lit(1)).alias("_size")]
    if keys:
        limits = settle(rows.groupBy(*own).agg(*ends), "limits")
        placed = rows.join(limits.drop("_size"), own)
    else:  # one row, read once and used as values
        lo, hi, size = rows.agg(*ends).first()
        limits = df.sparkSession.range(int(size > 0)).select(F.lit(0).alias("_all"), F.lit(size).cast("long").alias("_size"))
        placed = rows.withColumns({"_lo": F.lit(lo), "_hi": F.lit(hi)})
    placed = placed.withColumn("_x", _place(F.col("_v"), F.col("_lo"), F.col("_hi"))).select(
        *own, "_v", F.floor("_x").alias("_coarse"), F.floor((F.col("_x") - F.floor("_x")) * BINS).alias("_fine"))
    at = F.inline(F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("_size")).cast("long").alias("at")) for name, rank in ranks.items()]))
    offsets, by, here = limits.select(*own, at), own, placed
    held = (limits.agg(F.sum("_size")).first()[0] or 0) if keys else size
    for step in ("_coarse", "_fine"):
        if held <= REFINED:  # few rows are left to select from
            break
        counts = settle(here.groupBy(*by, step).agg(F.count(F.lit(1)).alias("_n")), "bins")
        offsets, by = settle(_wanted(counts, by, step, offsets), "offsets"), [*by, step]
        held = offsets.agg(F.sum("_held")).first()[0] or 0
        here = placed.join(offsets.select(*by).distinct(), by)
    values = settle(here.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_n")), "counts")
    if held <= rows_per_block:
        ranked = values.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy("_v")))
    else:
        ranked = Ordered.on_events(values, by, ["_v"], rows_per_block).running(_upto=running_sum(F.col("_n"))).done()
    found = ranked.join(offsets, by).where((F.col("at") >= F.col("_upto") - F.col("_n")) & (F.col("at") < F.col("_upto")))
    picked = found.groupBy(*own).agg(*[F.max(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    return picked.join(limits.select(*own, "_size"), own).drop(*([] if keys else ["_all"]))


def exact_quantiles(df: DataFrame, keys: Sequence[str], column: str, shares: Sequence[float],
                    rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """Linearly interpolated quantiles per key as columns ``q0``, ``q1``, ..."""
    ranks: dict[str, Callable[[Column], Column]] = {}
    for i, share in enumerate(shares):
        ranks[f"_lo{i}"] = lambda n, share=share: F.floor(share * (n - 1))
        ranks[f"_hi{i}"] = lambda n, share=share: F.ceil(share * (n - 1))
    picked = values_at_ranks(df, keys, column, ranks, rows_per_block)
    return picked.select(*keys, *[
        (F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}"))
         * (share * (F.col("_size") - 1) - F.floor(share * (F.col("_size") - 1)))).alias(f"q{i}")
        for i, share in enumerate(shares)
    ])


def quantile_values(df: DataFrame, column: str, shares: Sequence[float],
                    rows_per_block: int = ROWS_PER_BLOCK) -> list[float]:
    """The quantiles of a whole column as numbers (one row leaves Spark)."""
    return list(exact_quantiles(df, [], column, shares, rows_per_block).first())
