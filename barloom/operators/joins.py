"""Time joins: equi, point-in-time, tier, event, context and grid joins (JN1-JN11)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.ordering import GRID_ROWS_PER_BLOCK, ROWS_PER_BLOCK, Ordered, explode_range, last_set, running_sum
from barloom.operators.resample import densify, fill_forward
from barloom.session import join_per_key, settle

KEY = ("symbol", "bucket")


def side_by_side(tables: Sequence[DataFrame], keys: Sequence[str] = KEY, how: str = "full_outer") -> DataFrame:
    """JN1, JN2: join tables on their time key, all rows or only common ones."""
    first, *rest = tables
    for df in rest:
        first = first.join(df, list(keys), how)
    return first


def point_in_time(now: DataFrame, later: DataFrame, seconds: int, predictors: Sequence[str],
                  key: str = "symbol", ts: str = "bucket", carry: Sequence[str] | None = None,
                  rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """JN3: values known at the start of each bar.

    A bar built over [t, t+s) is known only at t+s, so predictors move one grid
    row ahead (by adding the step to their time: no window needed), both sides
    are put on the dense grid and inner joined, and gaps are carried forward:
    in all columns, or in those of ``carry`` when the others are known to be whole.
    """
    # A shifted bar exists for grid rows after the first of the predictor side
    # and not after its last.
    dense = densify(later.select(key, ts, *predictors), seconds, [key], ts, rows_per_block)
    ends = later.groupBy(key).agg(F.max(ts).alias("_end"))
    moved = dense.withColumn(ts, F.timestamp_seconds(F.unix_seconds(ts) + seconds))
    shifted = join_per_key(moved, ends, key).where(F.col(ts) <= F.col("_end")).drop("_end")
    base = densify(now, seconds, [key], ts, rows_per_block)
    joined = base.join(shifted, [key, ts])
    rest = [c for c in joined.columns if c not in (key, ts)] if carry is None else list(carry)
    return fill_forward(joined, seconds, rest, [key], ts, rows_per_block)


def attach_labels(df: DataFrame, labels: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """JN4: left join of label columns; other columns of the label side are dropped."""
    return df.join(labels.select(*keys, *columns), list(keys), "left")


def tier(value: Column, tiers: Sequence[tuple[float, float | None, float, float]]) -> Column:
    """JN5: (ratio, deduction) of the tier that holds ``value``; the last is open-ended.

    The tier table is a handful of contract constants, so the lookup is a chain
    of conditions rather than a join.
    """
    picked = None
    for _, upper, share, deduction in tiers:
        found = F.struct(F.lit(share).alias("ratio"), F.lit(deduction).alias("deduction"))
        if upper is None:
            return found if picked is None else picked.otherwise(found)
        picked = F.when(value < upper, found) if picked is None else picked.when(value < upper, found)
    last = tiers[-1]
    return picked.otherwise(F.struct(F.lit(last[2]).alias("ratio"), F.lit(last[3]).alias("deduction")))


def funding_events(ticker: DataFrame, order: Sequence[str], keys: Sequence[str] = ("symbol",),
                   rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """JN6: rows whose time is the funding time announced by the row before."""
    series = Ordered.on_events(ticker, keys, order, rows_per_block)
    seen = series.running(_announced=last_set(F.col("funding_timestamp"), strict=True)).done()
    return seen.where(F.col("ts") == F.col("_announced")).drop("_announced")


def context_windows(df: DataFrame, anchors: DataFrame, keys: Sequence[str], position: str,
                    back: int = 15, ahead: int = 3) -> DataFrame:
    """JN7: rows ``back`` before to ``ahead`` after each anchor; overlaps repeat rows.

    Each anchor lists its positions, which turns the range join into an equi-join.
    """
    offsets = F.explode(F.sequence(F.lit(-back), F.lit(ahead)))
    wanted = anchors.select(*keys, F.col(position).alias("anchor"), offsets.alias("offset"))
    wanted = wanted.withColumn(position, F.col("anchor") + F.col("offset"))
    return wanted.join(df, [*keys, position])


def parameter_grid(df: DataFrame, grid: Sequence[Mapping[str, float]]) -> DataFrame:
    """JN10: every row once per parameter set; the sets are literals, not a join."""
    rows = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in point.items()]) for point in grid])
    return df.select("*", F.inline(rows))


def right_aligned(curves: DataFrame, value: str, run: str = "run_id", step: str = "step") -> DataFrame:
    """JN11: curves aligned at their last step; the start of shorter ones is 0.

    Steps of a run are its row positions 1..n, so a row moves by the difference
    of its run's length to the longest; missing rows are made per run.
    """
    sizes = settle(curves.groupBy(run).agg(F.max(step).alias("_n")), "sizes")
    longest = sizes.agg(F.max("_n")).first()[0]
    moved = curves.join(sizes, run).select(
        run, (F.col(step) + longest - F.col("_n")).alias(step), value)
    short = sizes.where(F.col("_n") < longest)
    pad = explode_range(short, F.lit(1).cast("long"), F.lit(longest) - F.col("_n"), step).select(
        run, step, F.lit(0.0).alias(value))
    return moved.unionByName(pad)


def accumulated(df: DataFrame, keys: Sequence[str], step: str, column: str, out: str,
                rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """Running sum along dense steps (the curve compared by JN11)."""
    series = Ordered.on_steps(df, keys, step, rows_per_block)
    return series.running(**{out: running_sum(F.col(column))}).done()
