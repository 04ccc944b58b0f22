"""Regime segmentation and segment metrics (RG1-RG12)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators.ordering import BLOCK, GRID_ROWS_PER_BLOCK, Fold, Ordered, last_set
from barloom.operators.quantiles import exact_quantiles, values_at_ranks
from barloom.session import join_per_key, settle

TINY = 1e-10


def smoothed_turns(series: Ordered, value: str, reach: int = 3) -> Ordered:
    """RG1, RG2: centred triangular mean ``smooth`` and the flag ``turn``.

    The mean is symmetric, so it does not shift the series in time; at the ends
    it uses the rows there are. A row turns when its smoothed return has the
    opposite sign of the one before.
    """
    def smooth(w) -> dict[str, Column]:
        top, weight = F.lit(0.0), F.lit(0.0)
        for j in range(-reach, reach + 1):
            x = F.lag(value, j).over(w) if j > 0 else F.lead(value, -j).over(w) if j < 0 else F.col(value)
            share = float(reach + 1 - abs(j))
            top = top + F.coalesce(x * share, F.lit(0.0))
            weight = weight + F.when(x.isNotNull(), share).otherwise(0.0)
        return {"smooth": ratio(top, weight)}

    def change(w) -> dict[str, Column]:
        return {"_ret": F.coalesce(ratio(F.col("smooth"), F.lag("smooth").over(w)) - 1, F.lit(0.0))}

    def turn(w) -> dict[str, Column]:
        return {"turn": F.coalesce(F.lag("_ret").over(w) * F.col("_ret") < 0, F.lit(False))}

    made = series.with_frames(smooth, change, turn, back=reach + 2, ahead=reach)
    return made.on(made.df.drop("_ret"))


def segments(series: Ordered, min_length: int) -> DataFrame:
    """RG3: (keys, position, segment_start): turns closer than ``min_length`` to the last kept one are merged.

    ``series`` is dense over 0-based positions and carries ``turn``. Only rows that turn are scanned. How a block
    answers depends only on how far before it the last kept turn lies, and only up to ``min_length``: a short array
    of exits describes it. The kept turns then mark their rows, and the last mark so far is a row's segment.
    """
    step, keys, size = series.order[0], list(series.keys), series.size
    turns = series.on(series.df.where("turn").select(*keys, step, BLOCK))

    def summarise(pdf: pd.DataFrame) -> dict:
        at, start = pdf[step].to_numpy(), int(pdf[BLOCK].iloc[0]) * size
        last = at.copy()
        for i in range(len(at) - 2, -1, -1):
            j = int(np.searchsorted(at, at[i] + min_length))
            if j < len(at):
                last[i] = last[j]
        first = np.searchsorted(at, start + min_length - np.arange(min_length + 1))
        return {"at": start, "exits": [int(last[i]) if i < len(at) else -1 for i in first]}

    def walk(state: int, row: dict) -> int:
        found = int(row["exits"][min(min_length, row["at"] - state)])
        return state if found < 0 else found

    def replay(pdf: pd.DataFrame, state: int) -> pd.DataFrame:
        at, kept, last = pdf[step].to_numpy(), [], int(state)
        while (i := int(np.searchsorted(at, last + min_length))) < len(at):
            last = int(at[i])
            kept.append(i)
        return pdf.iloc[kept][[*keys, BLOCK, step]].assign(_kept=at[kept])

    types = {f.name: f.dataType.simpleString() for f in series.df.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in (*keys, BLOCK, step))
    kept = turns.scan(summarise, walk, replay, 0, "at long, exits array<long>", "long", f"{schema}, _kept long")
    marked = series.on(series.df.select(*keys, BLOCK, step).join(settle(kept, "turns"), [*keys, BLOCK, step], "left"))
    found = marked.running(segment_start=last_set(F.col("_kept"))).done()
    return found.select(*keys, step, F.coalesce("segment_start", F.lit(0).cast("long")).alias("segment_start"))


def segment_slopes(rows: DataFrame, keys: Sequence[str], position: str, value: str) -> DataFrame:
    """RG4: least-squares slope per segment, as percent of its first value."""
    grouped = rows.groupBy(*keys, "segment_start").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(value, position).alias("_first"),
        F.covar_pop(F.col(value), F.col(position).cast("double")).alias("_xy"),
        F.var_pop(F.col(position).cast("double")).alias("_xx"))
    slope = F.coalesce(ratio(F.col("_xy"), F.col("_xx")), F.lit(0.0))
    return grouped.select(*keys, "segment_start", "n", slope.alias("slope"),
                          (100 * ratio(slope, F.col("_first"))).alias("norm_slope"))


def slope_cuts(slopes: DataFrame, keys: Sequence[str], classes: int, trim: float = 0.1) -> DataFrame:
    """RG5: cut points equally spaced between the trimmed lowest and highest slope."""
    ends = values_at_ranks(slopes, keys, "norm_slope", {
        "_low": lambda n: F.floor(n * (trim / 2)) + 2, "_high": lambda n: F.floor(n * (1 - trim / 2))})
    step = (F.col("_high") - F.col("_low")) / (classes - 2)
    # The last cut point is the high end itself, not a sum that rounds next to it.
    inner = [F.col("_low") + step * (i - 1) for i in range(1, classes - 1)]
    return ends.select(*keys, F.array(*inner, F.col("_high")).alias("cuts"))


def quantile_cuts(slopes: DataFrame, keys: Sequence[str], classes: int) -> DataFrame:
    """RG6: cut points at the i/k quantiles."""
    found = exact_quantiles(slopes, keys, "norm_slope", [i / classes for i in range(1, classes)])
    return found.select(*keys, F.array(*[f"q{i}" for i in range(classes - 1)]).alias("cuts"))


def label_segments(slopes: DataFrame, cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RG5, RG6: class of a segment is the first cut point not below its slope."""
    over = F.size(F.filter("cuts", lambda c: c < F.col("norm_slope")))
    return join_per_key(slopes, cuts, keys).withColumn("label", over).drop("cuts")


def spread_labels(rows: DataFrame, labelled: DataFrame, keys: Sequence[str]) -> DataFrame:
    """RG7: the label of each row's segment."""
    return rows.join(labelled.select(*keys, "segment_start", "label"), [*keys, "segment_start"])


def window_slopes(rows: DataFrame, keys: Sequence[str], position: str, value: str, length: int) -> DataFrame:
    """RG8: least-squares slope of each full window of ``length`` rows."""
    grouped = rows.groupBy(*keys, F.floor(F.col(position) / length).alias("window_id")).agg(
        F.count(F.lit(1)).alias("_n"), F.covar_pop(F.col(value), F.col(position).cast("double")).alias("_xy"),
        F.var_pop(F.col(position).cast("double")).alias("_xx"))
    return grouped.where(F.col("_n") == length).select(*keys, "window_id", ratio(F.col("_xy"), F.col("_xx")).alias("slope"))


def _running_extreme(value: Column, position: Column, sign: int) -> Fold:
    """Running (extreme value, first position that reached it) as a struct."""
    x = F.struct((sign * value).alias("v"), (-position).alias("p"))
    return Fold(F.max(x), lambda _: F.max(x), F.max, F.greatest)


def segment_moves(rows: DataFrame, keys: Sequence[str], position: str, value: str,
                  rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """RG9-RG11: average slope and length, and the largest fall and rise, per segment.

    The fall runs from a running peak, the rise from a running low; ties take
    the first. Slopes are the move over its length, shares its length over the
    segment's.
    """
    ids = [*keys, "segment_start"]
    v, p = F.col(value), F.col(position)
    series = Ordered.on_steps(rows.select(*ids, position, value), ids, position, rows_per_block)
    run = series.running(_peak=_running_extreme(v, p, 1), _low=_running_extreme(v, p, -1)).done()
    peak, low = F.col("_peak"), F.col("_low")
    fall = ratio(peak["v"] - v, peak["v"])
    rise = ratio(v + low["v"], -low["v"])
    found = run.groupBy(*ids).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(v, p).alias("_a"), F.max_by(v, p).alias("_b"),
        F.max(F.struct(fall.alias("m"), (-p).alias("p"), (p + peak["p"]).alias("len"))).alias("_fall"),
        F.max(F.struct(rise.alias("m"), (-p).alias("p"), (p + low["p"]).alias("len"))).alias("_rise"))

    def of(move: str, name: str) -> list[Column]:
        moved = F.col(f"{move}.m") > 0
        length = F.when(moved, F.col(f"{move}.len")).otherwise(0)
        return [
            (F.when(moved, F.col(f"{move}.m")).otherwise(0.0) / (length + TINY)).alias(f"{name}_slope"),
            length.alias(f"{name}_length"), (length / F.col("n")).alias(f"{name}_share"),
        ]

    return found.select(
        *ids, "n", ratio(F.col("_b") - F.col("_a"), F.col("n") * F.col("_a")).alias("average_slope"),
        *of("_fall", "fall"), *of("_rise", "rise"))


def label_distributions(metrics: DataFrame, columns: Sequence[str], label: str = "label") -> DataFrame:
    """RG12: quartiles of each metric per label, long form."""
    rows = F.inline(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("_x")) for c in columns]))
    found = exact_quantiles(metrics.select(label, rows), [label, "metric"], "_x", (0.0, 0.25, 0.5, 0.75, 1.0))
    return found.withColumnsRenamed({"q0": "min", "q1": "q25", "q2": "q50", "q3": "q75", "q4": "max"})
