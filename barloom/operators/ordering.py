"""Ordered computations over long or skewed series.

``Window.partitionBy(key)`` puts a whole series into one task. Here a series is
cut into blocks of bounded size, windows run inside (key, block), and what
crosses a block edge travels either as a copy of the few rows next to the edge
(``with_frames``) or as one summary row per block (``running``).

Blocks come from the position on a dense grid (bars, run steps), which bounds
their size by construction, or from sampled cut points for raw events, where
only series larger than ``rows_per_block`` are cut.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.session import settle

BLOCK = "_block"
OWN = "_own"
ONLY = "_only"

ROWS_PER_BLOCK = 2_000_000
GRID_ROWS_PER_BLOCK = 100_000
MAX_BLOCKS = 8192
SAMPLES_PER_BLOCK = 32


@dataclass(frozen=True)
class Fold:
    """A running aggregate: inside a block, per block, and how the two join.

    A backward one runs over the rows in reverse: its frame grows from the end, so no row is read again for another.
    """

    local: Column
    total: Callable[[Column], Column]
    carry: Callable[[Column], Column]
    merge: Callable[[Column, Column], Column]
    strict: bool = False
    backward: bool = False


def _first_set(local: Column, carried: Column) -> Column:
    return F.coalesce(local, carried)


def _plus(local: Column, carried: Column) -> Column:
    return F.coalesce(local + carried, local, carried)


def running_sum(value: Column, strict: bool = False, backward: bool = False) -> Fold:
    return Fold(F.sum(value), lambda _: F.sum(value), F.sum, _plus, strict, backward)


def running_product(value: Column) -> Fold:
    return Fold(
        F.product(value), lambda _: F.product(value), F.product,
        lambda a, b: F.coalesce(a * b, a, b),
    )


def running_max(value: Column, strict: bool = False) -> Fold:
    return Fold(F.max(value), lambda _: F.max(value), F.max, F.greatest, strict)


def running_min(value: Column, strict: bool = False) -> Fold:
    return Fold(F.min(value), lambda _: F.min(value), F.min, F.least, strict)


def last_set(value: Column, strict: bool = False) -> Fold:
    """Last non-null value so far (forward fill); ``strict`` leaves out this row."""
    return Fold(
        F.last(value, ignorenulls=True),
        lambda order: F.max_by(value, F.when(value.isNotNull(), order)),
        lambda c: F.last(c, ignorenulls=True),
        _first_set, strict,
    )


def next_set(value: Column, strict: bool = False) -> Fold:
    """Next non-null value from here on (backward fill)."""
    return Fold(
        F.last(value, ignorenulls=True),
        lambda order: F.min_by(value, F.when(value.isNotNull(), order)),
        lambda c: F.last(c, ignorenulls=True),
        _first_set, strict, backward=True,
    )


@dataclass(frozen=True)
class Ordered:
    """Rows of ``keys`` in ``order`` (unique within a key), maybe cut into blocks."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    split: bool
    position: Column | None = None
    size: int = 0
    folded: bool = False

    @classmethod
    def on_grid(cls, df: DataFrame, keys: Sequence[str], ts: str, seconds: int,
                rows_per_block: int = GRID_ROWS_PER_BLOCK) -> Ordered:
        """One row per key and grid point: position is the grid index."""
        position = F.floor(F.unix_seconds(F.col(ts)) / seconds)
        return cls._dense(df, keys, ts, position, rows_per_block)

    @classmethod
    def on_steps(cls, df: DataFrame, keys: Sequence[str], step: str,
                 rows_per_block: int = GRID_ROWS_PER_BLOCK) -> Ordered:
        """One row per key and integer step, without gaps."""
        return cls._dense(df, keys, step, F.col(step).cast("long"), rows_per_block)

    @classmethod
    def _dense(cls, df, keys, order, position, size) -> Ordered:
        df = df.withColumn(BLOCK, F.floor(position / size).cast("long"))
        return cls(df, tuple(keys), (order,), True, position, size)

    @classmethod
    def on_events(cls, df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  rows_per_block: int = ROWS_PER_BLOCK) -> Ordered:
        """Raw events. Counts the keys; only those above the size are cut.

        Cut points are order values of a hash-chosen sample of bounded size and
        are held as fixed values, so a recomputed task finds the same blocks.
        """
        keys, order = tuple(keys), tuple(order)
        if not keys:  # one series: a constant stands for its key
            df, keys = df.withColumn(ONLY, F.lit(0)), (ONLY,)
        whole = cls(df.withColumn(BLOCK, F.lit(0).cast("long")), keys, order, False)
        sizes = df.groupBy(*keys[:1]).count()
        total, largest = sizes.agg(F.sum("count"), F.max("count")).first()
        per_block = max(rows_per_block, (total or 0) // MAX_BLOCKS)
        if (largest or 0) <= per_block:
            return whole
        sizes = df.groupBy(*keys).count()
        # At most total / per_block <= MAX_BLOCKS keys can pass this filter.
        hot = sizes.where(F.col("count") > per_block).toArrow()
        if not hot.num_rows:
            return whole
        spark = df.sparkSession
        hot_keys = spark.createDataFrame(hot)
        every = max(1, per_block // SAMPLES_PER_BLOCK)
        sample = (
            df.select(*keys, *order)
            .where(F.pmod(F.xxhash64(*keys, *order), F.lit(every)) == 0)
            .join(F.broadcast(hot_keys), list(keys))
            .groupBy(*keys, "count")
            .agg(F.array_sort(F.collect_list(F.struct(*order))).alias("s"))
        )
        n_cuts = F.least(F.ceil(F.col("count") / per_block) - 1, F.size("s")).cast("int")
        cuts = sample.select(
            *keys,
            F.transform(
                F.sequence(F.lit(1), F.greatest(n_cuts, F.lit(1))),
                lambda i: F.get(
                    F.col("s"),
                    F.floor(i * F.size("s") / (F.greatest(n_cuts, F.lit(1)) + 1)).cast("int"),
                ),
            ).alias("_cuts"),
        )
        points = cuts.toArrow()
        fixed = spark.createDataFrame(points)
        # Binary search for the number of cut points not above the row, with as
        # many steps as the longest list needs; uncut keys skip it.
        longest = max(len(found) for found in points.column("_cuts").to_pylist())
        powers = F.array(*[F.lit(1 << p) for p in reversed(range(longest.bit_length()))])
        here = F.struct(*order)
        search = F.aggregate(
            powers, F.lit(0),
            lambda lo, step: F.when(
                (lo + step <= F.size("_cuts")) & (F.get("_cuts", lo + step - 1) <= here),
                lo + step,
            ).otherwise(lo),
        )
        block = F.when(F.col("_cuts").isNull(), 0).otherwise(search)
        placed = (
            df.join(F.broadcast(fixed), list(keys), "left")
            .withColumn(BLOCK, block.cast("long"))
            .drop("_cuts")
        )
        return cls(placed, keys, order, True)

    def on(self, df: DataFrame) -> Ordered:
        """The same layout over a frame derived from this one."""
        return Ordered(df, self.keys, self.order, self.split, self.position, self.size, self.folded)

    @property
    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys, BLOCK).orderBy(*self.order)

    def rank_in_block(self) -> Column:
        """A long that increases along the series (block first, then row)."""
        return F.shiftleft(F.col(BLOCK), 32) + F.row_number().over(self.window)

    def running(self, **folds: Fold) -> Ordered:
        """Add running aggregates over the whole series of each key.

        Rows and block totals both read this frame, so one that already holds such aggregates is written first: a chain
        of them reads each step twice, not twice as often as the step before.
        """
        if self.split and self.folded:
            self = self.on(settle(self.df, "folded"))
        order = F.struct(*self.order) if len(self.order) > 1 else F.col(self.order[0])

        def frame(fold: Fold, keys: Sequence[str], order: Sequence[str], strict: bool) -> WindowSpec:
            by = [F.col(c).desc() if fold.backward else F.col(c) for c in order]
            return Window.partitionBy(*keys).orderBy(*by).rowsBetween(Window.unboundedPreceding, -int(strict))

        inside = self.df.withColumns(
            {name: f.local.over(frame(f, (*self.keys, BLOCK), self.order, f.strict)) for name, f in folds.items()}
        )
        if not self.split:
            return self.on(inside)
        totals = self.df.groupBy(*self.keys, BLOCK).agg(
            *[f.total(order).alias(f"_t_{name}") for name, f in folds.items()]
        )
        carried = totals.select(
            *self.keys, BLOCK,
            *[
                f.carry(F.col(f"_t_{name}")).over(frame(f, self.keys, (BLOCK,), True)).alias(f"_c_{name}")
                for name, f in folds.items()
            ],
        )
        joined = inside.join(carried, [*self.keys, BLOCK], "left")
        merged = joined.withColumns(
            {name: f.merge(F.col(name), F.col(f"_c_{name}")) for name, f in folds.items()}
        ).drop(*[f"_c_{name}" for name in folds])
        return replace(self.on(merged), folded=True)

    def with_frames(self, *stages: Callable[[WindowSpec], dict[str, Column]],
                    back: int = 0, ahead: int = 0) -> Ordered:
        """Add columns over row frames reaching ``back`` rows and ``ahead`` rows.

        Needs a dense layout. Each row also goes to the neighbouring block when
        it lies within reach of it; the copies are dropped at the end. Later
        stages may use the columns of earlier ones; the reach is their sum.
        """
        return self.with_frames_sql(
            *[lambda df, stage=stage: df.withColumns(stage(self.window)) for stage in stages],
            back=back, ahead=ahead)

    def with_frames_sql(self, *stages: Callable[[DataFrame], DataFrame], back: int = 0, ahead: int = 0) -> Ordered:
        """``with_frames`` for stages that map frames, for example by SQL text over ``window_sql``."""
        df = self._with_neighbours(back, ahead)
        for stage in stages:
            df = stage(df)
        return self.on(df.where(F.col(OWN)).drop(OWN))

    @property
    def window_sql(self) -> str:
        keys = ", ".join(f"`{c}`" for c in (*self.keys, BLOCK))
        return f"PARTITION BY {keys} ORDER BY {', '.join(f'`{c}`' for c in self.order)}"

    def _with_neighbours(self, back: int, ahead: int) -> DataFrame:
        if self.position is None:
            raise ValueError("row frames need a dense layout (on_grid or on_steps)")
        if max(back, ahead) > self.size:
            raise ValueError(f"frame reach {max(back, ahead)} exceeds block size {self.size}")
        home = F.floor(self.position / self.size).cast("long")
        offset = F.pmod(self.position, F.lit(self.size))
        owners = F.array_compact(F.array(
            home,
            F.when(offset >= self.size - back, home + 1),
            F.when(offset < ahead, home - 1),
        ))
        return self.df.withColumn(BLOCK, F.explode(owners)).withColumn(OWN, F.col(BLOCK) == home)

    def map_blocks(self, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                   back: int = 0) -> DataFrame:
        """Run ``fn`` on each block as a sorted pandas frame with its ``back`` earlier rows.

        ``fn`` returns one row per input row; rows that are only copies are dropped.
        """
        order = list(self.order)

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, ignore_index=True)
            return fn(pdf)[pdf[OWN].to_numpy()]

        return self._with_neighbours(back, 0).groupBy(*self.keys, BLOCK).applyInPandas(run, schema)

    def scan(self, summarise: Callable[[pd.DataFrame], dict], walk: Callable[[object, dict], object],
             replay: Callable[[pd.DataFrame, object], pd.DataFrame], start: object,
             summary_schema: str, state_type: str, schema: str, backward: bool = False) -> DataFrame:
        """A state machine along each series, block by block.

        ``summarise`` turns a block into one row that tells how it maps the state
        at its entry to the state at its exit; ``walk`` applies that row to a
        state; ``replay`` produces a block's output rows from its entry state.
        Tasks hold one block, or one summary row per block of a series.
        """
        keys, order = list(self.keys), list(self.order)
        key_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}"
                               for f in self.df.schema.fields if f.name in keys)
        lead = f"{key_schema}, {BLOCK} long" if keys else f"{BLOCK} long"
        ids = [*keys, BLOCK]

        def summary(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, ignore_index=True)
            return pd.DataFrame([{**{k: pdf[k].iloc[0] for k in ids}, **summarise(pdf)}])

        def entries(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(BLOCK, ascending=not backward, ignore_index=True)
            state, seen = start, []
            for row in pdf.to_dict("records"):
                seen.append(state)
                state = walk(state, row)
            return pdf[ids].assign(_state=pd.Series(seen))

        def output(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(order, ignore_index=True)
            return replay(pdf, pdf["_state"].iloc[0])

        blocks = self.df.groupBy(*ids).applyInPandas(summary, f"{lead}, {summary_schema}")
        states = blocks.groupBy(*keys).applyInPandas(entries, f"{lead}, _state {state_type}")
        return self.df.join(states, ids).groupBy(*ids).applyInPandas(output, schema)

    def done(self) -> DataFrame:
        return self.df.drop(BLOCK, ONLY)


def explode_range(df: DataFrame, lo: Column, hi: Column, out: str,
                  rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """A row for each integer from ``lo`` to ``hi``, in two steps of bounded arrays.

    The outer step makes blocks, the inner one their rows, so a long range
    never fills an array.
    """
    size = F.lit(rows_per_block)
    blocks = F.sequence(F.floor(lo / size), F.floor(hi / size))
    outer = df.withColumns({"_lo": lo, "_hi": hi}).withColumn("_b", F.explode(F.when(hi >= lo, blocks)))
    inner = F.sequence(F.greatest("_lo", F.col("_b") * size), F.least("_hi", F.col("_b") * size + size - 1))
    return outer.withColumn(out, F.explode(inner)).drop("_lo", "_hi", "_b")
