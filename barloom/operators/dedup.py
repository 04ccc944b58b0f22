"""De-duplication, tie-breaking and ordering of tick tables (DD1-DD7)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barloom.operators.ordering import ROWS_PER_BLOCK, Ordered, running_sum


def spread_ties(df: DataFrame, keys: Sequence[str], ts: str, arrival: Sequence[str],
                rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """DD1: rows of equal time get 0, 1, 2, ... microseconds added in arrival order."""
    series = Ordered.on_events(df, [*keys, ts], arrival, rows_per_block)
    ranked = series.running(_nth=running_sum(F.lit(1))).done()
    shifted = F.timestamp_micros(F.unix_micros(ts) + F.col("_nth") - 1)
    return ranked.withColumn(ts, shifted).drop("_nth")


def keep_first(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """DD2: first row by ``arrival`` per key.

    The rank filter is applied before the shuffle as well as after it, so a key
    with many copies sends one row per map task.
    """
    w = Window.partitionBy(*keys).orderBy(*arrival)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def first_values(df: DataFrame, keys: Sequence[str], arrival: Sequence[str],
                 columns: Sequence[str]) -> DataFrame:
    """DD3: first non-null value of each column per key, combined map-side."""
    order = F.col(arrival[0]) if len(arrival) == 1 else F.struct(*arrival)
    return df.groupBy(*keys).agg(*[
        F.min_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns
    ])


def equal_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """DD4: for each column, the first column with the same content.

    Content fingerprints are made on rows unpivoted to (column, hash), so that
    thousands of columns stay a narrow, map-side combined aggregate. Nulls count
    as content.
    """
    ids = ", ".join(f"`{k}`" for k in keys)
    hashes = ", ".join(f"xxhash64({ids}, `{c}`, `{c}` IS NULL)" for c in columns)
    found = (
        df.select(F.posexplode(F.expr(f"array({hashes})"))).groupBy("pos")
        .agg(F.sum(F.col("col").cast("decimal(38,0)")).alias("print")).collect()
    )
    prints = {columns[row["pos"]]: row["print"] for row in found}
    first_with: dict = {}
    rows = [
        F.struct(
            F.lit(position).alias("position"), F.lit(column).alias("column"),
            F.lit(first_with.setdefault(prints.get(column), column)).alias("same_as"),
        )
        for position, column in enumerate(columns)
    ]
    return df.sparkSession.range(1).select(F.inline(F.array(*rows)))


def drop_equal_columns(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """DD4: drop every column that repeats an earlier one."""
    twins = equal_columns(df, keys, columns).where("column <> same_as").select("column")
    return df.drop(*[row["column"] for row in twins.collect()])


def ordered_union(lists: DataFrame, item: str, order: Sequence[str]) -> DataFrame:
    """DD5: distinct items in order of first appearance (ties: by item), with their ``rank``; any number of them."""
    firsts = lists.groupBy(item).agg(F.min(F.struct(*order)).alias("_first")).select(
        item, *[F.col(f"_first.{c}").alias(f"_by_{i}") for i, c in enumerate(order)])
    ranked = row_ids(firsts, [], [*[f"_by_{i}" for i in range(len(order))], item], "rank")
    return ranked.select(item, (F.col("rank") + 1).alias("rank"))


def sorted_by(df: DataFrame, *columns: str) -> DataFrame:
    """DD6: multi-key ascending sort."""
    return df.orderBy(*columns)


def row_ids(df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "id",
            rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """DD7: 0-based row number along each series."""
    series = Ordered.on_events(df, keys, order, rows_per_block)
    numbered = series.running(**{out: running_sum(F.lit(1))}).done()
    return numbered.withColumn(out, F.col(out) - 1)


def move_column(df: DataFrame, column: str, position: int) -> DataFrame:
    """PR9: the same columns with one of them at another place."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest[:position], column, *rest[position:])
