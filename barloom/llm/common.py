"""What the corpus operators share: session settings, cut lineage, checked broadcasts, numbering."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.session import configure
from barloom.session import settle as _settle

# Rows sent to Python at once hold about this many bytes: long texts make small batches.
BATCH_BYTES = 8 << 20
# Shuffle files of a finished write are not read again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Stands for a null document id: after every other id.
NO_ID = (1 << 63) - 1
# A run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def cleaning(spark: SparkSession):
    """Shuffle files of each job in here are deleted as soon as its result is written."""
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before)


def settle(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (see ``session.settle``)."""
    with cleaning(df.sparkSession):
        return _settle(df, tag)


def small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """``df`` marked for broadcast if its counted ``rows`` are few, else left to a shuffle join."""
    return F.broadcast(df) if rows <= limit else df


def keep_columns(df: DataFrame, *made: str) -> list[str]:
    """Columns of ``df`` other than those an operator adds: equal names are replaced."""
    return [c for c in df.columns if c not in made]


def field(df: DataFrame, name: str, kind: T.DataType) -> F.Column:
    """Column ``name`` cast to ``kind``; null where ``df`` has no such column."""
    return F.col(f"`{name}`").cast(kind) if name in df.columns else F.lit(None).cast(kind)


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Rows numbered from 0 in ``order``, without bringing them to one task.

    The sorted rows are written with (partition, offset) ids; only one row per
    partition is needed to turn those into positions.
    """
    rows = settle(df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_id", 33)
    sizes = rows.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).collect()
    first, at = {}, 0
    for part_id, n in sorted(map(tuple, sizes)):
        first[part_id], at = at, at + n
    if not first:
        return rows.withColumn(name, F.col("_id")).drop("_id")
    starts = F.create_map(*[F.lit(x) for pair in first.items() for x in pair])
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn(name, starts[part] + inside).drop("_id")
