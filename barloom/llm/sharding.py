"""Shards along a Hilbert curve through the documents' metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import read, settle

# Levels per dimension: 2 ** BITS. Three dimensions make 4,096 cells, whatever the input.
BITS = 4
# A cell is dealt to SPLITS groups per started CELL_ROWS of its rows.
SPLITS, CELL_ROWS = 64, 1 << 20


def bucket(value: Column, bits: int = BITS) -> Column:
    """Level of a label: its CRC-32 modulo the number of levels; null is level 0."""
    return F.coalesce(F.crc32(value.cast("string").cast("binary")) % (1 << bits), F.lit(0)).cast("int")


def magnitude(value: Column, bits: int = BITS) -> Column:
    """Level of a size: floor(log2(value)) less 4, cut to the levels there are; below 1 and null are level 0."""
    digits = F.length(F.bin(F.greatest(F.coalesce(value.cast("long"), F.lit(0)), F.lit(0)))) - 1
    return F.greatest(F.least(digits - 4, F.lit((1 << bits) - 1)), F.lit(0)).cast("int")


def _gray(i: int) -> int:
    return i ^ (i >> 1)


def _turn(i: int, n: int) -> int:
    """Axis along which the curve leaves sub-cube ``i``: trailing ones of i or i - 1."""
    i = i if i % 2 or not i else i - 1
    return ((~i & (i + 1)).bit_length() - 1) % n


def with_hilbert_index(cells: DataFrame, levels: list[str], name: str, bits: int = BITS) -> DataFrame:
    """``cells`` with the position of each on the Hilbert curve through its ``levels``.

    Walks the bits of the coordinates from the top; the state is the entry corner and direction of the sub-cube
    reached so far, both moved by small tables built from Gray codes. One select per step, so no expression is
    written out more than once.
    """
    n = len(levels)
    corners, mask = 1 << n, (1 << n) - 1
    rank = [0] * corners
    for i in range(corners):
        rank[_gray(i)] = i
    entry = [0 if not i else _gray(2 * ((i - 1) // 2)) for i in range(corners)]

    def look(table: list[int], at: Column) -> Column:
        return F.get(F.array(*[F.lit(x) for x in table]), at)

    def rotate(x: Column, left: Column) -> Column:
        """n-bit rotation to the left by 0..n-1 places."""
        return F.get(F.array(*[x if not s else F.shiftleft(x, s).bitwiseOR(F.shiftright(x, n - s)).bitwiseAND(
            F.lit(mask)) for s in range(n)]), left)

    rows = cells.withColumns({"_e": F.lit(0), "_d": F.lit(0), "_h": F.lit(0)})
    for bit in range(bits - 1, -1, -1):
        parts = [F.shiftright(F.col(c), bit).bitwiseAND(F.lit(1)) * (1 << k) for k, c in enumerate(levels)]
        rows = rows.withColumn("_x", reduce(lambda a, b: a + b, parts).cast("int").bitwiseXOR(F.col("_e")))
        rows = rows.withColumn("_w", look(rank, rotate(F.col("_x"), (F.lit(2 * n - 1) - F.col("_d")) % n)))
        rows = rows.withColumns({
            "_e": F.col("_e").bitwiseXOR(rotate(look(entry, F.col("_w")), (F.col("_d") + 1) % n)),
            "_d": ((F.col("_d") + look([_turn(i, n) for i in range(corners)], F.col("_w")) + 1) % n).cast("int"),
            "_h": (F.col("_h") * corners + F.col("_w")).cast("int")})
    return rows.withColumn(name, F.col("_h")).drop("_e", "_d", "_h", "_x", "_w")


def hilbert_shards(df: DataFrame, levels: list[Column], shards: int, key: str = "doc_id", *, ties: tuple[str, ...] = (),
                   bits: int = BITS, splits: int = SPLITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``df`` with ``shard`` (0 to shards-1), ``slot`` (position in it) and ``cell`` (curve index).

    Rows are sorted by (cell, group, ``key``, ``ties``) and cut into runs whose row counts differ by one at
    most, so a shard covers few neighbouring cells and files can be skipped by any of the dimensions. A group
    is a hash of the whole row modulo a number that follows from the cell's counted rows: neither a cell nor a key that
    repeats, null included, is sorted by one task; only rows equal in every column stay together. Positions come from the
    counts of groups, cells and all rows; full rows are shuffled once.

    Null keys come first in their group. Columns of maps are not hashed. Existing columns of the names added are replaced. No rows give no rows.
    """
    kept = [c for c in df.columns if c not in ("shard", "slot", "cell")]
    code = reduce(lambda a, b: a * (1 << bits) + b, levels)
    rows = df.select(*[F.col(f"`{c}`") for c in kept], code.cast("long").alias("_code"))
    cells = rows.groupBy("_code").agg(F.count("*").alias("_rows"))
    names = [f"_level{k}" for k in range(len(levels))]
    cells = cells.withColumns({c: F.shiftright("_code", bits * (len(names) - 1 - k)).bitwiseAND(
        F.lit((1 << bits) - 1)).cast("int") for k, c in enumerate(names)})
    cells = settle(with_hilbert_index(cells, names, "cell", bits).select("_code", "_rows", "cell"), "cells")
    # 2 ** (dimensions * bits) rows at most, here as below where they are broadcast.
    before = F.sum("_rows").over(Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1))
    groups = (splits * F.ceil(F.col("_rows") / cell_rows)).cast("long")
    cells = cells.select("_code", "cell", groups.alias("_groups"), F.coalesce(before, F.lit(0)).alias("_cell_first"),
                         F.sum("_rows").over(Window.partitionBy(F.lit(0))).alias("_all"))
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if f.name in kept and "map<" not in f.dataType.simpleString()]
    rows = rows.join(F.broadcast(cells), "_code").withColumn(
        "_group", F.shiftleft(F.col("cell").cast("long"), 40) + F.pmod(F.xxhash64(*hashed), F.col("_groups")))  # one key: joins spread by it
    parts = rows.groupBy("_group").agg(F.count("*").alias("_n"))
    inside = Window.partitionBy(F.shiftright("_group", 40)).orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_group", F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_group_first"))
    order = Window.partitionBy("_group").orderBy(F.col(f"`{key}`"), *ties)
    at = F.col("_cell_first") + F.col("_group_first") + F.row_number().over(order) - 1
    rows = rows.join(parts, "_group").withColumn("_at", at)
    # The first _all % shards runs hold one row more.
    size, longer = F.floor(F.col("_all") / shards), F.col("_all") % shards
    edge = longer * (size + 1)
    early = F.col("_at") < edge
    late = F.when(size > 0, F.floor((F.col("_at") - edge) / F.greatest(size, F.lit(1)))).otherwise(0)
    shard = F.when(early, F.floor(F.col("_at") / (size + 1))).otherwise(longer + late)
    slot = F.when(early, F.col("_at") % (size + 1)).otherwise((F.col("_at") - edge) % F.greatest(size, F.lit(1)))
    return rows.select(*[F.col(f"`{c}`") for c in kept], shard.cast("int").alias("shard"),
                       slot.cast("long").alias("slot"), F.col("cell").cast("int").alias("cell"))


def shard_documents(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """Documents with their shard: curve through language, source and text size."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = docs.withColumn("_crc", F.crc32(text.cast("binary")))
    levels = [bucket(F.col("lang")), bucket(F.col("source")), magnitude(F.octet_length(text) + 1)]
    return hilbert_shards(docs, levels, shards, "doc_id", ties=("_crc",), **options).drop("_crc")


def query(spark, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of equal row counts (law ``rows``)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), "lang", "source")
    levels = [bucket(F.col("lang")), bucket(F.col("source")), magnitude(F.col("size"))]
    made = hilbert_shards(docs, levels, 16, "doc_id", ties=("text_crc32", "size"))
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"), "cell")
