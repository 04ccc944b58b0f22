"""Session settings the operators rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    # Bucket arithmetic is done on UTC instants.
    "spark.sql.session.timeZone": "UTC",
    # Lets a join on (key, block, time) keep the (key, block) partitioning that
    # the windows before and after it need, so a chain of them shuffles once.
    "spark.sql.requireAllClusterKeysForCoPartition": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings above to a session."""
    for key, value in DEFAULTS.items():
        spark.conf.set(key, value)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for cut lineage: ``spark.checkpoint.dir``, which executors share.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="barloom-")
    atexit.register(shutil.rmtree, root, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(root)
    return root


def join_per_key(df: DataFrame, table: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join a table that has one row per series to the rows of ``df``.

    A key may hold a third of all rows, so they are not to be dealt by it. The table is written first: then
    the planner knows its size, sends it whole to every task if it is below
    ``spark.sql.autoBroadcastJoinThreshold``, and shuffles (splitting hot keys) otherwise.
    """
    return df.join(settle(table, "per-key"), [keys] if isinstance(keys, str) else list(keys), how)


# What ``settle`` wrote, by session: names of folders, no data.
_WRITTEN: dict[str, list[str]] = {}


def forget(spark: SparkSession, *tables: DataFrame) -> int:
    """Delete ``tables`` that ``settle`` returned and nothing will read again; without any, all that it wrote for this
    application: results not yet written or collected are lost then. Number of folders."""
    known = _WRITTEN.get(spark.sparkContext.applicationId, [])
    paths = [t._settled for t in tables] if tables else list(known)
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        if path in known:
            known.remove(path)
    return len(paths)


def settle(df: DataFrame, tag: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as parquet in the scratch folder and read it back.

    Cuts the lineage where a table is used by several later branches, so that
    they do not recompute it and survive the loss of an executor.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{tag}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    made = spark.read.schema(df.schema).parquet(path)
    made._settled = path
    return made
