"""A training corpus from raw documents: filter, deduplicate, decontaminate, mix and shard.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again
as the next stage's ``docs``. All but the last return the columns of ``docs``. Stages accept null columns, empty
and very long texts, repeated rows and empty tables as the operators they call do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm import decontaminate, jaccard, mixing, sharding, toxicity
from barloom.llm.common import read, settle


def _toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents not rejected as toxic, by the network fitted on the labelled documents among them."""
    net = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return toxicity.judge(docs, net).filter("NOT rejected").select(*columns)


def _near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of each class of near duplicates."""
    return jaccard.keep_first(docs)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"))
    return found.filter(F.size("leaks") == 0).select(*columns)


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixing.mix(docs)


def _shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ``shard``, ``slot`` and ``cell``."""
    return sharding.shard_documents(docs)


STAGES = [
    ("toxicity", _toxicity),
    ("ngram_jaccard", _near_duplicates),
    ("decontamination", _decontaminate),
    ("mixing", _mix),
    ("sharding", _shard),
]

# The classifier, the edit distance and the random rounding have no SQL form; tests/llm checks each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
