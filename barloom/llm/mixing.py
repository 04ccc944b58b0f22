"""Mixing sources to target weights by pivotal dependent rounding."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.llm.common import WORD, field, numbered, read, settle, small

# Units rounded by one task, and residuals combined by one task of the next level.
GROUP = 512
# A source is taken at most this many times.
MOST = 3.0


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST,
            total: float | None = None) -> DataFrame:
    """``sources`` (source, source_size) with ``target``.

    Weights repeat along the sources in code point order, null last. Targets share ``total`` (default: all
    sizes) by weight but stop at ``most`` times the size; the excess goes to the others by weight until none is
    above. Each round is one aggregate over the sources; only its sums reach the driver. If ``total`` is more
    than ``most`` times all sizes, every source stops at its limit.
    """
    listed = numbered(sources, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights)).cast("int"))
    listed = listed.withColumn("_weight", weight)
    limit = most * F.col("source_size")
    rate, found = 0.0, -1
    while True:
        full = F.col("_weight") * F.lit(rate) >= limit
        fixed, free, n, size = listed.agg(
            F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("_weight"))), F.count(F.when(full, 1)),
            F.sum("source_size")).first()
        if found < 0:  # nothing is full yet; empty sources are full at any rate
            total = float(size or 0) if total is None else float(total)
        if not free or n == found:
            break
        found, rate = n, max(rate, (total - (fixed or 0.0)) / free)
    share = F.col("_weight") * F.lit(rate)
    return listed.select("source", "source_size", "units", F.least(share, limit.cast("double")).alias("target"),
                         (share >= limit).alias("_full"))


def _uniform(seed: str, *parts) -> float:
    digest = hashlib.blake2b(repr((seed, *parts)).encode(), digest_size=8).digest()
    return int.from_bytes(digest, "big") / 2.0**64


def pivot_even(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> int:
    """Rounds equal probabilities ``p`` in place; returns the row left fractional, or -1.

    Keeps ``sum(p * w)`` and every mean. From the heaviest row down, a row is paired with the pool of all
    lighter ones. Mass moves from one side to the other, in a direction drawn with ``u`` so that the means stay,
    until the row is 0 or 1 (or, if it outweighs the pool, until the pool is). The pool shares one probability
    throughout, so it absorbs heavy rows and what stays fractional at the end is one of the lightest.
    """
    order = [int(i) for i in np.lexsort((np.arange(len(p)), -w)) if 0.0 < p[i] < 1.0]
    q = float(p[order[0]]) if order else 0.0
    for k, i in enumerate(order):
        pool = order[k + 1:]
        weight = float(w[pool].sum())
        mine, theirs, space = q * w[i], q * weight, (1.0 - q) * weight
        if not pool:
            p[i] = q
            return i
        up, down = min(w[i] - mine, theirs), min(mine, space)
        if u[i] * (up + down) < down:  # towards 1
            p[i], q = (1.0, (theirs - up) / weight) if w[i] - mine < theirs else ((mine + theirs) / w[i], 0.0)
        else:
            p[i], q = (0.0, (theirs + down) / weight) if mine < space else ((mine - space) / w[i], 1.0)
        if not 1e-12 < q < 1.0 - 1e-12:
            p[pool] = round(q)
            return i if 0.0 < p[i] < 1.0 else -1
    return -1


def pivot_pairs(p: np.ndarray, w: np.ndarray, u: np.ndarray) -> int:
    """As ``pivot_even`` for unequal probabilities: two rows at a time, the lightest last."""
    held = -1
    for j in (int(i) for i in np.lexsort((np.arange(len(p)), -w)) if 0.0 < p[i] < 1.0):
        i, held = held, j
        if i < 0:
            continue
        mine, other = p[i] * w[i], p[j] * w[j]
        up, down = min(w[i] - mine, other), min(mine, w[j] - other)
        if u[j] * (up + down) < down:
            p[i], p[j] = (1.0, (other - up) / w[j]) if w[i] - mine < other else ((mine + up) / w[i], 0.0)
        else:
            p[i], p[j] = (0.0, (other + down) / w[j]) if mine < w[j] - other else ((mine - down) / w[i], 1.0)
        held = next((k for k in (i, j) if 0.0 < p[k] < 1.0), -1)
    return held


UNIT = "source string, unit long, size long, weight long, whole int, p double, node long, done boolean"


def _round_group(seed: str, level: int):
    def group(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["unit", "size", "weight"], kind="stable").reset_index(drop=True)
        p, w = part["p"].to_numpy(float).copy(), part["weight"].to_numpy(float)
        u = np.array([_uniform(seed, level, int(k), int(s)) for k, s in zip(part["unit"], part["size"], strict=True)])
        left = (pivot_pairs if level else pivot_even)(p, w, u)
        done = np.ones(len(part), bool)
        if left >= 0:
            done[left] = False
        return part.assign(p=p, done=done)
    return group


def copies(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = MOST, seed: str = "mix",
           group: int = GROUP) -> DataFrame:
    """Copies of each document: (doc_id, source, unit, size, source_size, target, copies), one row per document.

    ``size`` counts the words (runs without ASCII white space; null text: none). A source needs
    ``target / source_size`` copies of each word. Each document gets the whole part; the fraction is rounded by
    pivoting weighted by words, so the words taken stay equal to the target but for the one residual that
    remains per source, as a rule one of its shortest units. Rounding runs in groups of ``group`` units of
    one source; the residuals of ``group`` groups meet in the next level until one is left, which a draw decides.
    Draws are hashes of (seed, level, unit), so reruns agree.

    Rows with equal id, source and text are one unit: they get equal copies. Documents without words take none.
    Null sources are a source of their own, the last. Null ids and no rows are allowed.
    """
    text = field(docs, "text", T.StringType())
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = settle(docs.select(
        field(docs, "doc_id", T.LongType()).alias("doc_id"), field(docs, "source", T.StringType()).alias("source"),
        F.xxhash64(field(docs, "doc_id", T.LongType()), field(docs, "source", T.StringType()), text).alias("unit"),
        words.alias("size")), "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("units"))
    planned = settle(targets(sources, weights, most), "targets")
    n_sources, largest = planned.agg(F.count("*"), F.max("units")).first()

    unit = rows.filter("size > 0").groupBy("source", "unit", "size").agg((F.col("size") * F.count("*")).alias("weight"))
    near = small(planned, n_sources).alias("s")
    unit = unit.alias("u").join(near, F.expr("u.source <=> s.source")).select("u.*", "s.source_size", "s.target",
                                                                            "s._full", "s.units")
    need = F.when(F.col("_full"), F.lit(most)).otherwise(F.col("target") / F.col("source_size"))
    unit = unit.withColumn("_need", need).select(
        "source", "unit", "size", "weight", F.floor("_need").cast("int").alias("whole"),
        (F.col("_need") - F.floor("_need")).alias("p"),
        F.pmod(F.xxhash64("unit", "size", F.lit("deal")), F.ceil(F.col("units") / group)).cast("long").alias("node"),
        F.lit(False).alias("done"))

    nodes, level, parts, open_ = max(1, -(-(largest or 0) // group)), 0, [], unit
    while True:
        rounded = open_.groupBy("source", "node").applyInPandas(_round_group(seed, level), UNIT)
        rounded = settle(rounded, f"rounded{level}")
        parts.append(rounded.filter("done"))
        open_ = rounded.filter("NOT done").withColumn("node", F.floor(F.col("node") / group).cast("long"))
        if nodes == 1:
            break
        nodes, level = -(-nodes // group), level + 1
    final = F.udf(lambda k, s, p: 1.0 if _uniform(seed, "last", k, s) < p else 0.0, "double")
    parts.append(open_.withColumn("p", final("unit", "size", "p")))  # one row per source
    decided = parts[0]
    for more in parts[1:]:
        decided = decided.unionByName(more)
    decided = decided.select("source", "unit", "size", (F.col("whole") + F.col("p").cast("int")).alias("copies"))
    with_targets = rows.alias("r").join(near, F.expr("r.source <=> s.source")).select("r.*", "s.source_size", "s.target")
    return with_targets.alias("r").join(
        decided.alias("d"), F.expr("r.unit = d.unit AND r.size = d.size AND r.source <=> d.source"), "left").select(
        "r.*", F.coalesce("d.copies", F.lit(0)).cast("int").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: columns of ``docs``, each row as often as ``copies`` says."""
    plan = copies(docs, **options).groupBy("unit").agg(F.max("copies").alias("_copies"))
    key = F.xxhash64(field(docs, "doc_id", T.LongType()), field(docs, "source", T.StringType()),
                     field(docs, "text", T.StringType()))
    joined = docs.withColumn("_unit", key).join(plan.withColumnRenamed("unit", "_unit"), "_unit")
    names = [F.col(f"`{c}`") for c in docs.columns]
    return joined.filter("_copies > 0").select(*names, F.explode(F.sequence(F.lit(1), "_copies")).alias("_copy")).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    found = copies(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return found.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target",
                        (F.col("copies") * F.col("size")).cast("long").alias("taken"))
