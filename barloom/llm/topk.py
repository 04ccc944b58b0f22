"""Exact top-k inner products by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import read, settle

# Candidates whose lists one task sorts, and queries it answers at once.
BLOCK, QUERIES = 4096, 4096
# List entries read per dimension before the first look at the bound; the depth doubles between looks.
DEPTH = 16


class Lists:
    """A block of candidates with one list per dimension, sorted by component."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        order = np.argsort(ids, kind="stable")
        self.ids, self.vectors = ids[order], vectors[order]
        self.rows = self.ids if rows is None else rows[order]
        self.up = np.argsort(self.vectors, axis=0, kind="stable").T.copy()
        self.values = np.take_along_axis(self.vectors, self.up.T, axis=0).T.copy()

    def top(self, own: int | None, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(row numbers, scores, list entries read per dimension) of the k best rows other than the query's ``own``.

        Lists are read from the end that adds most: the high end for positive weights, the low end for negative
        ones; weights of 0 need no list. No unseen row can score above the sum of weight times the next value
        of each list. Reading stops when that bound is below the kth score: equal scores still compete for the
        smaller id.
        """
        n = len(self.ids)
        dims = np.flatnonzero(query)
        weights = query[dims]
        seen = np.zeros(n, bool)
        seen[self.rows == own] = True  # the query itself takes no part
        unseen = n - int(seen.sum())
        rows, scores, depth = np.zeros(0, np.int64), np.zeros(0, query.dtype), 0
        while True:
            to = min(n, max(DEPTH, 2 * depth)) if len(dims) else n
            if len(dims):
                high = self.up[dims[weights > 0], n - to:n - depth]
                low = self.up[dims[weights < 0], depth:to]
                fresh = np.zeros(n, bool)
                fresh[high.ravel()] = True
                fresh[low.ravel()] = True
                fresh = np.flatnonzero(fresh & ~seen)
            else:
                fresh = np.flatnonzero(~seen)
            seen[fresh] = True
            unseen -= len(fresh)
            rows = np.concatenate([rows, fresh])
            scores = np.concatenate([scores, self.vectors[fresh] @ query])
            best = np.lexsort((rows, -scores))[:k]
            rows, scores, depth = rows[best], scores[best], to
            if not unseen:
                break
            if len(scores) == k:
                edge = np.where(weights > 0, self.values[dims, n - 1 - depth], self.values[dims, depth])
                if float(edge @ weights) < scores[-1]:
                    break
        return rows, scores, depth


def _matrix(vectors: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width), np.int64)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _exact(candidates: np.ndarray, queries: np.ndarray) -> type:
    """float64 sums whole numbers below 2**53 exactly and is much faster; beyond it integers are used."""
    reach = float(np.abs(candidates).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(candidates.shape[1], 1)
    return np.float64 if reach < 2.0**53 else np.int64


FOUND = "query_row bigint, query_id bigint, vec_id bigint, score bigint"


def _answer(k: int):
    def run(candidates: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(candidates) and len(queries):
            width = int(max(candidates["v"].map(len).max(), queries["q"].map(len).max()))
            c, q = _matrix(candidates["v"], width), _matrix(queries["q"], width)
            kind = _exact(c, q)
            lists, q = Lists(candidates["id"].to_numpy(np.int64), c.astype(kind), candidates["row"].to_numpy(np.int64)), q.astype(kind)
            for row, query_id, vector in zip(queries["query_row"].tolist(), queries["query_id"].tolist(), q, strict=True):
                rows, scores, _ = lists.top(row, vector, k)
                out += [(row, query_id, int(lists.ids[r]), int(s)) for r, s in zip(rows, scores, strict=True)]
        return pd.DataFrame(out, columns=["query_row", "query_id", "vec_id", "score"]).astype("int64")
    return run


def exact_top_k(candidates: DataFrame, queries: DataFrame, k: int, block: int = BLOCK, at_once: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of each query, ties to the smaller id.

    Both frames hold ``id``, ``v`` (whole numbers; shorter vectors count as filled with 0) and ``row``, a number of the row
    that is its own in both: every row but the query's own is a candidate, and every query row has an answer, whatever ids
    repeat. Without ``row`` the id stands for it. Rows with null id or vector take no part. Candidates are dealt into blocks of about ``block`` rows, queries into lots
    of about ``at_once``; each pair of a block and a lot is one task's work, bounded at any size. A query gets
    its k best of each block by the threshold algorithm, and the k best of those. Fewer candidates give fewer
    rows. Equal rows are candidates each; ties of score and id go to any of them.
    """
    candidates, queries = (d if "row" in d.columns else d.withColumn("row", F.col("id")) for d in (candidates, queries))
    candidates, queries = candidates.dropna(subset=["id", "v"]), queries.dropna(subset=["id", "v"])
    n, m = candidates.count(), queries.count()
    blocks, lots = max(1, -(-n // block)), max(1, -(-m // at_once))
    spread = lambda parts: F.pmod(F.xxhash64("id", "row"), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = candidates.select("id", "v", "row", spread(blocks).alias("block"), every(lots).alias("lot"))
    # New names: both frames may come from one table.
    right = queries.select(F.col("row").alias("query_row"), F.col("id").alias("query_id"), F.col("v").alias("q"), spread(lots).alias("lot")).select(
        "query_row", "query_id", "q", "lot", every(blocks).alias("block"))
    best = left.groupBy("block", "lot").cogroup(right.groupBy("block", "lot")).applyInPandas(_answer(k), FOUND)
    # At most k rows per block of each query; merged in two steps, so no task holds all blocks of a query.
    entry = F.struct((-F.col("score")).alias("neg"), "vec_id")
    part = F.pmod(F.xxhash64("vec_id"), F.lit(max(1, blocks // 64))).alias("part")
    half = best.groupBy("query_row", "query_id", part).agg(F.slice(F.array_sort(F.collect_list(entry)), 1, k).alias("top"))
    full = half.groupBy("query_row", "query_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("top"))), 1, k).alias("top"))
    return full.select("query_id", F.posexplode("top").alias("pos", "e")).select(
        "query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("e.vec_id").alias("vec_id"),
        (-F.col("e.neg")).alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    """Every vector whose id is divisible by 50 against all others, on components floor(256 x)."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).filter(~F.coalesce(bad, F.lit(False)))
    rows = rows.select(F.col("vec_id").alias("id"), F.transform(
        "embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))
    # Numbers of rows are written, so they stay when a task is repeated.
    rows = settle(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    return exact_top_k(rows, rows.filter("id % 50 = 0"), 5)


SQL = """
WITH good AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
    FROM good q JOIN good c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 5
"""
