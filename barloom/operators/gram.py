"""Sums over pairs of columns in one scan, and what follows from them: correlations and lasso paths (FS5, FS8)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows and columns multiplied at once.
STEP, TILE = 4096, 256
# Share of a sum of squares below which a variance is rounding.
SAME = 1e-13
SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")


class _Pairs:
    """For one key: n, x, x² and xy summed over the rows where both columns are set, for all pairs (i, j) of columns.

    Stretches of rows without nulls need xy alone by pair; the other sums are then the same for every partner.
    """

    def __init__(self, columns: int, tile: int):
        self.tile, self.n, self.one = tile, 0.0, np.zeros((2, columns))
        self.xy, self.pairs = np.zeros((columns, columns)), None

    def add(self, x: np.ndarray) -> None:
        for at in range(0, len(x), STEP):
            part = x[at:at + STEP]
            seen = ~np.isnan(part)
            if seen.all():
                self.n += len(part)
                self.one += part.sum(axis=0), (part ** 2).sum(axis=0)
            else:
                part = np.where(seen, part, 0.0)
                if self.pairs is None:
                    self.pairs = np.zeros((3, *self.xy.shape))
                known = seen.astype(float)
                for lo in range(0, part.shape[1], self.tile):
                    cut = slice(lo, lo + self.tile)
                    for into, own in zip(self.pairs, (known[:, cut], part[:, cut], part[:, cut] ** 2), strict=True):
                        into[cut] += own.T @ known
            for lo in range(0, part.shape[1], self.tile):
                self.xy[lo:lo + self.tile] += part[:, lo:lo + self.tile].T @ part

    def rows(self, key: dict[str, pa.Scalar], diagonal: bool) -> Iterator[pa.RecordBatch]:
        zero = np.zeros(len(self.xy))
        for i in range(len(self.xy)):
            j = np.arange(i if diagonal else i + 1, len(self.xy))
            if not len(j):
                continue
            mine = [zero[j]] * 3 if self.pairs is None else [p[i, j] for p in self.pairs]
            other = [zero[j]] * 3 if self.pairs is None else [p[j, i] for p in self.pairs]
            (s, q), n = self.one, self.n + mine[0]
            columns = [n, s[i] + mine[1], s[j] + other[1], q[i] + mine[2], q[j] + other[2], self.xy[i, j]]
            yield pa.RecordBatch.from_arrays(
                [pa.repeat(k, len(j)) for k in key.values()] + [pa.array(np.full(len(j), i)), pa.array(j)]
                + [pa.array(np.ascontiguousarray(c)) for c in columns], names=[*key, "i", "j", *SUMS])


def pair_sums(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), shift: Sequence[float] | None = None,
              diagonal: bool = False, tile: int = TILE) -> DataFrame:
    """(keys, i, j, n, sx, sy, sxx, syy, sxy) of every pair i < j of ``columns`` (i <= j with ``diagonal``).

    The table is read once, whatever its width: a task holds the sums of all pairs of the key it is at (rows are sorted
    by key inside their partition, none is shuffled), 8 bytes a pair of columns and 32 where there are nulls, and sends one
    row per pair. Sums are over the rows where both columns are set, of values less their ``shift``.
    """
    base = np.zeros(len(columns)) if shift is None else np.asarray(shift, float)
    schema = df.select(*keys).schema
    rows = df.select(*keys, F.array(*[F.col(f"`{c}`").cast("double") for c in columns]).alias("_x"))
    rows = rows.sortWithinPartitions(*keys) if keys else rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - base
            own = [batch.column(k) for k in keys]
            same = np.ones(batch.num_rows, bool)
            for c in own:
                a, b = c.slice(1), c.slice(0, len(c) - 1)
                equal = pa.compute.equal(a, b).fill_null(False).to_numpy(zero_copy_only=False)
                both = pa.compute.and_(a.is_null(), b.is_null()).to_numpy(zero_copy_only=False)
                same[1:] &= equal | both
            first = np.flatnonzero(np.append([False], ~same[1:])) if own else np.zeros(0, int)
            for lo, hi in zip([0, *first], [*first, batch.num_rows], strict=True):
                key = {k: c[int(lo)] for k, c in zip(keys, own, strict=True)}
                if sums is None or [v.as_py() for v in key.values()] != [v.as_py() for v in at.values()]:
                    if sums is not None:
                        yield from sums.rows(at, diagonal)
                    at, sums = key, _Pairs(len(columns), tile)
                sums.add(x[lo:hi])
        if sums is not None:
            yield from sums.rows(at, diagonal)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parts = rows.mapInArrow(run, f"{fields + ', ' if keys else ''}i long, j long, " + ", ".join(f"{c} double" for c in SUMS))
    return parts.groupBy(*keys, "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlation(sums: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, f1, f2, corr) from ``pair_sums``; null where a column is constant in the rows where both are set."""
    vx, vy = (F.col("n") * F.col(f"s{c}{c}") - F.col(f"s{c}") ** 2 for c in "xy")
    varies = (vx > SAME * F.col("n") * F.col("sxx")) & (vy > SAME * F.col("n") * F.col("syy"))
    cov = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    names = F.array(*[F.lit(f) for f in columns])
    return sums.select(*keys, F.get(names, F.col("i").cast("int")).alias("f1"), F.get(names, F.col("j").cast("int")).alias("f2"),
                       F.when(varies, cov / (F.sqrt(vx) * F.sqrt(vy))).alias("corr"))


def descend(gram: np.ndarray, cross: np.ndarray, penalty: float, start: np.ndarray, tolerance: float = 1e-12,
            sweeps: int = 10_000) -> np.ndarray:
    """Coefficients w that minimise w'Gw/2 - c'w + penalty |w|, one coordinate after the other."""
    w = start.copy()
    slope = cross - gram @ w
    free = np.flatnonzero(np.diag(gram) > SAME)
    for _ in range(sweeps):
        moved = 0.0
        for j in free:
            z = slope[j] + gram[j, j] * w[j]
            new = np.sign(z) * max(abs(z) - penalty, 0.0) / gram[j, j]
            if new != w[j]:
                slope -= gram[:, j] * (new - w[j])
                moved = max(moved, abs(new - w[j]))
                w[j] = new
        if moved <= tolerance:
            break
    return w


def _solve(n: float, total: np.ndarray, products: np.ndarray, scale: np.ndarray, penalties: np.ndarray) -> Iterator[tuple]:
    """(coefficients, intercept) for each penalty, largest first, from sums of rows (features, then the target)."""
    mean = total / n
    cov = products / n - np.outer(mean, mean)
    gram, cross = cov[:-1, :-1] / np.outer(scale, scale), cov[:-1, -1] / scale
    w = np.zeros(len(scale))
    for penalty in penalties:
        w = descend(gram, cross, penalty, w)
        yield w / scale, mean[-1] - (w / scale) @ mean[:-1]


def lasso_paths(rows: np.ndarray, folds: np.ndarray, width: int, penalties: int | Sequence[float], least: float) -> tuple[np.ndarray, float, float]:
    """Coefficients on standardised columns, the chosen penalty, and its mean squared error over the folds.

    ``rows`` holds (fold, i, j, n, sx, sy, sxy) of all pairs i <= j of the features and the target behind them.
    """
    known = {int(f): k for k, f in enumerate(np.unique(folds))}
    n = np.zeros(len(known))
    total, products = np.zeros((len(known), width)), np.zeros((len(known), width, width))
    for fold, (i, j, count, sx, sy, sxy) in zip(folds.astype(int), rows, strict=True):
        k, i, j = known[fold], int(i), int(j)
        n[k], total[k, i], total[k, j] = count, sx, sy
        products[k, i, j] = products[k, j, i] = sxy
    mean = total.sum(0) / n.sum()
    cov = products.sum(0) / n.sum() - np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1], 0))
    scale[scale <= 0] = 1.0
    top = np.abs(cov[:-1, -1] / scale).max(initial=0.0)
    if not isinstance(penalties, int):
        grid = np.sort(np.asarray(penalties, float))[::-1]
    else:
        grid = top * least ** (np.arange(penalties) / max(1, penalties - 1)) if top > 0 else np.zeros(1)
    error = np.zeros((len(known), len(grid)))
    for k in range(len(known)):
        if len(known) == 1 or n[k] == n.sum():
            continue
        rest = [sums.sum(0) - sums[k] for sums in (total, products)]
        for at, (w, b) in enumerate(_solve(n.sum() - n[k], *rest, scale, grid)):
            v = np.append(-w, 1.0)
            error[k, at] = (v @ products[k] @ v - 2 * b * (v @ total[k]) + n[k] * b * b) / n[k]
    best = int(np.argmin(error.mean(0)))
    *_, (w, _) = _solve(n.sum(), total.sum(0), products.sum(0), scale, grid[:best + 1])
    return w * scale, float(grid[best]), float(error.mean(0)[best])


def lasso(df: DataFrame, features: Sequence[str], target: str, folds: int = 5, penalties: int | Sequence[float] = 100, least: float = 1e-3,
          order: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """FS8: (keys, feature, coefficient, penalty, error): lasso on standardised inputs, the penalty chosen of
    ``penalties`` (so many, or these) by ``folds`` folds.

    One scan adds up the pair sums of each fold; a fold is left out by subtracting its sums, and every path is solved on
    sums, so its cost does not depend on the rows. The sums of a key (columns squared times folds) go to one task. With
    ``order`` (positions) folds are stretches of equal numbers of positions, else rows are dealt by their hash. Penalties
    fall evenly on a log scale from the one that leaves no feature to ``least`` of it. Rows without a target are left out,
    unset features count 0. Coefficients are of the standardised columns; constant columns have 0.
    """
    features = list(features)
    data = df.where(F.col(f"`{target}`").isNotNull()).select(
        *keys, *([order] if order else []), *[F.coalesce(F.col(f"`{f}`").cast("double"), F.lit(0.0)).alias(f) for f in features],
        F.col(f"`{target}`").cast("double").alias("_target"))
    if order:
        low, high = data.agg(F.min(order), F.max(order)).first()
        fold = F.floor((F.col(order) - F.lit(low)) * folds / F.lit((high or 0) - (low or 0) + 1)).cast("int")
    else:
        fold = F.pmod(F.xxhash64(*features, "_target"), F.lit(folds)).cast("int")
    columns = [*features, "_target"]
    shift = data.agg(*[F.avg(c).alias(str(i)) for i, c in enumerate(columns)]).first()
    shift = np.array([x or 0.0 for x in shift])
    sums = pair_sums(data.withColumn("_fold", fold), columns, [*keys, "_fold"], shift, diagonal=True)

    def solve(table: pa.Table) -> pa.Table:
        numbers = np.stack([table.column(c).to_numpy() for c in ("i", "j", "n", "sx", "sy", "sxy")], axis=1)
        w, penalty, error = lasso_paths(numbers, table.column("_fold").to_numpy(), len(columns), penalties, least)
        spread = {k: pa.repeat(table.column(k)[0], len(features)) for k in keys}
        return pa.table(spread | {"feature": pa.array(features), "coefficient": pa.array(w),
                                  "penalty": pa.array(np.full(len(w), penalty)), "error": pa.array(np.full(len(w), error))})

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.select(*keys).schema.fields) if keys else ""
    schema = f"{fields}feature string, coefficient double, penalty double, error double"
    return sums.groupBy(*(keys or [F.lit(0).alias("_all")])).applyInArrow(solve, schema)
