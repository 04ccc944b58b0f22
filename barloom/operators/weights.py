"""Episode weights and proportional sampling (SW1-SW4)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators.ordering import GRID_ROWS_PER_BLOCK, Ordered, running_sum
from barloom.operators.quantiles import quantile_values
from barloom.session import settle

# Bins per bandwidth, and terms of the series in them: with values at most a
# quarter of a bandwidth off the middle, what is cut off is below 1e-9 of a density.
BINS_PER_BANDWIDTH = 2
TERMS = 13


def exponential_weight(value: Column, beta: float) -> Column:
    """SW1."""
    return F.exp(beta * value)


def sigmoid_weight(value: Column, beta: float) -> Column:
    """SW1."""
    return 1 / (1 + F.exp(-beta * value))


def silverman_bandwidth(df: DataFrame, column: str) -> float:
    """SW2: 1.06 * min(std, IQR / 1.34) * n^(-1/5)."""
    spread, n = df.agg(F.stddev_pop(column), F.count(column)).first()
    low, high = quantile_values(df, column, (0.25, 0.75))
    # A column without spread gets a unit bandwidth: every row then has the same density.
    return 1.06 * (min(spread, (high - low) / 1.34) or spread or 1 / 1.06) * n ** (-1 / 5)


def _hermite(offset: int) -> list[float]:
    """He_k(d) * exp(-d * d / 2) for k below 2 * TERMS, d the distance of two bins in bandwidths."""
    d = offset / BINS_PER_BANDWIDTH
    found = [1.0, d]
    for k in range(1, 2 * TERMS - 2):
        found.append(d * found[k] - k * found[k - 1])
    return [x * math.exp(-d * d / 2) for x in found]


def with_density(df: DataFrame, column: str, bandwidth: float, out: str = "density") -> DataFrame:
    """Rows with the Gaussian kernel density at their own value; rows without a value are left out.

    The sum over all rows, without pairs of rows: values become powers of their
    distance to the middle of a bin, added up per bin (map-side), a bin sends
    its sums to the bins in reach of the kernel, and a row evaluates the series
    of its bin. The reach grows with the number of rows, so that all mass beyond
    it together stays below 1e-10 of a row's own.
    """
    low, n = df.agg(F.min(column), F.count(column)).first()
    if not n:
        return df.where("false").withColumn(out, F.lit(0.0))
    width = bandwidth / BINS_PER_BANDWIDTH
    index = F.floor((F.col(column) - low) / width)
    rows = df.where(F.col(column).isNotNull()).withColumn("_bin", index)
    at = (F.col(column) - low - (F.col("_bin") + 0.5) * width) / bandwidth
    rows = rows.withColumn("_at", at)
    sums = rows.groupBy("_bin").agg(*[F.sum(F.pow("_at", F.lit(float(k)))).alias(f"_m{k}") for k in range(TERMS)])
    moments = F.array(*[F.col(f"_m{k}") / float(math.factorial(k)) for k in range(TERMS)])
    reach = math.ceil(math.sqrt(2 * math.log(n / 1e-10)) * BINS_PER_BANDWIDTH) + 1
    offsets = range(-reach, reach + 1)
    # As text: thousands of literals, which the JVM parses faster than the driver makes them one by one.
    table = F.expr("array(" + ", ".join(
        f"named_struct('o', {o}, 'h', array({', '.join(f'{x!r}D' for x in _hermite(o))}))" for o in offsets) + ")")
    sent = sums.select("_bin", moments.alias("_m"), F.explode(table).alias("_t"))
    # Coefficient m of the series at a bin, from one sending bin.
    terms = [F.aggregate(
        F.zip_with("_m", F.slice("_t.h", m + 1, TERMS), lambda x, h: x * h), F.lit(0.0), lambda s, x: s + x,
    ) * ((-1.0) ** m / math.factorial(m)) for m in range(TERMS)]
    series = sent.select((F.col("_bin") + F.col("_t.o")).alias("_bin"), *[t.alias(f"_c{m}") for m, t in enumerate(terms)])
    series = series.groupBy("_bin").agg(*[F.sum(f"_c{m}").alias(f"_c{m}") for m in range(TERMS)])
    value = F.lit(0.0)
    for m in reversed(range(TERMS)):
        value = value * F.col("_at") + F.col(f"_c{m}")
    # As many bins as there are in use, not rows.
    joined = rows.join(settle(series.join(sums.select("_bin"), "_bin", "left_semi"), "density"), "_bin")
    return joined.withColumn(out, value / (n * bandwidth * math.sqrt(2 * math.pi))).drop(
        "_bin", "_at", *[f"_c{m}" for m in range(TERMS)])


def density_weights(df: DataFrame, column: str, bandwidth: float | None = None, tail: float | None = None,
                    shape: str | None = None, beta: float = 10.0, out: str = "weight") -> DataFrame:
    """SW2, SW3: inverse density weights, optionally times an SW1 weight.

    Without ``tail`` weights sum to one. With it, they are the inverse share of
    density between the ``tail / 2`` quantiles and 1 outside of them.
    """
    h = silverman_bandwidth(df, column) if bandwidth is None else bandwidth
    rows = with_density(df, column, h)
    inverse, whole = rows.agg(F.sum(1 / F.col("density")), F.sum("density")).first()
    if tail is None:
        weight = 1 / F.col("density") / inverse
    else:
        low, high = quantile_values(df, column, (tail / 2, 1 - tail / 2))
        weight = F.when(F.col(column).between(low, high), whole / F.col("density")).otherwise(1.0)
    if shape == "exp":
        weight = weight * exponential_weight(F.col(column), beta)
    elif shape == "sigmoid":
        weight = weight * sigmoid_weight(F.col(column), beta)
    return rows.withColumn(out, weight).drop("density")


def hash_uniform(*parts: Column) -> Column:
    """Number in [0, 1) from a hash: the same on every run and engine."""
    digest = F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 2.0**32


def stratified_sample(df: DataFrame, position: str, priority: str, draws: int, beta: float, seed: int = 0,
                      rows_per_block: int = GRID_ROWS_PER_BLOCK) -> DataFrame:
    """SW4: one draw in each of ``draws`` equal parts of the summed priority.

    A row knows the interval of the running sum it covers, hence which draws
    can fall into it: no search and no join. Importance weights are
    (n p)^-beta over their largest value.
    """
    n, whole = df.agg(F.count(priority), F.sum(priority)).first()
    series = Ordered.on_steps(df, [], position, rows_per_block)
    rows = series.running(_upto=running_sum(F.col(priority))).done()
    part = whole / draws
    before = F.col("_upto") - F.col(priority)
    first, last = F.floor(before / part), F.least(F.floor(F.col("_upto") / part), F.lit(draws - 1))
    rows = rows.withColumn("draw", F.explode(F.when(last >= first, F.sequence(first, last))))
    point = (F.col("draw") + hash_uniform(F.col("draw"), F.lit(seed))) * part
    hits = rows.where((point >= before) & (point < F.col("_upto"))).drop("_upto")
    raw = F.pow(n * F.col(priority) / whole, F.lit(-beta))
    top = hits.agg(F.max(raw)).first()[0]
    return hits.withColumn("importance", raw / top)
