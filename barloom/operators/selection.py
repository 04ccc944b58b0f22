"""Factor selection and scaling (FS1-FS12)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.functions.columns import ratio
from barloom.operators import boosting, gram
from barloom.operators.ordering import ROWS_PER_BLOCK, Ordered, running_sum
from barloom.session import join_per_key, settle

# Fixed default horizons, in rows.
HORIZONS = (1, 6, 12)


def forward_targets(series: Ordered, price: str, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """FS1: price change over each horizon, null where the series ends before it."""
    return series.with_frames(
        lambda w: {f"target_{h}": F.lead(price, h).over(w) - F.col(price) for h in horizons},
        ahead=max(horizons),
    ).done()


def _corr(x: str, y: str) -> Column:
    """Pearson correlation of the rows where both are set, null where one is constant."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = F.when(both, F.col(x)), F.when(both, F.col(y))
    varies = (F.max(a) > F.min(a)) & (F.max(b) > F.min(b))
    return F.when(varies, ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def _long(features: Sequence[str]) -> Column:
    """Feature columns as rows (pos, col): tables of thousands of columns get a narrow aggregate."""
    return F.posexplode(F.expr(f"array({', '.join(f'CAST(`{f}` AS DOUBLE)' for f in features)})"))


def _named(features: Sequence[str]) -> Column:
    names = ", ".join("'" + f.replace("'", "\\'") + "'" for f in features)
    return F.get(F.expr(f"array({names})"), F.col("pos"))


def information_coefficients(df: DataFrame, features: Sequence[str],
                             horizons: Sequence[int] = HORIZONS, keys: Sequence[str] = ()) -> DataFrame:
    """FS2: correlation of every feature with every target, one aggregate pass.

    With ``keys`` (a symbol, for instance) each key has its own coefficients.
    Rows are unpivoted and combined map-side, so only one partial row per
    feature and task is shuffled.
    """
    targets = [f"target_{h}" for h in horizons]
    long = df.select(*keys, *targets, _long(features))
    wide = long.groupBy(*keys, "pos").agg(*[_corr("col", t).alias(t) for t in targets])
    rows = F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("ic")) for h in horizons
    ]))
    return wide.select(*keys, _named(features).alias("feature"), rows)


def _average_ranks(counts: DataFrame, keys: Sequence[str], value: str, rows_per_block: int) -> DataFrame:
    """Average rank of each distinct value, minus the mean rank, and the number of rows.

    ``counts`` holds one row per key and value with its ``n``.
    """
    counts = settle(counts, "counts")
    ranked = Ordered.on_events(counts, keys, [value], rows_per_block).running(
        _upto=running_sum(F.col("n"))).done()
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("_rows"))
    centre = (F.col("_rows") + 1) / 2
    return join_per_key(ranked, sizes, keys).withColumn(
        "rank", F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2 - centre).drop("_upto")


def rank_coefficients(df: DataFrame, features: Sequence[str], horizons: Sequence[int] = HORIZONS,
                      rows_per_block: int = ROWS_PER_BLOCK, keys: Sequence[str] = ()) -> DataFrame:
    """FS3: correlation of average-tie ranks, of each key by itself if there are ``keys``.

    Ranks come from distinct values with their counts, so ties (a third of all
    rows may be one value) are one row, and the sums against the target's rank
    are formed per value before they are ranked. Only rows where feature and
    target are set count: features without nulls share one ranking of the
    targets, the others have their own.
    """
    targets = F.inline(F.array(*[
        F.struct(F.lit(h).alias("horizon"), F.col(f"target_{h}").alias("target")) for h in horizons
    ]))
    pairs = df.select(*keys, *features, targets).where(" AND ".join(["target IS NOT NULL", *[f"`{k}` IS NOT NULL" for k in keys]]))
    missing = pairs.select(_long(features)).groupBy("pos").agg(F.count_if(F.col("col").isNull()).alias("n")).where("n > 0")
    gaps = {features[row["pos"]] for row in missing.collect()}
    made = []
    for own, part in ((False, [f for f in features if f not in gaps]), (True, [f for f in features if f in gaps])):
        if not part:
            continue
        by = [*keys, "pos", "horizon"] if own else [*keys, "horizon"]
        rows = pairs.select(*keys, "horizon", "target", _long(part)).where("col is not null") if own else pairs
        ranks = _average_ranks(rows.groupBy(*by, "target").agg(F.count(F.lit(1)).alias("n")), by, "target", rows_per_block)
        ranked = rows.join(ranks.select(*by, "target", F.col("rank").alias("target_rank")), [*by, "target"])
        if not own:
            ranked = ranked.select(*keys, "horizon", "target_rank", _long(part))
        per_value = ranked.groupBy(*keys, "pos", "horizon", F.col("col").alias("value")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("target_rank").alias("s"))
        values = _average_ranks(per_value, [*keys, "pos", "horizon"], "value", rows_per_block)
        top = values.groupBy(*keys, "pos", "horizon").agg(
            F.sum(F.col("rank") * F.col("s")).alias("xy"), F.sum(F.col("n") * F.col("rank") ** 2).alias("xx"))
        bottom = ranks.groupBy(*by).agg(F.sum(F.col("n") * F.col("rank") ** 2).alias("yy"))
        made.append(top.join(bottom, by).select(
            *keys, _named(part).alias("feature"), "horizon",
            ratio(F.col("xy"), F.sqrt(F.col("xx")) * F.sqrt(F.col("yy"))).alias("ic")))
    return reduce(DataFrame.unionAll, made)


def select_by_threshold(scores: DataFrame, threshold: float, score: str = "ic") -> DataFrame:
    """FS4: features above the threshold at any horizon.

    Order: first horizon where they pass, then decreasing score in it. The table
    has one row per feature and horizon.
    """
    passed = scores.where(F.abs(score) > threshold)
    first = passed.groupBy("feature").agg(F.min(F.struct(
        F.col("horizon"), (-F.abs(score)).alias("down"), F.col("feature").alias("f"))).alias("_o"))
    return first.orderBy("_o").select("feature", F.col("_o.horizon").alias("horizon"), F.abs("_o.down").alias("score"))


def correlations(df: DataFrame, features: Sequence[str], tile: int = gram.TILE, keys: Sequence[str] = ()) -> DataFrame:
    """FS5: (keys, f1, f2, corr) of every unordered pair of columns, over the rows where both are set.

    One scan adds up the pair sums of all columns (``gram.pair_sums``), products of ``tile`` columns at a time; nothing but the columns' minima, which the
    values are counted from, leaves Spark. A column that is constant where both are set has no correlation.
    """
    least = dict(df.select(_long(features)).groupBy("pos").agg(F.min("col")).collect())
    shift = [least.get(i) or 0.0 for i in range(len(features))]
    return gram.correlation(gram.pair_sums(df, features, keys, shift, tile=tile), features, keys)


def prune_correlated(ordered: Sequence[str], corr: DataFrame, threshold: float = 0.7) -> list[str]:
    """FS6: walk features by importance, keep one unless it is too close to a kept one.

    The walk is over names: only pairs above the threshold leave Spark.
    """
    close = corr.where(F.abs("corr") > threshold).select("f1", "f2").collect()
    near: dict[str, set] = {}
    for a, b in close:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    kept: list[str] = []
    for f in ordered:
        if not near.get(f, set()) & set(kept):
            kept.append(f)
    return kept


def select_features(df: DataFrame, scores: DataFrame, ic_threshold: float, corr_threshold: float) -> DataFrame:
    """FS4 to FS6 (FS9 when ``scores`` is a stored table): (rank, feature)."""
    names = [row["feature"] for row in select_by_threshold(scores, ic_threshold).collect()]
    kept = prune_correlated(names, correlations(df, names), corr_threshold) if len(names) > 1 else names
    if not kept:
        return df.sparkSession.range(0).select(F.lit(1).alias("rank"), F.lit("").alias("feature"))
    rows = F.array(*[F.struct(F.lit(i + 1).alias("rank"), F.lit(f).alias("feature")) for i, f in enumerate(kept)])
    return df.sparkSession.range(1).select(F.inline(rows))


def select_features_by_key(df: DataFrame, scores: DataFrame, ic_threshold: float, corr_threshold: float,
                           keys: Sequence[str]) -> DataFrame:
    """FS4 to FS6 of each key by itself: (keys, rank, feature). One scan makes the correlations of all keys; the walk over
    a key's names, a number of columns at most, is one task's."""
    passed = scores.where(F.abs("ic") > ic_threshold)
    order = F.min(F.struct(F.col("horizon"), (-F.abs("ic")).alias("down"), F.col("feature").alias("f"))).alias("_o")
    first = settle(passed.groupBy(*keys, "feature").agg(order).select(*keys, "feature", "_o.horizon", "_o.down"), "passed")
    names = sorted(r["feature"] for r in first.select("feature").distinct().collect())
    if len(names) > 1:
        close = correlations(df, names, keys=keys).where(F.abs("corr") > corr_threshold).select(*keys, "f1", "f2")
    else:
        close = first.select(*keys, F.lit("").alias("f1"), F.lit("").alias("f2")).where("false")

    def walk(ordered: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, set] = {}
        for a, b in zip(pairs["f1"], pairs["f2"], strict=True):
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
        kept: list[str] = []
        for f in ordered.sort_values(["horizon", "down", "feature"])["feature"]:
            if not near.get(f, set()) & set(kept):
                kept.append(f)
        return pd.DataFrame({**{k: [ordered[k].iloc[0]] * len(kept) for k in keys}, "rank": range(1, len(kept) + 1), "feature": kept}) \
            if len(ordered) else pd.DataFrame({k: [] for k in (*keys, "rank", "feature")})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return first.groupBy(*keys).cogroup(close.groupBy(*keys)).applyInPandas(walk, f"{fields}, rank long, feature string")


def tree_importance(df: DataFrame, features: Sequence[str], target: str | Sequence[int] = HORIZONS, depth: int = 6,
                    trees: int = 20, step: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    """FS7: (keys, feature, horizon, importance) of boosted trees (absolute loss) of the target of every horizon, or
    (keys, feature, importance) of the trees of one target column."""
    one = isinstance(target, str)
    targets = {0: target} if one else {h: f"target_{h}" for h in target}
    made = boosting.boosted(df, features, targets, keys, trees=trees, depth=depth, rate=step)
    return made.importance.select(*keys, "feature", *([] if one else ["horizon"]), "importance")


def boosted_prediction(df: DataFrame, features: Sequence[str], target: str, depth: int = 4, trees: int = 20, step: float = 0.1,
                       ids: Sequence[str] = (), keys: Sequence[str] = ()) -> DataFrame:
    """FS12: (keys, ids, y, prediction) of boosted trees of the target."""
    made = boosting.boosted(df, features, {0: target}, keys, ids, trees=trees, depth=depth, rate=step)
    return made.rows.select(*keys, *[c for c in ids if c not in keys], "y", "prediction")


def lasso_features(df: DataFrame, features: Sequence[str], target: str, penalties: int | Sequence[float] = 100, folds: int = 5,
                   order: str | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """FS8: features that the lasso of ``gram.lasso`` keeps, with their coefficients."""
    return gram.lasso(df, features, target, folds, penalties, order=order, keys=keys).where("coefficient <> 0")


def power_of_ten_scale(df: DataFrame, columns: Sequence[str], clip: float = 10.0, keys: Sequence[str] = ()) -> DataFrame:
    """FS10, FS11: divide by the power of ten below the std, then shift large means; of each key by itself if there are ``keys``.

    Both statistics come from one aggregate with a row per column: the mean
    after scaling is the mean divided by the scale. With keys each row meets
    the scales of its key as one array.
    """
    stats = df.select(*keys, _long(columns)).groupBy(*keys, "pos").agg(
        F.avg("col").alias("mean"), F.stddev_samp("col").alias("std"))
    power = F.when(F.col("std") > 0, F.pow(F.lit(10.0), F.floor(F.log10("std"))))
    scaled = F.col("mean") / F.col("power")
    # numpy rounds halves to even.
    shift = F.when(F.abs(scaled) > clip, F.signum(scaled) * F.pow(F.lit(10.0), F.rint(F.log10(F.abs(scaled)))))
    found = stats.withColumn("power", power).select(*keys, "pos", "power", F.coalesce(shift, F.lit(0.0)).alias("shift"))
    if keys:
        by_key = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "power", "shift"))).alias("_scales"))
        rows = join_per_key(df, by_key, keys, "left")
        kept = [c for c in df.columns if c not in columns]
        out = {c: F.coalesce(F.col(f"`{c}`") / F.col("_scales")[i]["power"] - F.col("_scales")[i]["shift"], F.col(f"`{c}`"))
               for i, c in enumerate(columns)}
        return rows.select(*[F.col(f"`{c}`") if c in kept else out[c].alias(c) for c in df.columns])
    scale = {columns[row["pos"]]: f"`{columns[row['pos']]}` / {row['power']!r}D - ({row['shift']!r}D)"
             for row in found.where("power is not null").collect()}
    return df.selectExpr(*[f"{scale[c]} AS `{c}`" if c in scale else f"`{c}`" for c in df.columns])
