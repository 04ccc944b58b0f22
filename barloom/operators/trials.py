"""Choice of the best trials and runs (SC1-SC9, SE2, DD6, PR10)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONDITION = ("label", "initial_action")


def with_epoch(df: DataFrame, path: str = "epoch_path", out: str = "epoch_number") -> DataFrame:
    """PR10: the number in ``epoch_<n>`` of a path."""
    return df.withColumn(out, F.regexp_extract(path, r"epoch_(\d+)", 1).cast("int"))


def trial_summary(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """SC1: mean and population std of reward per length, mean turnover, per trial."""
    normal = F.col("reward_sum") / F.col("df_length")
    return parts.groupBy(*keys).agg(
        F.avg(normal).alias("reward_mean"), F.stddev_pop(normal).alias("reward_std"),
        F.avg("turnover").alias("mean_turnover"))


def preferenced(penalty: float) -> Column:
    """Mean reward less a multiple of its std."""
    return F.col("reward_mean") - penalty * F.col("reward_std")


def best_rows(df: DataFrame, keys: Sequence[str], score: Column, ties: Sequence[str]) -> DataFrame:
    """The row of the highest score per key, smallest ``ties`` first.

    A maximum of a struct, so it combines before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(score, *[-F.col(t) for t in ties]))
    picked = df.where(score.isNotNull())
    picked = picked.groupBy(*keys).agg(best.alias("_b")) if keys else picked.agg(best.alias("_b"))
    return picked.select(*keys, "_b.*")


def best_trials(summary: DataFrame, penalty: float, within: Sequence[str] = ("epoch",)) -> DataFrame:
    """SC2: best trial per condition inside each of ``within``; SC6, SC9 with ``within=()``."""
    return best_rows(summary, [*within, *CONDITION], preferenced(penalty), ["bin_index"])


def best_per_label(summary: DataFrame) -> DataFrame:
    """SC3: (bin, epoch) with the highest average of means per label."""
    means = summary.groupBy("label", "bin_index", "epoch").agg(F.avg("reward_mean").alias("reward_max"))
    return best_rows(means, ["label"], F.col("reward_max"), ["bin_index", "epoch"])


def epoch_scores(summary: DataFrame, penalty: float) -> DataFrame:
    """SC4: preferenced mean per (epoch, initial action), then averaged per epoch."""
    single = summary.groupBy("epoch", "initial_action").agg(F.avg(preferenced(penalty)).alias("_a"))
    return single.groupBy("epoch").agg(F.avg("_a").alias("score"))


def best_epoch(summary: DataFrame, penalty: float) -> DataFrame:
    """SC4: the epoch of the highest score."""
    return best_rows(epoch_scores(summary, penalty), [], F.col("score"), ["epoch"])


def best_bins(summary: DataFrame, penalty: float) -> DataFrame:
    """SC5: rows of the best bin per label inside the best epoch."""
    epoch = best_epoch(summary, penalty).select("epoch")
    inside = summary.join(epoch, "epoch", "left_semi")
    means = inside.groupBy("label", "bin_index").agg(F.avg("reward_mean").alias("_m"))
    best = best_rows(means, ["label"], F.col("_m"), ["bin_index"]).select("label", "bin_index")
    return inside.join(best, ["label", "bin_index"], "left_semi")


def _by_indicator(df: DataFrame, best_high: Sequence[str], best_low: Sequence[str]) -> DataFrame:
    """One row per indicator and row, with ``_score`` where higher is better."""
    parts = [F.struct(F.lit(c).alias("indicator"), F.col(c).alias("_score")) for c in best_high]
    parts += [F.struct(F.lit(c).alias("indicator"), (-F.col(c)).alias("_score")) for c in best_low]
    return df.select("*", F.inline(F.array(*parts))).where("_score is not null")


def top_per_indicator(df: DataFrame, best_high: Sequence[str], best_low: Sequence[str], n: int,
                      ties: Sequence[str]) -> DataFrame:
    """SC7, SE2: the ``n`` best rows of every indicator with ``rank`` and ``indicator``."""
    from barloom.operators.signals import top_rows

    rows = _by_indicator(df, best_high, best_low)
    return top_rows(rows, ["indicator"], [F.desc("_score"), *[F.col(t) for t in ties]], n).drop("_score")


def best_per_indicator(df: DataFrame, best_high: Sequence[str], best_low: Sequence[str],
                       ties: Sequence[str]) -> DataFrame:
    """SC8: the best row of every indicator, by that indicator."""
    rows = _by_indicator(df, best_high, best_low)
    return best_rows(rows, ["indicator"], F.col("_score"), ties).drop("_score")
