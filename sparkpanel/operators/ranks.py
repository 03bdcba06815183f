"""Rank statistics: Spearman, ROC area, average precision, quintiles, selection on a grid. Degenerate inputs give null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def average_rank(value: str, groups: list[str]) -> Column:
    """Rank from 1, ties sharing their mean rank. Both are of one order, so that rows are sorted once."""
    order = W.partitionBy(*groups).orderBy(value)
    return F.rank().over(order) + (F.count(F.lit(1)).over(order.rangeBetween(W.currentRow, W.currentRow)) - 1) / 2


def spearman(rows: DataFrame, groups: list[str], left: str, right: str, name: str = "spearman") -> DataFrame:
    """groups, name: null where either side is constant."""
    return ranked(rows.select(*groups, left, right), groups, left, right).groupBy(*groups).agg(of_ranks(left, right).alias(name))


def ranked(rows: DataFrame, groups: list[str], left: str, right: str) -> DataFrame:
    """rows with the ranks __l and __r of both sides."""
    return rows.withColumn("__l", average_rank(left, groups)).withColumn("__r", average_rank(right, groups))


def of_ranks(left: str, right: str) -> Column:
    """The correlation of ranked rows, an aggregate."""
    varies = (F.min(left) < F.max(left)) & (F.min(right) < F.max(right))
    return F.when(varies, F.try_divide(F.covar_pop("__l", "__r"), F.stddev_pop("__l") * F.stddev_pop("__r")))


def auc(rows: DataFrame, groups: list[str], score: str, outcome: str, name: str = "auc") -> DataFrame:
    """Area under the ROC curve from the rank sum; null unless both outcomes (1, 0) occur."""
    ranked = rows.withColumn("__r", average_rank(score, groups))
    positive = F.sum(F.col(outcome).cast("double"))
    total = F.count(F.lit(1))
    area = F.try_divide(F.sum(F.col("__r") * F.col(outcome)) - positive * (positive + 1) / 2, positive * (total - positive))
    return ranked.groupBy(*groups).agg(F.when((positive > 0) & (positive < total), area).alias(name))


def average_precision(rows: DataFrame, groups: list[str], score: str, outcome: str, name: str = "auprc") -> DataFrame:
    """Sum of recall steps times precision over falling scores, tied scores being one step; null without positives.

    Scores are counted first, so that the ordered pass sees distinct scores only.
    """
    steps = rows.groupBy(*groups, score).agg(F.sum(F.col(outcome).cast("double")).alias("__tp"), F.count(F.lit(1)).alias("__n"))
    down = W.partitionBy(*groups).orderBy(F.desc(score)).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy(*groups)
    run = steps.select(*groups, F.col("__tp"), (F.sum("__tp").over(down) / F.sum("__n").over(down)).alias("__p"), F.sum("__tp").over(every).alias("__all"))
    return run.groupBy(*groups).agg(F.when(F.max("__all") > 0, F.sum(F.try_divide("__tp", "__all") * F.col("__p"))).alias(name))


def quintiles(rows: DataFrame, groups: list[str], signal: str, values: list[str], key: list[str], parts: int = 5) -> DataFrame:
    """groups, quintile, n, signal_mean and each value's mean; rows in order of signal, ties by key."""
    cut = rows.withColumn("quintile", F.ntile(parts).over(W.partitionBy(*groups).orderBy(signal, *key)))
    return cut.groupBy(*groups, "quintile").agg(F.count(F.lit(1)).alias("n"), F.avg(signal).alias("signal_mean"), *(F.avg(v).alias(f"{v}_mean") for v in values))


def least_on_grid(curve: DataFrame, groups: list[str], position: str, score: str) -> DataFrame:
    """groups, position and score of the least score; ties go to the smaller position."""
    return curve.groupBy(*groups).agg(F.min(F.struct(F.col(score), F.col(position))).alias("__best")).select(*groups, F.col(f"__best.{position}"), F.col(f"__best.{score}"))


def steps_down(curve: DataFrame, groups: list[str], count: str, score: str) -> DataFrame:
    """groups, steps, falling: differences between neighbouring counts, and how many are not rises."""
    w = W.partitionBy(*groups).orderBy(count)
    moved = curve.withColumn("__d", F.col(score) - F.lag(score).over(w))
    return moved.groupBy(*groups).agg(F.count("__d").alias("steps"), F.count(F.when(F.col("__d") <= 0, 1)).alias("falling"))
