"""Location and scale rules. Three fall-back rules for a degenerate scale exist side by side; they are not one rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.quantiles import large_quantiles


def quantile(value: str, p: float) -> Column:
    """Linear interpolation between order statistics; null without rows."""
    return F.percentile(value, F.lit(p))


def lower_median(value: str) -> Column:
    """The lower middle value where the number of values is even."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})")


def _same(keys: list[str], other: str) -> Column:
    found = F.lit(True)
    for k in keys:
        found = found & F.col(k).eqNullSafe(F.col(f"{other}{k}"))
    return found


def iqr_scale(rows: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """keys, scale: interquartile range, at least a tenth of the population deviation and at least 0.001.

    Groups are few (markers, modalities) and of any size: quantiles.large_quantiles.
    """
    quarters = large_quantiles(rows, keys, value, [0.25, 0.75]).withColumnsRenamed({k: f"__q_{k}" for k in keys})
    spread = rows.groupBy(*keys).agg(F.stddev_pop(value).alias("__dev"))
    q = F.col("quantiles")
    return spread.join(F.broadcast(quarters), _same(keys, "__q_")).select(*keys, F.greatest(q[1] - q[0], 0.1 * F.col("__dev"), F.lit(1e-3)).alias("scale"))  # a row a group


def robust_scale(rows: DataFrame, keys: list[str], value: str = "value", least: float = 1e-6) -> DataFrame:
    """keys, location, scale: median; interquartile range, else 1.4826 times the median absolute deviation, else 1.

    Groups are few and of any size. Deviations are looked at for groups without an interquartile range alone.
    """
    q = F.col("quantiles")
    middle = large_quantiles(rows, keys, value, [0.25, 0.5, 0.75]).select(*keys, q[1].alias("location"), (q[2] - q[0]).alias("iqr"))
    flat = middle.where(F.col("iqr") <= least).select(*(F.col(k).alias(f"__f_{k}") for k in keys), F.col("location").alias("__at"))
    away = rows.join(F.broadcast(flat), _same(keys, "__f_")).select(*keys, F.abs(F.col(value) - F.col("__at")).alias("__away"))
    mads = large_quantiles(away, keys, "__away", [0.5]).withColumnsRenamed({k: f"__m_{k}" for k in keys})
    mad = 1.4826 * F.coalesce(q[0], F.lit(0.0))
    spread = F.when(F.col("iqr") > least, F.col("iqr")).when(mad > least, mad).otherwise(1.0)
    return middle.join(F.broadcast(mads), _same(keys, "__m_"), "left").select(*keys, "location", spread.alias("scale"))


def standard_scale(rows: DataFrame, keys: list[str], value: str = "value", least: float = 1e-6) -> DataFrame:
    """keys, location, scale: mean and population deviation; a deviation under the least becomes 1."""
    spread = F.stddev_pop(value)
    return rows.groupBy(*keys).agg(F.avg(value).alias("location"), F.when(spread < least, 1.0).otherwise(spread).alias("scale"))


def scaled(rows: DataFrame, scales: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """rows with value moved and divided by its location and scale."""
    return rows.join(F.broadcast(scales), keys).withColumn(value, (F.col(value) - F.col("location")) / F.col("scale")).drop("location", "scale")


def finite(value: Column) -> Column:
    """The value, or null where it is not finite: averages then leave it out."""
    value = value.cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < F.lit(float("inf"))), value)
