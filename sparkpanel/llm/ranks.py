"""Ranks within groups of any size, dealt over salts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SALTS = 64
SHARE = 20_000  # rows of a group that one salt should have


def salts_for(rows: int) -> int:
    """Salts that keep a task's share of a group bounded, whatever the number of rows."""
    return max(SALTS, -(-rows // SHARE))


def ranked(rows: DataFrame, group: str, order: list[str | Column], salt_by: list[str] | Column, rank: str = "rank", salts: int = SALTS) -> DataFrame:
    """rows with their rank (from 0) within the group, null being a group too.

    A group is dealt over salts by a hash of salt_by, or by salt_by itself if that is a column of numbers from 0 to
    salts - 1; rows are ranked within (group, salt) by order, and a group's salts follow each other. No task sees more than a share of a group; what is gathered is a count per salt.
    """
    salted = rows.withColumn("__salt", salt_by if isinstance(salt_by, Column) else F.pmod(F.xxhash64(*salt_by), F.lit(salts)))
    counts = salted.groupBy(F.col(group).alias("__group"), F.col("__salt").alias("__s")).count()
    base = counts.select("__group", "__s", (F.sum("count").over(W.partitionBy("__group").orderBy("__s")) - F.col("count")).alias("__base"))
    local = salted.withColumn("__local", F.row_number().over(W.partitionBy(group, "__salt").orderBy(*order)))
    joined = local.join(base, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__salt") == F.col("__s")))
    return joined.withColumn(rank, F.col("__base") + F.col("__local") - 1).drop("__salt", "__local", "__group", "__s", "__base")
