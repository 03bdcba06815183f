"""Connected components of an edge table, by alternating large and small stars.

Each round keeps components whole, only ever moves links towards smaller nodes, and is written to the shared
checkpoint folder; neither edges nor components reach the driver, which sees a count and a checksum per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import session


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m"))
    least = session.dealt(least, "node")  # so that a hub's links can be split over tasks
    return both.join(least, F.col("u") == F.col("node")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "node")
    linked = down.join(least, F.col("u") == F.col("node"))
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root (least node of its component) for every node of an edge; edges: u, v (long), any order, repeats allowed."""
    def written(frame: DataFrame) -> tuple[DataFrame, tuple]:
        frame = frame.checkpoint()
        mark = frame.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return frame, tuple(mark)

    now, mark = written(edges.select("u", "v").where("u <> v").distinct())
    while mark[0]:
        now, new = written(_small_star(_large_star(now)))
        if new == mark:
            break
        mark = new
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
