"""Tables bucketed by a join's keys, so that joins on them move nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from .shared import new_folder

BUCKETS = 64


def bucketed(frame: DataFrame, keys: list[str], buckets: int = BUCKETS, folder: str | None = None) -> DataFrame:
    """The frame, written once in buckets of its keys below a folder (by default of its own in the shared one) and read back.

    Two tables in as many buckets of the same keys join without an exchange, however often. The table's name is its own
    in the session's catalog; its files stay where they are.
    """
    spark = frame.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = folder or new_folder(spark, "bucketed")
    frame.repartition(buckets, *keys).write.format("parquet").option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)
