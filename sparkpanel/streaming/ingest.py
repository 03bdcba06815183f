"""Optional streaming front: specimen label events arrive as files and feed the same tables as batch reads.

Counts per window and label tolerate late rows up to a watermark. What keeps state between runs is a job (jobs/specimen_bank.py).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, time: str, label: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, label, n, total per tumbling window; rows later than `late` behind the newest are dropped."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, width).alias("w"), label).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("window_start"), label, "n", "total")


def append_batches(rows: DataFrame, path: str, checkpoint: str, partition_by: list[str] | None = None):
    """Starts appending to Parquet, once each, through what is there now; call awaitTermination on the result."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    return (writer.partitionBy(*partition_by) if partition_by else writer).start()
