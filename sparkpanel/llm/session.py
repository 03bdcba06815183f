"""Session plumbing shared by the operators: shared folders, Arrow batch bounds, table reading."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


BATCH_BYTES = 4 << 20


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes (so that long texts fit a worker) and sees that checkpoint() has a folder.

    The folder is the one that the cluster names in spark.checkpoint.dir; a temporary one is made only on one machine
    where neither that setting nor a checkpoint folder of the session exists, as in tests. All operators bound batches
    alike, so that a result can be read after another operator was asked.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")  # shuffle files go with their query
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp())


def shared_folder(spark: SparkSession) -> str:
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()


def written(frame: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read again: cuts lineage, survives lost executors, and lets Spark
    drop the shuffle files behind it. The files go when the driver ends."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    atexit.register(_removed, spark, path)
    return spark.read.schema(frame.schema).parquet(path)


def _removed(spark: SparkSession, path: str) -> None:
    try:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        return


def dealt(frame: DataFrame, key: str) -> DataFrame:
    """The frame, dealt by another hash of its key. A join that follows deals both of its sides, and only of sides that
    come straight from an exchange can Spark split a partition that a hot key has filled."""
    return frame.repartition(partitions(frame.sparkSession), F.xxhash64(key, F.lit(1)))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_and_text(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that the text operators read; other columns, whatever their names, go no further."""
    return docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
