"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names, else the session's checkpoint folder; on one machine, without either, a new one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        named = tempfile.mkdtemp()
        context.setCheckpointDir(named)
    return named


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder; nothing is made there yet."""
    return f"{folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(frame: DataFrame, name: str) -> DataFrame:
    """The frame, written once to a folder of its own and read back: what several plans use is made once."""
    folder_ = new_folder(frame.sparkSession, name)
    frame.write.parquet(folder_)
    return frame.sparkSession.read.schema(frame.schema).parquet(folder_)
