"""Keeps a patient-balanced reference bank and the support of each specimen, as files of measured cells arrive.

    python -m jobs.specimen_bank jobs/specimen_bank.json --cells CELLS --owners OWNERS --output OUT --checkpoint MARK

A file stream with availableNow takes the files of CELLS that the checkpoint has not seen, in batches. Its state is small
and mergeable: per modality and patient the cells of least priority (no patient's quota can ask for more than the bank's
size), and the number of cells of each label of each specimen. Batch n writes OUT/held/batch=n and OUT/counted/batch=n
from those of batch n - 1 and its own files alone, so a batch that is run again after a failure writes the same. When the
stream has ended, the last state is published:

    OUT/bank/modality=M      at most `size` cells: patients in equal quotas, then a trim at random (sampling.balanced_bank)
    OUT/support/modality=M   modality, patient, specimen, label: cells delivered so far

Both are made anew from the state on every run, so a run that failed in between is mended by the next. A bank over files
that came one by one is the bank over all of them at once: priorities depend on a cell's key only.

Defined results: a cell delivered twice is in the bank once (of unlike rows with one key the least) and counts twice in
the support; cells of specimens without an owner are left out; no new file: the same output again; no file at all: none.
"""

from __future__ import annotations

import logging
import sys

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobs import common
from sparkpanel.operators import sampling
from sparkpanel.sources.cells import MARKERS, MEASURED, cells_of

log = logging.getLogger("jobs.specimen_bank")
GROUP = ["modality", "patient_id"]
KEY = ["specimen_id", "cell_id"]
VALUES = ["cell_type", *MARKERS]
LABELS = [*GROUP, "specimen_id", "cell_type"]


def least_cells(cells: DataFrame, size: int, seed: str) -> DataFrame:
    """The `size` cells of least priority of each modality and patient, each once. Ranks are cut before the shuffle."""
    place = F.dense_rank().over(W.partitionBy(*GROUP).orderBy(sampling.priority(KEY, seed), *KEY))
    near = cells.select(*GROUP, *KEY, *VALUES).withColumn("place", place).where(F.col("place") <= size)
    once = near.groupBy(*GROUP, *KEY).agg(F.min(F.struct(*VALUES)).alias("least"))
    return once.select(*GROUP, *KEY, "least.*")


def support(cells: DataFrame) -> DataFrame:
    return cells.groupBy(*LABELS).agg(F.sum("n").alias("n"))


def _write(rows: DataFrame, path: str, by: str, mode: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(by).parquet(path)


def _state(spark: SparkSession, path: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{path}/batch={batch}")


def take(spark: SparkSession, rows: DataFrame, batch: int, owners: DataFrame, output: str, size: int, seed: str) -> None:
    """The state after this batch, from the state before it and the batch's rows."""
    cells = cells_of(rows, owners).select(*GROUP, *KEY, *VALUES).persist()  # both states read the batch; what a lost executor held is read again
    try:
        held, counted = cells, cells.select(*LABELS, F.lit(1).cast("long").alias("n"))
        if batch:
            held = held.unionByName(_state(spark, f"{output}/held", batch - 1))
            counted = counted.unionByName(_state(spark, f"{output}/counted", batch - 1))
        _write(least_cells(held, size, seed).withColumn("batch", F.lit(batch)), f"{output}/held", "batch", "dynamic")
        _write(support(counted).withColumn("batch", F.lit(batch)), f"{output}/counted", "batch", "dynamic")
    finally:
        cells.unpersist()
    log.info("batch %d: %d cells held, %d counts", batch, _state(spark, f"{output}/held", batch).count(), _state(spark, f"{output}/counted", batch).count())


def publish(spark: SparkSession, output: str, batch: int, size: int, seed: str) -> dict:
    bank = sampling.balanced_bank(_state(spark, f"{output}/held", batch), "patient_id", size, KEY, seed, within=["modality"])
    _write(bank, f"{output}/bank", "modality", "static")
    _write(_state(spark, f"{output}/counted", batch), f"{output}/support", "modality", "static")
    wrote = {"bank": spark.read.parquet(f"{output}/bank").count(), "support": spark.read.parquet(f"{output}/support").count()}
    log.info("wrote %s/bank: %d rows, %s/support: %d rows, state of batch %d", output, wrote["bank"], output, wrote["support"], batch)
    return wrote


def file_or_folder(path: str) -> str:
    """The path as a pattern that it alone matches: a file stream takes a single file only by a pattern."""
    path = path.rstrip("/")
    return path if set(path) & set("*?[{") else f"{path[:-1]}[{path[-1]}]"


def run(spark: SparkSession, cells: str, owners: str, output: str, checkpoint: str, size: int = 2000, seed: str = "17", files_per_batch: int = 64) -> dict:
    """Takes what is new at cells and publishes; the numbers of batches and rows read, and of rows written."""
    known = spark.read.parquet(owners)
    rows = spark.readStream.schema(MEASURED).option("maxFilesPerTrigger", files_per_batch).parquet(file_or_folder(cells))
    last = {"batch": -1}

    def each(batch_rows: DataFrame, batch: int) -> None:
        take(spark, batch_rows, batch, known, output, size, seed)
        last["batch"] = batch

    query = rows.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    read = sum(p["numInputRows"] for p in query.recentProgress)
    log.info("read %d new rows of %s, owners %s", read, cells, owners)
    if last["batch"] < 0:  # nothing new: what is published follows from the last state, if there is one
        try:
            last["batch"] = spark.read.parquet(f"{output}/counted").agg(F.max("batch")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            return {"batch": -1, "read": read, "bank": 0, "support": 0}
    return {"batch": last["batch"], "read": read} | publish(spark, output, last["batch"], size, seed)


def result(spark: SparkSession, output: str) -> DataFrame:
    """The published bank, each cell with the number of cells of its specimen and of its label there."""
    counts = spark.read.parquet(f"{output}/support")
    specimen = counts.groupBy("modality", "specimen_id").agg(F.sum("n").alias("specimen_cells"))
    label = counts.select("modality", "specimen_id", "cell_type", F.col("n").alias("label_cells"))
    return spark.read.parquet(f"{output}/bank").join(specimen, ["modality", "specimen_id"]).join(label, ["modality", "specimen_id", "cell_type"]).select(*GROUP, *KEY, *VALUES, "specimen_cells", "label_cells")


PATHS = {"cells": "folder of Parquet files of measured cells, which grows (or one file)", "owners": "table of specimens and patients", "output": "folder of the bank", "checkpoint": "folder of the stream's checkpoint"}

if __name__ == "__main__":
    sys.exit(common.main("specimen_bank", __doc__, PATHS, run))
