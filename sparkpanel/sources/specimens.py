"""Specimen files: cells/<id>.csv with a column a marker and labels/<id>.csv, aligned by position only.

numbered.py gives every row its place in its file, whatever the file's size; from then on row_idx is a column. Ingest
once to Parquet partitioned by modality and specimen, and read that.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import coarse_label, label_column, patient_of
from ..operators.sampling import reservoir
from . import numbered
from .bucketed import BUCKETS, bucketed


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of one CSV file."""
    return numbered.header(spark, path)


def scan(spark: SparkSession, root: str, modality: str, markers: list[str] | None = None, head: int | None = None, drop_unmapped: bool = True) -> DataFrame:
    """modality, patient_id, specimen_id, row_idx, fine_cell_type, cell_type and float markers, in the order asked for.

    head: only the first rows of each file. Rows whose label has no coarse class go unless kept.
    """
    cells_path, labels_path = f"{root}/{modality}/cells/*.csv", f"{root}/{modality}/labels/*.csv"
    names = numbered.header(spark, cells_path)
    wanted = markers or names
    if missing := sorted(set(wanted) - set(names)):
        raise ValueError(f"no such markers: {missing}")
    cells = numbered.rows(spark, cells_path, wanted).select("specimen_id", "row_idx", *(F.col(f"`{m}`").try_cast("float").alias(m) for m in wanted))
    fine = label_column(numbered.header(spark, labels_path))
    labels = numbered.rows(spark, labels_path, [fine]).select("specimen_id", "row_idx", F.trim(F.coalesce(F.col(f"`{fine}`"), F.lit(""))).alias("fine_cell_type"))
    if head is not None:
        cells, labels = cells.where(F.col("row_idx") < head), labels.where(F.col("row_idx") < head)
    rows = cells.join(labels, ["specimen_id", "row_idx"]).withColumn("cell_type", coarse_label(F.col("fine_cell_type")))
    if drop_unmapped:
        rows = rows.where("cell_type is not null")
    return rows.select(F.lit(modality).alias("modality"), patient_of(F.col("specimen_id")).alias("patient_id"), "specimen_id", "row_idx", "fine_cell_type", "cell_type", *wanted)


def row_mismatches(spark: SparkSession, root: str, modality: str) -> DataFrame:
    """specimen_id, cells, labels: specimens whose two files differ in length, or that lack one."""
    count = lambda kind: numbered.counts(spark, f"{root}/{modality}/{kind}/*.csv").withColumnRenamed("n", kind)
    both = count("cells").join(count("labels"), "specimen_id", "full_outer")
    return both.where("cells is null or labels is null or cells <> labels")


def exact_pairs(spark: SparkSession, root: str, a: str, b: str) -> DataFrame:
    """specimen_id of specimens that have cells and labels in both modalities."""
    def stems(modality: str, kind: str) -> DataFrame:
        files = spark.read.format("binaryFile").load(f"{root}/{modality}/{kind}/*.csv").select("path")
        return files.select(F.url_decode(F.regexp_extract("path", "([^/]+)\\.csv$", 1)).alias("specimen_id"))

    return stems(a, "cells").intersect(stems(a, "labels")).intersect(stems(b, "cells")).intersect(stems(b, "labels"))


def sampled(rows: DataFrame, maximum: int, seed: int | str) -> DataFrame:
    """At most so many rows of each specimen, by hash priority; the order and size of chunks play no part."""
    return reservoir(rows, ["modality", "specimen_id"], maximum, ["specimen_id", "row_idx"], seed)


def frozen_rows(counts: DataFrame, maximum: int, seeds: list[int]) -> DataFrame:
    """modality, specimen_id, seed, row_idx: the rows that every method shares, drawn from counts alone (no label is read).

    counts: modality, specimen_id, eligible_events.
    """
    keyed = counts.select("modality", "specimen_id", "eligible_events").distinct().withColumn("seed", F.explode(F.array(*(F.lit(s) for s in seeds))))
    rows = keyed.withColumn("row_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("eligible_events").cast("long") - 1)))
    from pyspark.sql import Window as W

    order = F.md5(F.concat_ws("~", "modality", "specimen_id", "row_idx", "seed"))
    ranked = rows.withColumn("__k", F.row_number().over(W.partitionBy("modality", "specimen_id", "seed").orderBy(order, "row_idx")))
    return ranked.where(F.col("__k") <= maximum).select("modality", "specimen_id", "seed", "row_idx")


def frozen_row_violations(rows: DataFrame, counts: DataFrame, maximum: int) -> DataFrame:
    """modality, specimen_id, seed, rule: rows out of bounds, repeated, of the wrong number, or not what the seed draws."""
    keys = ["modality", "specimen_id", "seed"]
    per = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("row_idx").alias("k"), F.min("row_idx").alias("low"), F.max("row_idx").alias("high"), F.sum(F.xxhash64("row_idx").cast("decimal(38,0)")).alias("sum"))
    seeds = [r[0] for r in rows.select("seed").distinct().collect()]
    again = frozen_rows(counts, maximum, seeds).groupBy(*keys).agg(F.sum(F.xxhash64("row_idx").cast("decimal(38,0)")).alias("drawn"))
    joined = per.join(counts.select("modality", "specimen_id", "eligible_events").distinct(), ["modality", "specimen_id"], "left").join(again, keys, "left")
    rule = (
        F.when(F.col("eligible_events").isNull(), "unknown_specimen")
        .when((F.col("low") < 0) | (F.col("high") >= F.col("eligible_events")), "row_out_of_bounds")
        .when(F.col("n") != F.col("k"), "row_repeated")
        .when(F.col("n") != F.least("eligible_events", F.lit(maximum)), "wrong_number_of_rows")
        .when(~F.col("sum").eqNullSafe(F.col("drawn")), "not_drawn_by_seed")
    )
    return joined.select(*keys, rule.alias("rule")).where("rule is not null")


def write_cache(rows: DataFrame, frozen: DataFrame, path: str, seed: int) -> None:
    """The frozen rows of a seed, as Parquet partitioned by modality and specimen."""
    kept = frozen.where(F.col("seed") == seed).select("modality", "specimen_id", "row_idx")
    rows.join(kept, ["modality", "specimen_id", "row_idx"], "leftsemi").write.mode("overwrite").partitionBy("modality", "specimen_id").parquet(path)


ROW = ["modality", "specimen_id", "row_idx"]


def bucketed_queries(rows: DataFrame, frozen: DataFrame, buckets: int = BUCKETS) -> Callable[[int], DataFrame]:
    """A loader of the frozen rows of a seed: both tables are bucketed by row once, so that no seed moves a cell.

    rows: ROW and what cells have; frozen: frozen_rows() of any number of seeds.
    """
    cells, drawn = bucketed(rows, ROW, buckets), bucketed(frozen, ROW, buckets)
    return lambda seed: cells.join(drawn.where(F.col("seed") == seed).select(*ROW), ROW, "leftsemi")


def read_cache(spark: SparkSession, path: str, modality: str, specimens: list[str] | None = None) -> DataFrame:
    """Cached cells; folders of other modalities and specimens are not read."""
    rows = spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", False).parquet(path).where(F.col("modality") == modality)
    return rows if specimens is None else rows.where(F.col("specimen_id").isin(specimens))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """path, sha256, bytes of the files below a path (each under 2 GB)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with a header, which an empty table has as well."""
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_files(rows: DataFrame, path: str, columns: dict[str, list[str]]) -> None:
    """<path>/<kind>/<specimen_id>.csv of each kind's columns, with a header; rows come dealt and sorted by specimen_id.

    Tasks write their specimens themselves, all kinds in one pass, batch by batch, and put a file in place when it is whole.
    Spark's own writer makes a folder, a writer and several processes a file, which takes longer than the rows.
    """
    spark = rows.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    where = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()
    where = where if "://" in where else where.replace(":/", ":///", 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(where)
        for kind in columns:
            store.create_dir(f"{root}/{kind}")
        tag, files = uuid.uuid4().hex, 0
        for specimen, parts in groupby(_runs(batches), key=lambda x: x[0]):
            opened = {}
            for _, part in parts:
                for kind, names in columns.items():
                    table = part.select(names)
                    if kind not in opened:
                        stream = store.open_output_stream(f"{root}/{kind}/.{specimen}-{tag}")
                        opened[kind] = stream, csv.CSVWriter(stream, table.schema)
                    opened[kind][1].write(table)
            for kind, (stream, writer) in opened.items():
                writer.close()
                stream.close()
                store.move(f"{root}/{kind}/.{specimen}-{tag}", f"{root}/{kind}/{specimen}.csv")
                files += 1
        yield pa.RecordBatch.from_arrays([pa.array([files], pa.int64())], names=["files"])

    needed = list(dict.fromkeys(["specimen_id", *(c for names in columns.values() for c in names)]))
    rows.select(*needed).mapInArrow(run, "files long").agg(F.sum("files")).collect()


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, pa.RecordBatch]]:
    """Slices of batches that are of one specimen, in order."""
    for batch in batches:
        ends = batch.column("specimen_id").to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(ends[1:] != ends[:-1]) + 1).tolist(), len(ends)]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low < high:
                yield ends[low], batch.slice(low, high - low)


def metadata(spark: SparkSession, path: str, patient: str, visit: str, date: str, date_format: str = "M/d/yy") -> DataFrame:
    """patient_id, visit_id (int), collection_date, specimen_id (patient_visit) of a visit table; unreadable dates are null."""
    rows = spark.read.option("header", True).csv(path)
    number = F.col(f"`{visit}`").try_cast("int") if hasattr(F.col("x"), "try_cast") else F.col(f"`{visit}`").cast("int")
    return rows.select(F.trim(F.col(f"`{patient}`")).alias("patient_id"), number.alias("visit_id"), F.try_to_date(F.trim(F.col(f"`{date}`")), date_format).alias("collection_date")).withColumn("specimen_id", F.concat_ws("_", "patient_id", "visit_id"))
