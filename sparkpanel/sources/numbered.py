"""CSV files of any size with the place of each row in its file.

Spark splits a large file and numbers nothing. Here every row is parsed once, by the task that has its split, which counts
the rows of the split as they pass; rows go to the shared folder as Parquet with their file and their split's first byte.
Where files have several splits, a running sum over the splits of a file says how many rows stand before each. So no task
sees a whole file, tables of splits are all that is summed in order, and rows of files of one split meet no join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from urllib.parse import unquote_plus

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import new_folder

NAMED = "([^/]+)\\.csv$"  # the specimen that a file is of


def _reader(spark: SparkSession, many_lines: bool):
    return spark.read.option("header", True).option("escape", '"').option("encoding", "UTF-8").option("multiLine", many_lines)


def header(spark: SparkSession, path: str) -> list[str]:
    """Column names of the first file below a path, without a byte order mark and blanks."""
    return [c.lstrip("\ufeff").strip() for c in _reader(spark, False).csv(path).columns]


def _counted(named: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a task with `specimen_id`, by the pattern and once a file, and `at`, the place of each row in its split
    (file, start); a split's rows come one after another."""
    last, passed, pattern = None, 0, re.compile(named)
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        files, starts = batch.column("file").dictionary_encode(), batch.column("start").to_numpy()
        found = [pattern.search(f) for f in files.dictionary.to_pylist()]
        codes = files.indices.to_numpy()
        first = np.concatenate([[0], np.flatnonzero((np.diff(codes) != 0) | (np.diff(starts) != 0)) + 1])
        at = np.arange(n) - np.repeat(first, np.diff(np.append(first, n)))
        name = lambda i: (files.dictionary[codes[i]].as_py(), starts[i])  # noqa: B023, E731
        if name(0) == last:
            at[: first[1] if len(first) > 1 else n] += passed
        last, passed = name(-1), int(at[-1]) + 1
        specimens = pa.array([unquote_plus(m[1]) if m else "" for m in found], pa.string()).take(files.indices)
        yield pa.RecordBatch.from_arrays([*batch.columns, specimens, pa.array(at.astype(np.int64))], names=[*batch.schema.names, "specimen_id", "at"])


def rows(spark: SparkSession, path: str, columns: list[str] | None = None, named: str = NAMED, many_lines: bool = False, header: list[str] | None = None) -> DataFrame:
    """specimen_id, row_idx (from 0, the header left out) and the columns asked for, as strings, of all files below a path.

    named: a pattern whose group is the specimen in a file's path. Fields may be quoted, quotes in them doubled. Files
    whose header is unlike the first one's raise an error; blank lines are no rows; what a short row lacks is null.
    many_lines: quoted fields may hold line ends, at the price that a file is read by one task. header: the first file's
    header, where it is known: then folders are listed once, not once more to look for it.
    """
    found = header or _reader(spark, many_lines).csv(path).columns
    names = [c.lstrip("\ufeff").strip() for c in found]
    wanted = list(columns) if columns is not None else names
    if missing := sorted(set(wanted) - set(names)):
        raise ValueError(f"no such columns: {missing}")
    raw = _reader(spark, many_lines).schema(", ".join(f"`{c.replace('`', '``')}` string" for c in found)).option("enforceSchema", False).csv(path)
    picked = [F.col(f"`{found[names.index(c)].replace('`', '``')}`").alias(f"v{k}") for k, c in enumerate(wanted)]
    place = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")]
    folder = new_folder(spark, "numbered")
    values = "".join(f", v{k} string" for k in range(len(wanted)))
    raw.select(*place, *picked).mapInArrow(partial(_counted, named), f"file string, start long{values}, specimen_id string, at long").write.parquet(folder)
    parsed, shift = spark.read.parquet(folder), F.lit(0)
    if not parsed.where("start > 0").isEmpty():
        splits = parsed.groupBy("file", "start").agg(F.count(F.lit(1)).alias("n"))
        before = F.sum("n").over(W.partitionBy("file").orderBy("start")) - F.col("n")
        splits = splits.select(F.col("file").alias("of"), F.col("start").alias("from"), before.alias("shift")).where("from > 0")
        parsed, shift = parsed.join(splits, (F.col("file") == F.col("of")) & (F.col("start") == F.col("from")), "left"), F.coalesce("shift", F.lit(0))
    return parsed.select("specimen_id", (F.col("at") + shift).alias("row_idx"), *(F.col(f"v{k}").alias(c) for k, c in enumerate(wanted)))


def counts(spark: SparkSession, path: str, named: str = NAMED) -> DataFrame:
    """specimen_id and the number of rows of its file; no column is parsed, and no header is looked for in advance."""
    files = _reader(spark, False).schema("line string").csv(path).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return files.select(F.url_decode(F.regexp_extract("file", named, 1)).alias("specimen_id"), "n")
