"""The cell table, over the driver's tables as stand-in for measured specimens.

A supplier is a specimen, its nation the patient, the line status the modality, the return flag the cell label, and
four measures of a line are markers. SQL holds the same as common table expressions for the oracles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKERS = ("quantity", "extendedprice", "discount", "tax")
KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
CELL = ("modality", "specimen_id", "cell_id")
MEASURED = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a cell: patient_id, specimen_id, modality, cell_id, cell_type and a double column for each marker."""
    return cells_of(read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier"))


def cells_of(measured: DataFrame, owners: DataFrame) -> DataFrame:
    """The cells of a table of measured rows and one that names the patient of each specimen."""
    lines = measured.select(*KEY, "l_linestatus", "l_returnflag", *(F.col(f"l_{m}").cast("double").alias(m) for m in MARKERS))
    rows = lines.join(owners.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(
        F.concat(F.lit("n"), "s_nationkey").alias("patient_id"),
        F.concat(F.lit("s"), "s_suppkey").alias("specimen_id"),
        F.col("l_linestatus").alias("modality"),
        F.concat_ws("-", *KEY).alias("cell_id"),
        F.col("l_returnflag").alias("cell_type"),
        *MARKERS,
    )


def long(wide: DataFrame, markers: tuple[str, ...] = MARKERS, name: str = "marker", value: str = "value") -> DataFrame:
    """A row for each cell and marker; every other column stays.

    A generator, not unpivot: rows stay in their partitions as Spark sees it, so that tables dealt by specimen before
    need no further exchange.
    """
    kept = [c for c in wide.columns if c not in markers]
    return wide.select(*kept, F.stack(F.lit(len(markers)), *(x for m in markers for x in (F.lit(m), F.col(m)))).alias(name, value))


CELLS_SQL = """cells AS (
  SELECT 'n' || s_nationkey AS patient_id, 's' || s_suppkey AS specimen_id, l_linestatus AS modality,
    l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS cell_id, l_returnflag AS cell_type,
    CAST(l_quantity AS DOUBLE) AS quantity, CAST(l_extendedprice AS DOUBLE) AS extendedprice,
    CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey
)"""
LONG_SQL = (
    CELLS_SQL
    + """, long AS (
  SELECT patient_id, specimen_id, modality, cell_id, cell_type, unnest(['quantity', 'extendedprice', 'discount', 'tax']) AS marker,
    unnest([quantity, extendedprice, discount, tax]) AS value FROM cells
)"""
)
