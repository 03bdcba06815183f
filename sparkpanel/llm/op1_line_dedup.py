"""Line dedup: lines that spread over many sites are boilerplate.

Per line (128-bit hash of its trimmed text) a HyperLogLog sketch of the sites is merged by aggregation. Lines whose
estimate is far above the threshold are boilerplate, lines far below are not; lines in between get an exact distinct
count. A boilerplate line stays in the document of least id that has it, and goes everywhere else. DataFrame functions
only.

Defined results: null text stays null (no lines); blank lines are never boilerplate; a null source is a site of its own;
rows without doc_id count as sites, but keep their lines; doc_id is a key, and a row repeated whole is returned as often
as it comes; other columns are kept by line_dedup and ignored by the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session

SITES = 10
LOG_BUCKETS = 12
BAND = 0.25  # a sketch of 2**12 buckets has a standard error of 1.6 hundredths; the band is fifteen of them


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _lines(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    lines = lines.select("doc_id", "site", "at", _trimmed(F.col("line")).alias("line")).where("line <> ''")
    return lines.select("doc_id", "site", "at", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def boilerplate(docs: DataFrame, sites: int = SITES, band: float = BAND) -> DataFrame:
    """h1, h2 (line), keeper (least doc_id that has it) of lines that at least so many sites have."""
    lines = _lines(docs)
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS)).alias("sketch"), F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("keeper"))
    spread = spread.where(F.col("n") >= F.floor(F.lit(sites * (1 - band))))  # fewer lines than that can't have the sites
    spread = session.written(spread.select("h1", "h2", "keeper", F.hll_sketch_estimate("sketch").alias("estimate")).where(F.col("estimate") >= sites * (1 - band)))
    near = spread.where(F.col("estimate") <= sites * (1 + band)).select(F.col("h1").alias("n1"), F.col("h2").alias("n2"))
    same = (F.col("h1") == F.col("n1")) & (F.col("h2") == F.col("n2"))
    exact = lines.join(near, same, "leftsemi").groupBy("h1", "h2").agg(F.countDistinct("site").alias("sites"), F.min("doc_id").alias("keeper"))
    return spread.where(F.col("estimate") > sites * (1 + band)).select("h1", "h2", "keeper").unionByName(exact.where(F.col("sites") >= sites).select("h1", "h2", "keeper"))


def line_dedup(docs: DataFrame, sites: int = SITES) -> DataFrame:
    """docs with their text cut, and n_lines and n_removed (long).

    docs: doc_id, text, source and any other columns; columns of the two new names are replaced.
    """
    session.prepare(docs.sparkSession)
    keys = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    found = boilerplate(keys, sites).select(F.col("h1").alias("b1"), F.col("h2").alias("b2"), "keeper")
    hits = _lines(keys).join(found, (F.col("h1") == F.col("b1")) & (F.col("h2") == F.col("b2"))).where("doc_id <> keeper")
    gone = hits.groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set(F.struct("at", "h1", "h2", F.lit(0).alias("line"))).alias("__gone"))
    cut = docs.join(gone, F.col("doc_id") == F.col("__doc"), "left").withColumn("__lines", F.split("text", "\n", -1))
    # what goes and what is there, in one order: a line goes if its mark stands right before it
    own = F.transform("__lines", lambda x, k: F.struct(k.alias("at"), F.xxhash64(_trimmed(x)).alias("h1"), F.xxhash64(F.lit(1), _trimmed(x)).alias("h2"), F.lit(1).alias("line")))
    cut = cut.withColumn("__order", F.when(F.col("__gone").isNotNull() & F.col("text").isNotNull(), F.array_sort(F.concat("__gone", own))))

    def stays(x: Column, k: Column) -> Column:
        before = F.get("__order", k - 1)
        return (x["line"] == 1) & ((k == 0) | ~F.coalesce((before["line"] == 0) & (before["at"] == x["at"]) & (before["h1"] == x["h1"]) & (before["h2"] == x["h2"]), F.lit(False)))

    cut = cut.withColumn("__kept", F.filter("__order", stays))
    text = F.when(F.col("__order").isNull(), F.col("text")).otherwise(F.array_join(F.transform("__kept", lambda x: F.get("__lines", x["at"])), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size("__lines")).cast("long")
    n_removed = F.when(F.col("__order").isNull(), 0).otherwise(F.size("__lines") - F.size("__kept")).cast("long")
    return cut.withColumns({"n_lines": n_lines, "n_removed": n_removed, "text": text}).drop("__doc", "__gone", "__lines", "__order", "__kept")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLE_SQL = {
    "op1_line_dedup": f"""
WITH lines AS (
  SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), trimmed AS (
  SELECT doc_id, source, pos, line, trim(line, ' ' || chr(9) || chr(13)) AS t FROM lines
), spread AS (
  SELECT t, min(doc_id) AS keeper FROM trimmed WHERE t <> ''
  GROUP BY t HAVING count(DISTINCT coalesce('s' || source, '')) >= {SITES}
), marked AS (
  SELECT d.doc_id, d.pos, d.line, s.t IS NOT NULL AND d.doc_id <> s.keeper AS gone
  FROM trimmed d LEFT JOIN spread s ON d.t = s.t
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
  FROM marked GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
}
