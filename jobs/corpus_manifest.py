"""Freezes a corpus before an experiment: which document belongs to which fold, and which must not be used.

    python -m jobs.corpus_manifest jobs/corpus_manifest.json --documents DOCS --labels LABELS --output OUT

The same care that keeps a patient out of two roles, for texts: a source is a patient, a document a specimen. Sources go
to folds in hash order (splits.hashed_folds), so that no source is in two. Texts have digests; a text that several
documents have belongs to the fold of the least doc_id that has it, and its copies in other folds are left out, so that
no text is in two folds either. Every document gets a row and a status:

    OUT/manifest/fold=F   doc_id, source, lang, digest (SHA-256), n_chars, copy_of, status, quality, toxic
    OUT/audit/fold=F      source, lang: documents, used, labelled, good and toxic ones, characters, bundle

status is the first that holds: unnamed (no doc_id), no_text (null, or nothing but white space), leaks (a copy whose text
belongs to another fold), copy (of the same fold), conflict (its labels differ), labelled, unlabelled. used counts the
last two. bundle is a digest of a source's texts whatever their order: the sum of 60 bits of each digest, so that a
changed, lost or added document shows.

Outputs are overwritten whole and follow from the inputs alone: a run that is repeated writes the same.

Defined results: null source and lang are the empty string; null text counts no characters and has a null digest; rows
that share a doc_id are judged each for itself, with the same labels; several rows of one label with the same values are
one label; labels of no document are ignored; empty tables give empty outputs.
"""

from __future__ import annotations

import logging
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from sparkpanel.operators import splits

log = logging.getLogger("jobs.corpus_manifest")
MANIFEST = ["fold", "doc_id", "source", "lang", "digest", "n_chars", "copy_of", "status", "quality", "toxic"]
BLANK = r"^[ \t\n\x0B\f\r]*$"


def placed(documents: DataFrame, folds: int, seed: str) -> DataFrame:
    """documents with the fold that tests their source. The table of sources is small; documents meet it once."""
    sources = documents.select(F.col("source").alias("patient_id"), F.col("source").alias("specimen_id"))
    tested = splits.hashed_folds(sources, folds, seed).where("role = 'test'").select(F.col("patient_id").alias("of"), "fold")
    return documents.join(tested, F.col("source") == F.col("of")).drop("of")


def first_copies(documents: DataFrame) -> DataFrame:
    """Of texts that several documents have: digest, the least doc_id and its fold. Counted before they are shuffled."""
    named = documents.where("doc_id is not null and digest is not null")
    copies = named.groupBy(F.col("digest").alias("text")).agg(F.min(F.struct("doc_id", "fold")).alias("first"), F.count(F.lit(1)).alias("n"))
    return copies.where("n > 1").select("text", F.col("first.doc_id").alias("copy_of"), F.col("first.fold").alias("home"))


def labelled(labels: DataFrame) -> DataFrame:
    """One row a doc_id: its labels, and whether rows disagree about them."""
    agreed = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("label_of"))
    return agreed.agg(F.min("quality").alias("quality"), F.min("toxic").alias("toxic"), ((F.min("quality") != F.max("quality")) | (F.min("toxic") != F.max("toxic"))).alias("conflict"))


def manifest(documents: DataFrame, labels: DataFrame, folds: int, seed: str) -> DataFrame:
    rows = documents.select("doc_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "lang")), F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), (F.col("text").isNull() | F.col("text").rlike(BLANK)).alias("blank"))
    rows = placed(rows, folds, seed)
    rows = rows.join(first_copies(rows), F.col("digest") == F.col("text"), "left").join(labelled(labels), F.col("doc_id") == F.col("label_of"), "left")
    copied = F.col("copy_of") != F.col("doc_id")
    status = (
        F.when(F.col("doc_id").isNull(), "unnamed")
        .when(F.col("blank"), "no_text")
        .when(copied & (F.col("home") != F.col("fold")), "leaks")
        .when(copied, "copy")
        .when(F.col("conflict"), "conflict")
        .when(F.col("label_of").isNotNull(), "labelled")
        .otherwise("unlabelled")
    )
    return rows.withColumn("status", status).select(*MANIFEST)


def audit(rows: DataFrame) -> DataFrame:
    """A row a fold, source and language."""
    used = F.col("status").isin("labelled", "unlabelled")
    piece = F.conv(F.substring("digest", 1, 15), 16, 10).cast("decimal(20,0)")
    count = lambda x: F.count(F.when(x, 1))
    return rows.groupBy("fold", "source", "lang").agg(
        F.count(F.lit(1)).alias("documents"),
        count(used).alias("used"),
        count(F.col("status") == "labelled").alias("labelled"),
        count((F.col("status") == "labelled") & (F.col("quality") == 1)).alias("good"),
        count((F.col("status") == "labelled") & (F.col("toxic") == 1)).alias("toxic"),
        F.sum("n_chars").alias("n_chars"),
        F.coalesce(F.sum(piece), F.lit(0)).cast("string").alias("bundle"),
    )


def _write(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("fold").parquet(path)


def run(spark: SparkSession, documents: str, labels: str, output: str, folds: int = 5, seed: str = "23") -> dict:
    """Writes manifest and audit; the numbers of rows read and written."""
    docs, known = (spark.read.parquet(path).select(*columns) for path, columns in ((documents, ("doc_id", "text", "lang", "source")), (labels, ("doc_id", "quality", "toxic"))))
    rows = manifest(docs, known, folds, seed)
    _write(rows, f"{output}/manifest")
    frozen = spark.read.schema(rows.schema).parquet(f"{output}/manifest")
    sums = audit(frozen)
    _write(sums, f"{output}/audit")
    made = spark.read.schema(sums.schema).parquet(f"{output}/audit")
    used = frozen.where(F.col("status").isin("labelled", "unlabelled"))
    wrote = {"manifest": frozen.count(), "used": used.count(), "labels": known.count(), "audit": made.count()}
    log.info("read %s and %d rows of %s; wrote %s/manifest: %d rows, %d of them used, %s/audit: %d rows", documents, wrote["labels"], labels, output, wrote["manifest"], wrote["used"], output, wrote["audit"])
    return wrote


def result(spark: SparkSession, output: str) -> DataFrame:
    """Both outputs in one table: part is manifest or audit."""
    rows, sums = spark.read.parquet(f"{output}/manifest"), spark.read.parquet(f"{output}/audit")
    return rows.select(F.lit("manifest").alias("part"), *MANIFEST).unionByName(sums.select(F.lit("audit").alias("part"), *sums.columns), allowMissingColumns=True)


PATHS = {"documents": "table of documents", "labels": "table of their labels", "output": "folder of manifest and audit"}

if __name__ == "__main__":
    sys.exit(common.main("corpus_manifest", __doc__, PATHS, run))
