"""Corpus pipeline: documents to packed token sequences, in five stages.

Each stage gets what the one before kept and returns the columns of documents; the last returns the packed pieces.
Defined results: documents without doc_id pass the quality stage by their weight, keep all their lines, are no copies of
anything, are mixed and packed; rows that share a doc_id are documents of their own unless their words are alike; null
text is kept as such until it is packed as empty; an empty table gives no pieces; columns other than those of documents
are dropped by the first stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkpanel.llm import near, op1_line_dedup, op2_mixing, op6_packing, op8_quality, op9_simhash_dedup, session

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
WORDS, REACH, SIMILAR = 5, 2, 0.8  # shingles, bits and verified Jaccard similarity of the near-duplicate stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, row by row: rows that share an id, or have none, are judged each for itself."""
    judged = op8_quality.classify(docs.select(*COLUMNS), session.read(spark, sf_dir, "labels"), carry=COLUMNS[1:])
    return judged.where("keep").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; a document that loses all of them stays, as an empty one."""
    cut = op1_line_dedup.line_dedup(docs.select(*COLUMNS))
    return cut.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of least id. Of rows alike in id and words the least stays."""
    docs = docs.select(*COLUMNS)
    found = op9_simhash_dedup.near_copies(docs, words=WORDS, reach=REACH, least=SIMILAR)
    first = session.written(found.where("first").select(F.col("doc_id").alias("__first"), F.col("code").alias("__words")).distinct())
    one = near.with_codes(docs.where("doc_id is not null")).join(first, (F.col("doc_id") == F.col("__first")) & (F.col("__code") == F.col("__words")), "leftsemi")
    one = one.withColumn("__place", F.row_number().over(W.partitionBy("doc_id", "__code").orderBy(*COLUMNS))).where("__place = 1")
    return one.select(*COLUMNS).unionByName(docs.where("doc_id is null"))


PART_BYTES = 64 << 20  # of text in a file of the mix


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict | None = None) -> DataFrame:
    """The same documents, in the order of the mix: files in order hold rows in order.

    Only places, ids and sources are ranked and scheduled; texts join their slots once and go to their files once. The
    number of files follows the bytes of text.
    """
    placed = positions(docs).select(*COLUMNS, "__position")
    mixed = op2_mixing.mix(placed.select("__position", "doc_id", "source"), weights, most=None)
    slots = session.written(mixed.select(F.col("__position").alias("__at"), "slot", "place"))
    size, last = placed.agg(F.sum(F.octet_length("text"))).first()[0], slots.agg(F.max("slot")).first()[0]
    parts = max(session.partitions(spark), -(-(size or 0) // PART_BYTES))
    part = F.least(F.floor(F.col("slot") * parts / F.lit((last or 0) + 1)), F.lit(parts - 1)).cast("int")
    joined = placed.join(slots, F.col("__position") == F.col("__at")).withColumn("__part", part)
    return joined.repartitionById(parts, "__part").sortWithinPartitions("slot", "place").select(*COLUMNS)


def positions(docs: DataFrame) -> DataFrame:
    """docs with __position: their places, from 0, in the order of files and rows. Rows that come from no files are written first."""
    part = F.regexp_extract("_metadata.file_name", r"^part-(\d+)", 1).try_cast("long")
    at = [F.struct(part, F.col("_metadata.file_path")).alias("__file"), F.col("_metadata.row_index").alias("__row")]
    try:
        numbered = docs.select("*", *at)
        numbered.schema  # resolves the columns
    except AnalysisException:
        numbered = session.written(docs).select("*", *at)
    sizes = numbered.groupBy(F.col("__file").alias("__of")).count()
    before = sizes.select("__of", (F.sum("count").over(W.orderBy("__of")) - F.col("count")).alias("__before"))  # a row a file
    return numbered.join(F.broadcast(before), F.col("__file") == F.col("__of")).withColumn("__position", F.col("__before") + F.col("__row")).drop("__file", "__row", "__of", "__before")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents, in sequences of at most 2048 tokens that follow the order of the mix."""
    import public_tokenizers

    return op6_packing.pack(positions(docs), public_tokenizers.path("byte_bpe_50k.json"), position="__position", added=True)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("SimHash near-dedup", near_duplicates), ("mixing", mixing), ("packing", packing)]
ORACLE_SQL = None  # the classifier, fingerprints, schedule and packing are beyond SQL; tests hold the stages to brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    session.prepare(spark)
    docs = session.read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = session.written(docs)
    return docs
