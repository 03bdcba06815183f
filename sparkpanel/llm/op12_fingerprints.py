"""Document fingerprints: MinHash signatures of five-word shingles, compared with an edited text and the next document.

A signature is the least value of each of PERMUTATIONS universal hashes over the XXH64 codes of the shingles; numpy
permutes all codes of a strip by all hashes at once. The fingerprint holds 16 mixed bits of each least value, in hex;
the likeness of two fingerprints is the share of equal pieces, which estimates the Jaccard similarity of the shingle
sets (standard error at most 0.045). Bands of full signature values are joined in Spark, and pairs that share one are
verified by exact Jaccard similarity (near.py): near_class is the least doc_id that a document reaches over links of
similarity SIMILAR or more.

Documents go once, compressed and by ranges of doc_id, to sorted partitions. A document's successor is the next row there; the first
document of a range is copied to the range before it (that of the first range to the last), one row a range.

Defined results: null text is the empty text; words are [^\\x20\\x09-\\x0D]+ and keep their case; fewer words than a
shingle make one shingle; a text without words has all ones, is equal to others like it and unlike all else; rows
without doc_id have no place in the order and are left out; rows that share a doc_id follow each other by a hash of
their text, and one class is made of what any of them links to; the only row of a table is its own
successor; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import session
from .arrays import mix
from .near import Permutations, near_copies, shingles

WORDS, SIMILAR = 5, 0.8
PERMUTATIONS, BANDS, ROWS = 128, 25, 5  # a pair of similarity 0.8 shares none of the bands with probability 0.00005
FAMILY = Permutations(PERMUTATIONS, BANDS, ROWS)
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_class long"


def pieces(signature: np.ndarray) -> np.ndarray:
    """The fingerprint's 16 bits of each permutation."""
    return (mix(signature) >> np.uint64(48)).astype(">u2")


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    return float(np.count_nonzero(x == y) / len(x))


def signature(text: str, words: int = WORDS) -> np.ndarray:
    return FAMILY.least(shingles(text.encode("utf-8", "surrogatepass"), words, fold=False))


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many first characters of what follows, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


class Printed:
    """A document with the codes of its shingles and its signature."""

    def __init__(self, doc_id: int, text: str, words: int, near_class: int | None):
        self.doc_id, self.text, self.near_class = doc_id, text, near_class
        self.codes = shingles(text.encode("utf-8", "surrogatepass"), words, fold=False)
        self.pieces = pieces(FAMILY.least(self.codes))

    def row(self, following: Printed, words: int) -> tuple:
        text = edited(self.text, following.text)
        raw = text.encode("utf-8", "surrogatepass")
        other = pieces(FAMILY.least(shingles(raw, words, fold=False)))
        return (self.doc_id, len(self.text), sha256(raw).hexdigest(), self.pieces.tobytes().hex(), other.tobytes().hex(), likeness(self.pieces, other), likeness(self.pieces, following.pieces), self.near_class)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        packed = pa.array([squeeze(t) for t in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), packed], names=["doc_id", "mark", "packed"])


def _successive(words: int):
    names = [field.split()[0] for field in RESULT.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by range, copies from the next range last, and then in order; a row without text brings the
        class of the document that follows it."""
        part, before, near_class = None, None, (None, None)
        opened = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for at, extra, doc_id, packed, found in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "packed", "near_class")), strict=True):
                if at != part:
                    part, before = at, None
                elif extra and before is None:
                    continue  # the successor of this range is known
                if packed is None:
                    near_class = doc_id, found
                    continue
                here = Printed(doc_id, opened(packed).decode(), words, near_class[1] if near_class[0] == doc_id else None)
                if before is not None:
                    rows.append(before.row(here, words))
                before = None if extra else here
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    return run


def in_order(docs: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """docs (doc_id, text) in ranges (part) of ascending doc_id, sorted within; extra rows are the first of the next range.

    classes (doc_id, near_class) are dealt by the same ranges, so that they meet their documents without a join.
    """
    spark = docs.sparkSession
    n = session.partitions(spark)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)] or [0.5], 100 * n)).first()[0] or []
    splits = [-float("inf"), *sorted({float(c) for c in cuts} or {0.0}), float("inf")]
    ranges = Bucketizer(splits=splits, inputCol="__at", outputCol="__part")

    def dealt(frame: DataFrame, *columns: str) -> DataFrame:
        return ranges.transform(frame.withColumn("__at", F.col("doc_id").cast("double"))).select("doc_id", *columns, F.col("__part").cast("int").alias("part"))

    firsts = dealt(docs).groupBy("part").agg(F.min("doc_id").alias("first"))  # a row a range
    order = W.orderBy("part")
    last = F.max("part").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    firsts = firsts.select("first", F.coalesce(F.lag("part").over(order), last).alias("before"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("mark"), "text").mapInArrow(_packed, "doc_id long, mark long, packed binary")
    copied = dealt(texts, "mark", "packed").join(F.broadcast(firsts), F.col("doc_id") == F.col("first"), "left")
    own = F.struct("part", F.lit(False).alias("extra"))
    to = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("before").alias("part"), F.lit(True).alias("extra"))))
    rows = copied.select("doc_id", "mark", "packed", F.lit(None).cast("long").alias("near_class"), F.explode(to).alias("to")).select("to.part", "to.extra", "doc_id", "mark", "packed", "near_class")
    if classes is not None:
        rows = rows.unionByName(dealt(classes, "near_class").select("part", F.lit(False).alias("extra"), "doc_id", F.lit(None).cast("long").alias("mark"), F.lit(None).cast("binary").alias("packed"), "near_class"))
    return rows.repartitionById(len(splits) - 1, "part").sortWithinPartitions("part", "extra", "doc_id", F.col("packed").isNotNull(), "mark", "packed")


def fingerprints(docs: DataFrame, classes: DataFrame | None = None, words: int = WORDS) -> DataFrame:
    """One row per document with the columns of RESULT; near_class is null without classes. docs: doc_id, text."""
    session.prepare(docs.sparkSession)
    texts = session.id_and_text(docs).where("doc_id is not null").withColumn("text", F.coalesce("text", F.lit("")))
    return in_order(texts, classes).mapInArrow(_successive(words), RESULT)


def near_classes(docs: DataFrame, words: int = WORDS, least: float = SIMILAR) -> DataFrame:
    """doc_id, near_class (least doc_id reachable over links), a row a doc_id."""
    found = near_copies(docs, words, least, FAMILY, fold=False)
    return found.groupBy("doc_id").agg(F.min("component_id").alias("near_class"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = session.read(spark, sf_dir, "documents")
    session.prepare(spark)
    return fingerprints(docs, session.written(near_classes(docs)))


QUERIES = {"op12_fingerprints": op12_fingerprints}
ORACLE_SQL: dict[str, str] = {}
