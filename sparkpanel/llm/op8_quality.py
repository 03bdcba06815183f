"""Quality classifier by importance resampling.

Hashed n-grams (runs of word characters, runs of punctuation, and pairs of either; a token said twice running is one
n-gram, whatever the token, as stuttering tells more of quality than of words) are counted over the whole raw table and over the good documents of a labelled sample; a document's log weight is the sum of
log(p_target / p_raw) over its n-grams. Gumbel noise on the log weights turns the k largest into a weighted sample
without replacement; k is the number of documents whose weight passes a threshold fitted on the labelled sample.

Defined results: null or empty text has no n-grams and the log weight 0; unlabelled documents are scored like others;
with no labelled document of either kind everything is kept; null or repeated doc_ids are scored like any other row;
rows tied at the cutoff all stay; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import arrays as A
from . import session

U = np.uint64
BUCKETS = 1 << 16
SAMPLE = 20_000  # labelled documents that the target model and the threshold are fitted on, at most
COST = 5.0  # a share of the good documents lost counts as so many times that share of the bad ones kept
SMOOTH = 1.0  # added to every bucket of both models
DOUBT = 2.0
SEED = 20_261_126

KIND = np.full(256, 2, dtype=np.uint8)  # 0 space, 1 word, 2 punctuation
KIND[[0x20, *range(0x09, 0x0E)]] = 0
KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), 0x5F, *range(0x80, 0x100)]] = 1


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all unigrams and bigrams of a block, and the row of each."""
    kind = KIND[data]
    cut = np.zeros(len(data) + 1, dtype=bool)
    cut[offsets] = True
    turn = np.r_[True, kind[1:] != kind[:-1], True][: len(data) + 1] | cut
    edges = np.flatnonzero(turn)
    starts, ends = edges[:-1], edges[1:]
    some = kind[starts] > 0 if len(starts) else np.zeros(0, dtype=bool)
    starts, ends = starts[some], ends[some]
    codes = A.word_codes(data, starts, ends)
    row = np.searchsorted(offsets, starts, side="right") - 1
    pair = np.flatnonzero(row[1:] == row[:-1])
    first, second = codes[:-1][pair], codes[1:][pair]
    pairs = np.where(first == second, U(1), A.mix(first * U(0x9E3779B97F4A7C15) + second))  # one bucket for any token said twice
    return (np.r_[codes, pairs] % U(BUCKETS)).astype(np.int64), np.r_[row, row[:-1][pair]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        good = np.array([q == 1 for q in batch.column("quality").to_pylist()], dtype=bool)
        data, offsets = A.utf8(batch.column("text"))
        for a, b in A.blocks(offsets):
            bucket, row = grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            total[0] += np.bincount(bucket, minlength=BUCKETS)
            total[1] += np.bincount(bucket[good[a:b][row]], minlength=BUCKETS)
    at = np.flatnonzero(total[0])
    yield pa.RecordBatch.from_pydict({"bucket": at.astype(np.int32), "raw": total[0][at], "good": total[1][at]})


def log_weights(bucket: np.ndarray, row: np.ndarray, good: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row the sum of log(p_target / p_raw) and the number of n-grams; counts: raw and target, by bucket.

    A document's own n-grams are taken out of both models first, so that a document with a label and one without are
    weighed alike. Both models are smoothed by as much, in units of the target model, and a log ratio counts only as
    far as it passes DOUBT standard errors, so that rare n-grams, and copies of which some happen to have labels, weigh
    nothing.
    """
    key, n = np.unique(row * BUCKETS + bucket, return_counts=True)
    own, at = key // BUCKETS, key % BUCKETS
    scale = counts[1].sum() / max(1.0, counts[0].sum())
    target = counts[1][at] - np.where(good[own], n, 0) + SMOOTH
    raw = (counts[0][at] - n) * scale + SMOOTH
    ratio = np.log(target / raw)
    ratio = np.sign(ratio) * np.maximum(np.abs(ratio) - DOUBT * np.sqrt(1 / target + 1 / raw), 0)
    return np.bincount(own, n * ratio, minlength=len(good)), np.bincount(own, n, minlength=len(good)).astype(np.int64)


def _weights(counts: np.ndarray, carried: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = np.array([q == 1 for q in batch.column("quality").to_pylist()], dtype=bool)
            data, offsets = A.utf8(batch.column("text"))
            parts = [log_weights(*grams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]), good[a:b], counts) for a, b in A.blocks(offsets)]
            weight, n = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(n.astype(np.int64)), batch.column("quality"), *(batch.column(c) for c in carried)], names=["doc_id", "log_weight", "n_grams", "quality", *carried])

    return run


def threshold(weight: np.ndarray, good: np.ndarray) -> float:
    """The cut with the greatest share of bad rejected less COST times the share of good lost; in the middle of its gap."""
    order = np.argsort(weight, kind="stable")
    w, g = weight[order], good[order]
    lost, caught = np.r_[0, np.cumsum(g)] / g.sum(), np.r_[0, np.cumsum(~g)] / (~g).sum()
    at = int(np.argmax(caught - COST * lost))
    return float(w[0] - 1 if at == 0 else w[-1] + 1 if at == len(w) else (w[at - 1] + w[at]) / 2)


def _kth_largest(keys: DataFrame, k: int, rounds: int = 12, few: int = 10_000) -> float:
    """The k-th largest key, by counts over ever narrower ranges; what reaches the driver is bounded."""
    low, high = keys.agg(F.min("key"), F.max("key")).first()
    for _ in range(rounds):
        inside = keys.where((F.col("key") >= low) & (F.col("key") <= high))
        if high <= low or inside.limit(few + 1).count() <= few:
            break
        width = (high - low) / 1024
        counts = sorted(((int(r[0]), int(r[1])) for r in inside.groupBy(F.least(F.floor((F.col("key") - low) / width), F.lit(1023)).cast("int")).count().collect()), reverse=True)
        for bucket, n in counts:
            if k <= n:
                break
            k -= n
        low, high = low + bucket * width, high if bucket == 1023 else low + (bucket + 1) * width
        high = float(np.nextafter(high, -np.inf)) if bucket != 1023 else high
    found = sorted((r[0] for r in keys.where((F.col("key") >= low) & (F.col("key") <= high)).orderBy(F.desc("key")).limit(few).collect()), reverse=True)
    return found[min(k, len(found)) - 1] if found else low


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, log_weight, n_grams, passes (weight over the threshold), key (log weight and noise), keep, and the columns
    of docs that carry names (text among them, if it is to stay).

    docs: doc_id, text. labels: doc_id, quality (1 good, 0 bad); of these a sample of bounded size is used, chosen by
    a hash of the id.
    """
    spark = docs.sparkSession
    session.prepare(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("labelled"), F.col("quality").cast("int").alias("quality")).where("labelled is not null and quality in (0, 1)")
    known = known.groupBy("labelled").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("labelled", F.lit(seed)), "labelled").limit(sample)
    known = spark.createDataFrame([tuple(r) for r in known.collect()], "labelled long, quality int")  # sample rows at most
    rest = {f"__c{k}": c for k, c in enumerate(carry) if c != "text"}
    kinds = {name: docs.schema[c].dataType.simpleString() for name, c in rest.items()}
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *(F.col(f"`{c}`").alias(name) for name, c in rest.items()))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("labelled"), "left").select("doc_id", "text", "quality", *rest)
    if "text" in carry:
        kinds["text"] = "string"
    counted = rows.select("text", "quality").mapInArrow(_counts, "bucket int, raw long, good long").groupBy("bucket").agg(F.sum("raw"), F.sum("good")).collect()  # BUCKETS rows at most
    total = np.zeros((2, BUCKETS))
    for bucket, raw, good in counted:
        total[:, bucket] = raw, good
    schema = ", ".join(["doc_id long, log_weight double, n_grams long, quality int", *(f"`{c}` {kind}" for c, kind in kinds.items())])
    scored = session.written(rows.mapInArrow(_weights(total, list(kinds)), schema))
    fit = scored.where("quality is not null").groupBy("doc_id", "quality").agg(F.min("log_weight").alias("weight"))  # an id that rows share counts once: sample rows at most
    fit = np.array([(r[0], r[1]) for r in fit.select("weight", "quality").collect()]).reshape(-1, 2)
    both = len(fit) and 0 < fit[:, 1].sum() < len(fit)
    cut = threshold(fit[:, 0], fit[:, 1] == 1) if both else float("-inf")
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / float(1 << 52)
    keyed = scored.withColumn("passes", F.col("log_weight") > F.lit(cut)).withColumn("key", F.col("log_weight") - F.log(-F.log(u)))
    k = keyed.where("passes").count() if both else 0
    keep = F.col("key") >= F.lit(_kth_largest(keyed.select("key"), k) if k else float("inf")) if both else F.lit(True)
    return keyed.select("doc_id", "log_weight", "n_grams", "passes", "key", keep.alias("keep"), *(["text"] if "text" in carry else []), *(F.col(name).alias(c) for name, c in rest.items()))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(session.read(spark, sf_dir, "documents"), session.read(spark, sf_dir, "labels"))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE_SQL: dict[str, str] = {}
