"""op8 by held-out accuracy and by its parts against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.llm import op8_quality as op8


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    docs, labels = [], []
    for k in range(n):
        good = k % 5 != 0
        text = " ".join(rng.choice(vocabulary) + ("" if good else rng.choice(["###", "&&&", "!!"])) for _ in range(rng.randint(5, 60)))
        docs.append((k, text, "en", "s", 0))
        labels.append((k, int(good)))
    return docs, labels


def test_held_out(table, spark):
    docs, labels = corpus()
    docs += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "w1 w2 w3", "en", "s", 0), docs[3]]
    train = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int")
    extra = train.withColumn("toxic", F.lit(0)).unionByName(spark.createDataFrame([(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int"))
    got = op8.classify(table(docs), extra).collect()
    assert len(got) == len(docs)
    truth = dict(labels)
    held = [(r.keep, truth[r.doc_id]) for r in got if r.doc_id in truth and r.doc_id % 2 == 0]
    assert np.mean([k == bool(t) for k, t in held]) > 0.97
    assert {r.log_weight for r in got if r.doc_id in (900, 901)} == {0.0}
    kept = sorted((r.key for r in got), reverse=True)[: sum(r.passes for r in got)]
    assert sum(r.keep for r in got) == len(kept) and min(r.key for r in got if r.keep) == kept[-1]


def test_weights_leave_a_document_out_of_its_models():
    rng = np.random.default_rng(0)
    bucket, row = rng.integers(0, 40, 300), np.sort(rng.integers(0, 6, 300))
    good = np.array([True, False, True, False, True, True])
    counts = np.zeros((2, op8.BUCKETS), dtype=float)
    np.add.at(counts[0], bucket, 1)
    np.add.at(counts[1], bucket[good[row]], 1)
    counts[0, :40] += 5
    weight, n = op8.log_weights(bucket, row, good, counts)
    for r in range(6):
        total = 0.0
        for b in set(bucket[row == r]):
            c = int(((bucket == b) & (row == r)).sum())
            target = counts[1, b] - (c if good[r] else 0) + op8.SMOOTH
            raw = (counts[0, b] - c) * counts[1].sum() / counts[0].sum() + op8.SMOOTH
            ratio = math.log(target / raw)
            total += c * math.copysign(max(0.0, abs(ratio) - op8.DOUBT * math.sqrt(1 / target + 1 / raw)), ratio)
        assert weight[r] == pytest.approx(total) and n[r] == (row == r).sum()


def test_grams_split_words_and_punctuation():
    data, offsets = np.frombuffer("a b!!a b!!é".encode(), dtype=np.uint8), np.array([0, 5, 12])
    bucket, row = op8.grams(data, offsets)
    assert np.bincount(row).tolist() == [5, 7] and set(bucket[row == 0]) <= set(bucket[row == 1])


def test_kth_largest(spark):
    rng = np.random.default_rng(3)
    values = np.r_[rng.normal(size=3000), np.full(500, 0.25), -1e9, 1e9]
    frame = spark.createDataFrame([(float(v),) for v in values], "key double")
    for k in (1, 2, 700, 1500, len(values)):
        assert op8._kth_largest(frame, k, few=50) == pytest.approx(np.sort(values)[::-1][k - 1], abs=1e-6)


def test_no_labels_and_no_rows(table, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    docs, labels = corpus(20)
    assert all(r.keep for r in op8.classify(table(docs), none).collect())
    assert op8.classify(table([]), spark.createDataFrame(labels, "doc_id long, quality int")).count() == 0
