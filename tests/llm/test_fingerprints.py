"""op12 and near.py against brute force: successors, edits, likeness against Jaccard, classes of verified pairs."""

import random
from hashlib import sha256

import numpy as np
import pytest

from sparkpanel.llm import near, session
from sparkpanel.llm import op12_fingerprints as op

from .conftest import rows, words


def grams(text, n=5):
    parts = [w for w in (text or "").encode().split()]
    return {b" ".join(parts[k : k + n]) for k in range(max(1, len(parts) - n + 1))} if parts else set()


def similar(x, y):
    return len(x & y) / len(x | y) if x | y else 1.0


def classes(texts, least=0.8):
    """Least index that each text reaches over links, by all pairs."""
    sets, label = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if similar(sets[i], sets[j]) >= least and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_rows_against_definition(spark, table, awkward):
    data = [(3 * k + 7, *r[1:]) for k, r in enumerate(awkward)]
    found = {r.doc_id: r for r in op.fingerprints(table(data)).collect()}
    assert sorted(found) == [r[0] for r in data]
    prints = {}
    for k, (doc_id, text, *_) in enumerate(data):
        text, following = text or "", data[(k + 1) % len(data)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = found[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(changed.encode()).hexdigest())
        assert r.near_edited == pytest.approx(similar(grams(text), grams(changed)), abs=0.2)
        assert r.near_next == pytest.approx(similar(grams(text), grams(following)), abs=0.2)
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint and len(r.fingerprint) == 4 * op.PERMUTATIONS
        assert r.edited_fingerprint == op.pieces(op.signature(changed)).tobytes().hex()
    assert len(set(prints.values())) >= len({frozenset(grams(t)) for t in prints})


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_successors_over_ranges(spark, table, partitions):
    """The same rows whatever the ranges; one id may fill several, ids need not be near each other or of one sign."""
    data = [(k, f"text {k} " * 5, "en", "s", 0) for k in (-(2**62), -5, 0, 1, 2, 3, 2**53, 2**53 + 1, 2**62)] + [(2, t, "en", "s", 0) for t in ("b c", "a", "a", None)] + [(None, "no id", "en", "s", 0)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
        found = sorted(tuple(r) for r in op.fingerprints(table(data)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(found) == len(data) - 1
    code = spark.createDataFrame([(t or "",) for _, t, *_ in data], "text string").selectExpr("text", "xxhash64(text) AS code").distinct()
    code = {r.text: r.code for r in code.collect()}
    order = sorted([(k, code[t or ""], (t or "").encode(), t or "") for k, t, *_ in data if k is not None])
    expected = []
    for k, (doc_id, _, _, text) in enumerate(order):
        following = order[(k + 1) % len(order)][3]
        expected.append((doc_id, len(text), sha256(op.edited(text, following).encode()).hexdigest()))
    assert [r[:3] for r in found] == sorted(expected) or sorted(r[:3] for r in found) == sorted(expected)


def test_small_tables(table):
    assert op.fingerprints(table([])).count() == 0
    assert op.near_classes(table([])).count() == 0
    (only,) = op.fingerprints(table([(4, "abcdef", "en", "s", 0)])).collect()
    assert only.edited_sha256 == sha256(b"abcabc").hexdigest() and only.near_next == 1.0


def test_likeness_estimates_jaccard():
    rng, errors = random.Random(5), []
    for share in (0.1, 0.3, 0.5, 0.7, 0.9):
        for _ in range(10):
            base = words(rng, 600).split()
            other = " ".join(base[: int(600 * share)]) + " " + words(rng, 600 - int(600 * share))
            base = " ".join(base)
            errors.append(op.likeness(*(op.pieces(op.signature(t)) for t in (base, other))) - similar(grams(base), grams(other)))
    assert np.abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def near_texts():
    rng = random.Random(11)
    texts = [None, "", "  ", "one", "one", "two words"]
    for _ in range(12):
        base = words(rng, 120).split()
        texts.append(" ".join(base))
        for changes in (1, 1, 2, 3, 9):  # an edited word breaks five shingles
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    return texts + texts[8:12] + [words(rng, 40) for _ in range(20)]


@pytest.mark.parametrize("block", [near.BLOCK, 5])
def test_classes_against_all_pairs(spark, table, block):
    texts = near_texts()
    session.prepare(spark)
    found = near.near_copies(table(rows(texts)), op.WORDS, op.SIMILAR, op.FAMILY, fold=False, block=block).collect()
    assert {r.doc_id: r.component_id for r in found} == dict(enumerate(classes(texts)))


def test_links_are_exact():
    """The prefix index against all pairs, for sets around the similarity, and in any order."""
    rng = random.Random(3)
    for least in (0.5, 0.8, 1.0):
        sets = [np.unique(np.array([rng.randrange(40) for _ in range(rng.randrange(0, 25))], dtype=np.uint64)) for _ in range(60)]
        sets += [s.copy() for s in sets[:10]] + [s[1:] for s in sets[10:40]]
        rng.shuffle(sets)
        label = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                x, y = set(sets[i].tolist()), set(sets[j].tolist())
                if similar(x, y) >= least and label[i] != label[j]:
                    a, b = label[i], label[j]
                    label = [b if v == a else v for v in label]
        found = near.links(sets, least).tolist()
        assert len(set(zip(found, label, strict=True))) == len(set(found)) == len(set(label))


def test_query(spark):
    found = op.op12_fingerprints(spark, "/root/testdata/sf0.001")
    assert found.columns[:7] == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    result = {r.doc_id: r for r in found.collect()}
    texts = {r.doc_id: r.text for r in session.read(spark, "/root/testdata/sf0.001", "documents").collect()}
    ids = sorted(texts)
    assert sorted(result) == ids
    label = classes([texts[k] for k in ids])
    assert {k: result[k].near_class for k in ids} == {k: ids[label[at]] for at, k in enumerate(ids)}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        assert result[a].edited_sha256 == sha256(op.edited(texts[a] or "", texts[b] or "").encode()).hexdigest()
