"""op3 and op10 against brute force over every window."""

import hashlib
import random
import re

import numpy as np
import pytest

from sparkpanel.llm import op3_substring_dedup as op3
from sparkpanel.llm import op10_suffix_dedup as op10
from sparkpanel.llm import suffixes


def brute_words(rows, window):
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    first = {}
    for d, w in split:
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return sorted(out)


def brute_bytes(rows, window):
    count = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for _, b in raw:
        for i in range(len(b) - window + 1):
            count[b[i : i + window]] = count.get(b[i : i + window], 0) + 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if count[b[i : i + window]] > 1:
                gone[i : i + window] = b"\1" * window
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, g in zip(b, gone) if not g)))
    return sorted(out)


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_words(table, awkward, crowd):
    got = op3.substring_dedup(table(awkward), crowd=crowd)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute_words([r[:2] for r in awkward], op3.WINDOW)


@pytest.mark.parametrize("crowd", [10_000, 1])
def test_bytes(table, awkward, crowd):
    got = op10.suffix_dedup(table(awkward), crowd=crowd)
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()) == brute_bytes([r[:2] for r in awkward], op10.WINDOW)


@pytest.mark.parametrize("seed", range(4))
def test_small_windows_over_small_alphabets(table, seed):
    rng = random.Random(seed)
    data = [(k, "".join(rng.choice("ab \n") for _ in range(rng.choice([0, 5, 30, 200]))), "en", "s", 0) for k in range(12)]
    rows = [r[:2] for r in data]
    got = op3.substring_dedup(table(data), window=5, gram=2)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute_words(rows, 5)
    got = op10.suffix_dedup(table(data), window=9, gram=4)
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()) == brute_bytes(rows, 9)


def test_empty_table_and_missing_ids(table, spark, awkward):
    assert op3.substring_dedup(table([])).count() == 0
    assert op10.suffix_dedup(table([])).count() == 0
    some = [*awkward, (None, "no id " * 80, "en", "s", 0)]
    assert op3.substring_dedup(table(some)).count() == len(awkward)


def test_rows_repeated_whole(table, awkward):
    twice = awkward + awkward[4:6]
    got = {(r[0], r[2]) for r in op10.suffix_dedup(table(twice)).where("doc_id in (4, 5)").collect()}
    sizes = {r[0]: len(r[1].encode()) for r in awkward[4:6]}
    assert got == {(d, n) for d, n in sizes.items()}  # each repeats, so all of its bytes go
    assert op3.substring_dedup(table(twice)).where("doc_id = 4").selectExpr("n_removed").collect() == [(0,), (0,)]


def test_queries_hash_what_stays(spark, tmp_path, table, awkward):
    table(awkward).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r[0]: r[-1] for r in op3.op3_substring_dedup(spark, str(tmp_path)).collect()}
    assert got == {d: hashlib.sha256(k.encode()).hexdigest() for d, *_, k in brute_words([r[:2] for r in awkward], op3.WINDOW)}


def test_deep_shallow_order_and_common_prefixes():
    rng = np.random.default_rng(1)
    for width in (3, 48, 50, 90):
        strings = rng.integers(0, 2, (200, width)).astype(np.uint8)
        strings[rng.integers(0, 200, 120), :] = strings[0]
        strings[rng.integers(0, 200, 40), -1] = 9
        bucket = rng.integers(0, 3, 200)
        order, shared = suffixes.deep_shallow(bucket, strings)
        rows = [(bucket[i], strings[i].tobytes()) for i in order]
        assert rows == sorted(rows)
        for k in range(200):
            if k == 0 or rows[k][0] != rows[k - 1][0]:
                assert shared[k] == -1
            else:
                assert shared[k] == suffixes.common(rows[k - 1][1], rows[k][1])


def thue_morse(n, first, second):
    return "".join((first, second)[bin(k).count("1") % 2] for k in range(n))


def test_units_that_share_rolling_hashes(table):
    """Recursive texts of two symbols, which polynomial hashes modulo 2**64 do not tell apart."""
    one, other = thue_morse(512, "J", "R"), thue_morse(512, "R", "J")
    rows = [(k, "mynbiqpmz jplsg" + t + "qejeydtzirwztej") for k, t in enumerate((one, other))]
    got = op10.suffix_dedup(table([(*r, "en", "s", 0) for r in rows]))
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()) == brute_bytes(rows, op10.WINDOW)
    words_before = " ".join(f"w{k}" for k in range(49))
    rows = [(0, f"{words_before} {thue_morse(1024, 'a', 'b')}"), (1, f"{words_before} {thue_morse(1024, 'b', 'a')}")]
    got = op3.substring_dedup(table([(*r, "en", "s", 0) for r in rows]))
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute_words(rows, op3.WINDOW)


@pytest.mark.parametrize("crowd", [2, 40, 100_000])
def test_a_seed_of_many_unlike_units(table, crowd):
    """One phrase, shorter than a window, in many documents; some share more around it, some all of a window."""
    rng = random.Random(5)
    phrase = "all rights reserved by the owners of this very page, as ever"
    sides = ["".join(rng.choice("abcdefgh ") for _ in range(160)) for _ in range(12)]
    texts = []
    for k in range(300):
        own = "".join(rng.choice("ijklmnop ") for _ in range(120))
        left, right = (rng.choice(sides)[-rng.choice([0, 30, 90, 139, 140, 160]) :], rng.choice(sides)[: rng.choice([0, 30, 90, 139, 140, 160])]) if k % 3 else ("", "")
        texts.append(own + left + phrase + right + own[::-1])
    rows = list(enumerate(texts))
    data = [(*r, "en", "s", 0) for r in rows]
    got = op10.suffix_dedup(table(data), crowd=crowd)
    want = brute_bytes(rows, op10.WINDOW)
    assert sorted((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got.collect()) == want and 0 < sum(r[2] for r in want) < sum(r[1] for r in want)
    got = op3.substring_dedup(table(data), window=7, gram=3, crowd=crowd)
    assert sorted(tuple(r)[:4] for r in got.collect()) == brute_words(rows, 7)


def test_texts_without_an_id_are_witnesses_of_bytes(table):
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(260))
    rows = [(1, "x" + passage + "y"), (None, "z" + passage), (2, "none of it"), (None, None)]
    got = {r[0]: r[2] for r in op10.suffix_dedup(table([(*r, "en", "s", 0) for r in rows])).collect()}
    assert got == {1: 260, 2: 0}


@pytest.mark.parametrize("crowd", [1, 128])
def test_words_made_to_share_a_code(table, crowd):
    """Anchors are made of codes, which words can be made to share; what repeats is told by the words."""
    from sparkpanel.llm import arrays

    same = [b"DFU6ciZ6collides", b"jeQxszaFupx32HB1", b"sWDshl0Y{^V,4Aem"]
    data = np.frombuffer(b"".join(same), dtype=np.uint8)
    assert len(set(arrays.word_codes(data, np.array([0, 16, 32]), np.array([16, 32, 48])).tolist())) == 1
    head, tail = " ".join(f"w{k}" for k in range(49)), " ".join(f"t{k}" for k in range(60))
    texts = [f"{head} {w.decode()} {tail[:30]}" for w in same] + [f"{head} {same[1].decode()}", f"x {same[0].decode()} {tail}", f"y {same[2].decode()} {tail}"]
    got = {r.doc_id: r.n_removed for r in op3.substring_dedup(table([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)]), crowd=crowd).collect()}
    assert got == {d: gone for d, _, gone, _ in brute_words(enumerate(texts), 50)}
    assert [got[k] for k in range(4)] == [0, 0, 0, 50]
