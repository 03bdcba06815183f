"""op11 against the definition, term by term and pair by pair."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkpanel.llm import op11_divergence as op

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=op.LEAST, top=op.TOP):
    docs = [(lang or "", source or "", TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))) for _, text, lang, source, _ in rows]
    spread, own, whole, groups = Counter(), defaultdict(Counter), defaultdict(Counter), {(lang, source) for lang, source, _ in docs}
    for lang, source, terms in docs:
        spread.update((lang, t) for t in set(terms))
        own[lang, source].update(terms)
        whole[lang].update(terms)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (of, t), n in spread.items() if of == lang and n >= least]

        def chance(counts, kept=kept):
            total = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // total for t in kept}

        apart = lambda p, q: (p - q) ** 2 // (p + q)
        sources = sorted(s for of, s in groups if of == lang)
        p, q = {s: chance(own[lang, s]) for s in sources}, chance(whole[lang])
        for s in sources:
            pair = [(sum(apart(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            term = [(apart(p[s][t], q[t]), t) for t in kept if own[lang, s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k + 1) for k, (value, item) in enumerate(found[:most])]
    return sorted(out)


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect())


def corpus():
    vocabulary = ["alpha", "Beta", "beta", "GAMMA", "été", "ÉTÉ", "naïve", "日本", "x1y", "a_b", "it's", "\U0001f600ok", "z"]
    rows = []
    for k in range(160):
        words = [vocabulary[(k * j + j * j) % len(vocabulary)] for j in range(1, 2 + k % 9)] + [f"rare{'abcdefghij'[k % 10]}"] * (k % 3)
        rows.append((k, " ".join(words), ["en", "de", None][k % 3], [None, "", "s1", "s2", "s3", "s4", "s5"][k % 7], 0))
    rows += [(200, None, "en", "silent", 0), (201, "", "en", "blank", 0), (202, "12 34 \t\n", "en", "digits", 0), (203, "only few words", "xx", "alone", 0), (204, "two of few", "yy", "a", 0), (205, None, "yy", "b", 0)]
    rows += [(300, "same row beta", "en", "s1", 0)] * 12 + [(400, "long " * 30_000 + "beta", "de", "s2", 0), (None, "beta beta", "de", "s3", 0)]
    return rows


@pytest.fixture(scope="module")
def expected():
    return brute(corpus())


def test_against_definition(table, expected):
    found = op.divergence(table(corpus()))
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "string", "string", "bigint", "int"]
    assert rows_of(found) == expected
    assert {r[2] for r in expected} == {"pair", "term"} and any(r[0] == "yy" and r[4] == 0 for r in expected) and not any(r[0] == "xx" for r in expected)


def test_chunks_and_blocks(table, expected):
    found, groups = op.postings(table(corpus()))
    for chunk, block in ((2, 3), (1, 1), (5, 2)):
        rows = op.pairs(found, groups, chunk, block).withColumn("part", F.lit("pair"))
        assert rows_of(rows) == [r for r in expected if r[2] == "pair"]


@pytest.mark.parametrize(("least", "top"), [(1, 3), (2, 1), (25, 10)])
def test_other_parameters(table, least, top):
    assert rows_of(op.divergence(table(corpus()), least, top)) == brute(corpus(), least, top)


def test_upper_bound_search_evaluates_few(spark):
    """Terms whose bucket is bounded below the tenth attained bound are not scored, and ties at the tenth are."""
    rows = [("en", "s", 0, 1, f"t{k:03d}", 1 + k // 20, 2000 * (1 + k // 20), 1000) for k in range(400)]
    frame = spark.createDataFrame(rows, "lang string, source string, g long, v long, term string, n long, p long, q long")
    best = [r.item for r in op.top_terms(frame).orderBy("rank").collect()]
    assert best == [f"t{k:03d}" for k in range(380, 390)]


def test_empty_table(table):
    assert op.divergence(table([])).count() == 0


def test_counters_are_handed_on(table, expected, monkeypatch):
    """A task that hands on its counters after each batch gives the same sums."""
    import pyarrow as pa

    def batches():
        for lang, source, text in [("en", "a", "x y x"), ("en", "b", "y"), ("en", "a", "x")]:
            yield pa.RecordBatch.from_pydict({"lang": [lang], "source": [source], "text": [text]})

    def summed():
        total = Counter()
        for batch in op._counted(batches()):
            for r in batch.to_pylist():
                total[r["lang"], r["source"], r["term"], "n"] += r["n"]
                total[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        return total

    whole = summed()
    monkeypatch.setattr(op, "HELD", 0)
    assert summed() == whole and whole["en", "a", "x", "n"] == 3 and whole["en", "a", "x", "docs"] == 2
    assert ("en", "a", None, "n") in whole
