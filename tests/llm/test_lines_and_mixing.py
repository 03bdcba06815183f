"""op1 against DuckDB, op2 against a schedule made slot by slot."""

import collections
import math
import random
import time
from fractions import Fraction

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkpanel.llm import op1_line_dedup as op1
from sparkpanel.llm import op2_mixing as op2


def line_docs():
    rng = random.Random(3)
    common = [f"common line {k}" for k in range(4)]
    out = []
    for k in range(160):
        lines = [f"own {k} {j}" for j in range(rng.randint(0, 4))]
        lines += [c for j, c in enumerate(common) if k % (j + 2) == 0] + (["", "  "] if k % 7 == 0 else []) + ([" near \t"] if k % 12 == 0 else [])
        rng.shuffle(lines)
        out.append((k, None if k % 41 == 0 else "\n".join(lines), "en", None if k % 53 == 0 else f"src{k % 12}", 0))
    return out


def test_lines_match_sql(spark, tmp_path):
    frame = spark.createDataFrame(line_docs(), "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in op1.op1_line_dedup(spark, str(tmp_path)).collect()), key=repr)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted((tuple(r) for r in con.sql(op1.ORACLE_SQL["op1_line_dedup"]).fetchall()), key=repr)
    assert got == want and sum(r[2] for r in got) > 20


def test_lines_edges(table, spark):
    data = [(k, "same\nline" if k != 3 else None, "en", f"s{k}", 0) for k in range(15)] + [(None, "same\nelse", "en", "x", 0)]
    got = {r["doc_id"]: r["text"] for r in op1.line_dedup(table(data)).collect()}
    assert got[0] == "same\nline" and got[3] is None and got[None] == "same\nelse"
    assert all(got[k] == "" for k in range(1, 15) if k != 3)
    assert op1.line_dedup(table([])).count() == 0
    plan = op1.line_dedup(table(data))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def ideal(blocks, weights, at):
    """Blocks of each source at slot `at`, by phases: all that have some left share by weight until one has none."""
    left, now, got = dict(blocks), Fraction(0), dict.fromkeys(blocks, Fraction(0))
    while left and now < at:
        whole = sum(weights[s] for s in left)
        step = min(min(n * Fraction(whole, weights[s]) for s, n in left.items()), at - now)
        for s in left:
            got[s] += step * Fraction(weights[s], whole)
        left = {s: blocks[s] - got[s] for s in left if got[s] < blocks[s]}
        now += step
    return got


def when(blocks, weights, source, j):
    """The slot at which the source has j blocks: all have a part a * v of theirs, or all of them."""
    v = Fraction(j, weights[source])
    return sum(min(weights[s] * v, Fraction(n)) for s, n in blocks.items())


def schedule(total, weights, block):
    """Slot by slot, from the definition of release and deadline."""
    blocks = {s: -(-n // block) for s, n in total.items()}
    names = sorted(blocks, key=lambda s: (s is None, s or ""))
    edge = {s: [when(blocks, weights, s, j) for j in range(blocks[s] + 1)] for s in names}
    done, out = dict.fromkeys(names, 0), {}
    for slot in range(sum(blocks.values())):
        ready = [(math.ceil(edge[s][done[s] + 1]), k, s) for k, s in enumerate(names) if done[s] < blocks[s] and math.floor(edge[s][done[s]]) <= slot]
        s = min(ready)[2]
        out[(s, done[s])] = slot
        done[s] += 1
    return out


@pytest.mark.parametrize("weights", [None, {"src0": 5.0, "src1": 1.0, "src2": 1.0}])
def test_schedule(table, weights):
    rng = random.Random(5)
    data = [(k, "t", "en", rng.choice(["src0"] * 6 + ["src1", "src2", "src2", None]), 0) for k in range(700)]
    got = op2.mix(table(data).drop("rank", "slot"), weights, block=4).select("doc_id", "source", "block", "slot", "place").collect()
    assert sorted(r[0] for r in got) == list(range(700))
    counts = collections.Counter(r[3] for r in data)
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    shares = weights or op2.tempered(counts)
    floor = sum(shares.values()) / op2.PARTS
    held = op2.integer_weights({s: max(shares.get(s, 0), floor) for s in names})
    assert {(r.source, r.block): r.slot for r in got} == schedule(counts, held, 4)
    assert len({(r.slot, r.place) for r in got}) == 700 and len({(r.slot, r.source) for r in got}) == len({r.slot for r in got})


@pytest.mark.parametrize("small", [5, 40, 150])
def test_every_prefix_is_within_a_block_of_its_share(small):
    """Over all phases: many small sources end one after another beside a large one."""
    rng = random.Random(small)
    blocks = {"large": 900} | {f"s{k}": rng.randint(1, 12) for k in range(small)}
    weights = {"large": 50} | {f"s{k}": rng.randint(1, 30) for k in range(small)}
    done = dict.fromkeys(blocks, 0)
    for t, (s, block) in enumerate(op2.schedule(blocks, weights), 1):
        assert block == done[s]
        done[s] += 1
        if t < 400 or t % 7 == 0:
            got = ideal(blocks, weights, t)
            assert all(abs(done[x] - got[x]) < 1 for x in blocks)
    assert done == blocks


def test_mixing_edges(table, spark):
    assert op2.mix(table([]).drop("rank", "slot")).count() == 0
    same = [(1, "t", "en", "s", 0)] * 9 + [(None, "t", "en", None, 0)]
    assert op2.mix(table(same).drop("rank", "slot"), block=2).count() == 10
    many = spark.range(op2.MAX_SOURCES + 1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("source"))
    with pytest.raises(ValueError):
        op2.mix(many)


def test_any_number_of_sources(spark, tmp_path, monkeypatch):
    """As slot by slot, with more sources than MAX_SOURCES and a plan in several joined pieces."""
    monkeypatch.setattr(op2, "SMALL", 100)
    sizes = {f"s{k}": 1 + 2000 // (k + 1) for k in range(300)}
    rows = [(k, s) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    spark.createDataFrame(rows, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op2.op2_mixing(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in got) == list(range(len(rows)))
    assert len({(r.slot, r.place) for r in got}) == len(rows)
    want = schedule(sizes, op2.integer_weights(op2.tempered(sizes)), op2.BLOCK)
    assert {(r.source, r.block): r.slot for r in got} == want


@pytest.mark.parametrize("weights", [{"a": 2 / 3, "b": 1 / 3 - 0.0001, "c": 0.0001}, {"a": 0.5004, "b": 0.4996}, {"a": 5, "b": 1, "c": 1}])
def test_prefixes_hold_the_callers_weights(weights):
    """To less than a block for every prefix of a long mix, not to weights rounded to thousandths."""
    held, whole, done = op2.integer_weights(weights), sum(weights.values()), dict.fromkeys(weights, 0)
    for t, (s, block) in enumerate(op2.schedule(dict.fromkeys(weights, 10**6), held), 1):
        assert block == done[s]
        done[s] += 1
        if t % 97 == 0 or t < 1000:
            assert all(abs(done[x] - t * w / whole) < 1 for x, w in weights.items())
        if t == 300_000:
            break


def test_many_boilerplate_lines(table):
    """Twenty thousand lines that all documents share, in time that follows their number."""
    text = "\n".join(f"line {k % 19_000} is everywhere" for k in range(20_000))
    data = [(k, text + f"\nown {k}", "en", f"site{k}", 0) for k in range(12)]
    began = time.monotonic()
    got = {r.doc_id: r for r in op1.line_dedup(table(data)).collect()}
    assert time.monotonic() - began < 60
    assert got[0].text == data[0][1] and got[0].n_removed == 0
    assert all(got[k].text == f"own {k}" and (got[k].n_lines, got[k].n_removed) == (20_001, 20_000) for k in range(1, 12))


def test_rows_that_share_an_id_lose_their_own_lines(table):
    shared = [(k, "every site\nmine", "en", f"site{k}", 0) for k in range(12)]
    twice = [(40, "a\nevery site\nb", "en", "x", 0), (40, "every site\nc\nevery site", "en", "x", 0), (40, "d\ne\nf", "en", "x", 0)]
    got = [r.text for r in op1.line_dedup(table(shared + twice)).where("doc_id = 40").collect()]
    assert sorted(got) == ["a\nb", "c", "d\ne\nf"]
