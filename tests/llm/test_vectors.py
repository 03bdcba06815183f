"""op4 against brute force and SQL, op5 by recall."""

import duckdb
import numpy as np
import pytest

from sparkpanel.llm import op4_maxscore as op4
from sparkpanel.llm import op5_collision_ann as op5
from sparkpanel.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, score string, rank string"


def vector_rows(n=400, d=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32) / 3
    x[50:120] = x[7]  # a hot vector
    rows = [(k, v.tolist(), 0, "clash", "clash") for k, v in enumerate(x)]
    rows[60] = (60, None, 0, "c", "c")
    rows[100] = (100, [*x[100][:-1].tolist(), None], 0, "c", "c")
    rows[150] = (150, [*x[150][:-1].tolist(), float("nan")], 0, "c", "c")
    rows[200] = (200, [*x[200][:-1].tolist(), float("inf")], 0, "c", "c")
    rows[250] = (250, [0.0] * d, 0, "c", "c")
    rows[300] = (300, [], 0, "c", "c")
    return [*rows, (None, x[3].tolist(), 0, "c", "c"), rows[7]]


def usable(rows, nonzero):
    out = {}
    for i, v, *_ in rows:
        if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and (not nonzero or any(v)):
            out[i] = v
    ids = np.array(sorted(out))
    return ids, np.array([out[i] for i in ids], dtype=np.float64)


def brute(ids, x, every, k):
    out = []
    for i in np.flatnonzero(ids % every == 0):
        score = x @ x[i]
        order = [j for j in np.lexsort((ids, -score)) if j != i][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), score[j]) for r, j in enumerate(order)]
    return out


@pytest.mark.parametrize("shard,block", [(8192, 1024), (37, 3)])
def test_exact(spark, tmp_path, monkeypatch, shard, block):
    monkeypatch.setattr(vectors.top_k, "__defaults__", (shard, block))
    rows = vector_rows()
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in op4.op4_maxscore_topk(spark, str(tmp_path)).collect())
    ids, x = usable(rows, False)
    want = [(q, r, v, int(s)) for q, r, v, s in brute(ids, np.floor(x * 256), 50, 5)]
    assert got == sorted(want)


def test_exact_matches_sql(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(k, (rng.normal(size=6) / 2).tolist(), 0, "", "") for k in range(150)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(tuple(r) for r in con.sql(op4.ORACLE_SQL["op4_maxscore_topk"]).fetchall())
    assert sorted(tuple(r) for r in op4.op4_maxscore_topk(spark, str(tmp_path)).collect()) == want


@pytest.mark.parametrize("d,n", [(12, 400), (64, 3000)])
def test_recall(spark, tmp_path, d, n):
    rows = vector_rows(n, d, 1)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op5.op5_collision_ann(spark, str(tmp_path)).collect()
    ids, x = usable(rows, True)
    want = brute(ids, x, 20, 20)
    place = {i: k for k, i in enumerate(ids)}
    for r in got:
        assert r.score == pytest.approx(float(x[place[r.query_id]] @ x[place[r.vec_id]]), abs=1e-12)
    # by score, as the hot vector ties
    floor = {q: s for q, r, _, s in want if r == 20}
    assert sum(r.score >= floor[r.query_id] - 1e-12 for r in got) / len(want) >= 0.9


def test_few_and_no_vectors(spark, tmp_path):
    for k, rows in enumerate(([], [(0, [1.0], 0, "", "")], [(0, [1.0], 0, "", ""), (1, [2.0], 0, "", ""), (2, [2.0], 0, "", "")])):
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        for query in (op4.op4_maxscore_topk, op5.op5_collision_ann):
            got = [(r.query_id, r.rank, r.vec_id) for r in query(spark, f"{tmp_path}/{k}").collect()]
            assert sorted(got) == ([(0, 1, 1), (0, 2, 2)] if k == 2 else [])


def test_recall_with_the_share_verified():
    """Uniformly random unit vectors, the hard case: recall counts only beside the share of a shard that is verified."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    queries = x[::40]
    index = op5.Index(x, int(op5.BETA * len(x)) + op5.LEAST * 20)
    hit = share = 0
    for q, near in zip(queries, index.candidates(queries), strict=True):
        hit += len(set(np.argsort(-(x @ q))[:20]) & set(near.tolist())) / 20
        share += len(near) / len(x)
    print(f"recall {hit / len(queries):.3f} share {share / len(queries):.3f}")
    assert hit / len(queries) >= 0.93 and share / len(queries) <= 0.18


def test_length_of_queries_changes_nothing():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 8)) * rng.uniform(0.1, 3, size=(500, 1))
    index = op5.Index(x, 60)
    one, other = index.candidates(x[:20]), index.candidates(x[:20] * 1000)
    assert all(set(a) == set(b) for a, b in zip(one, other))


def test_bounds_prune_and_large_integers_are_exact(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op4, "BLOCK", 16)
    rng = np.random.default_rng(8)
    x = rng.integers(-(2**30), 2**30, size=(120, 5)).astype(np.float64)
    x[:, 0] *= 2.0**-28  # one light term
    x[7] = x[3]
    x = np.floor(x)
    got = op4.Postings(np.arange(120), x).search(np.arange(0, 120, 10), x[::10], 4)
    whole = [[int(v) for v in row] for row in x]
    for own, (ids, scores) in zip(range(0, 120, 10), got):
        want = sorted(((-sum(a * b for a, b in zip(whole[own], row)), k) for k, row in enumerate(whole) if k != own))[:4]
        assert [(int(s), int(i)) for i, s in zip(ids, scores)] == [(-s, k) for s, k in want]
