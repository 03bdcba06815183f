"""Exact top-k search by MaxScore.

Vectors are documents and dimensions are terms. Within a shard a term's posting weighs q[d] * x[d], shifted so that the
least of the shard is 0; its bound is what the greatest would weigh. Terms go by falling bound. The last terms whose
bounds together stay under the threshold (the k-th best score so far) are non-essential: what has only those cannot enter
the k best. The other terms' postings are traversed; a vector's non-essential postings are probed while what it has and
what is left could still reach the threshold. Vectors come in blocks; after each the threshold rises and the boundary
between the terms moves. Until k vectors are scored all terms are essential. Shards' best are merged by rank.

Defined results: see vectors.usable; with fewer than k candidates all are returned; ties go to the smaller id; a table
without usable vectors gives no rows; other columns are ignored. Components beyond 2**63 / 256 are held at the limits of
a long, and a score that no long holds is cut to its 64 bits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .vectors import best, top_k, usable

K = 5
EVERY = 50
SCALE = 256
STEP = 8  # non-essential terms probed between two looks at the threshold
BLOCK = 2048  # vectors between two moves of the boundary
EXACT = float(1 << 53)  # sums of doubles are whole up to here


class Postings:
    """A shard's postings by term, with the least and greatest value of each."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.terms = np.ascontiguousarray(vectors.T)
        self.least, self.most = self.terms.min(axis=1), self.terms.max(axis=1)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query the ids and inner products of its k best vectors (its own id excepted), by falling score."""
        return [self.one(own, q, k) for own, q in zip(query_ids, queries, strict=True)]

    def one(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = np.minimum(q * self.least, q * self.most), np.maximum(q * self.least, q * self.most)
        terms = np.argsort(low - high, kind="stable")  # falling bound
        rest = np.r_[np.cumsum((high - low)[terms][::-1])[::-1], 0.0]  # bounds of the terms from here on
        base = low[terms].sum()
        size = np.abs(np.r_[low, high]).sum()
        slack = 0.0 if size < EXACT else size * 1e-12  # rounding of what is pruned by
        weights, floors = q[terms], low[terms]
        near, scores, bar = np.zeros(0, dtype=np.int64), np.zeros(0), -np.inf
        for a in range(0, len(self.ids), BLOCK):
            here = np.arange(a, min(a + BLOCK, len(self.ids)))
            need = bar - base - slack  # of shifted weights
            at = int(np.searchsorted(-rest, -need, side="right")) if np.isfinite(bar) else len(q)  # the first rest below it
            at = min(at, len(q))
            partial = weights[:at] @ self.terms[terms[:at], a : a + BLOCK] - floors[:at].sum()
            while True:
                live = partial + rest[at] >= need
                here, partial = here[live], partial[live]
                if at == len(q) or not len(here):
                    break
                step = slice(at, min(at + STEP, len(q)))
                partial = partial + weights[step] @ self.terms[np.ix_(terms[step], here)] - floors[step].sum()
                at = step.stop
            here = here[self.ids[here] != own]
            exact = self.vectors[here] @ q if size < EXACT else self.vectors[here].astype(np.int64) @ q.astype(np.int64)
            near, scores = best(np.r_[near, self.ids[here]], np.r_[scores.astype(exact.dtype), exact], k)
            bar = float(scores[-1]) if len(scores) == k else -np.inf
        return near, scores


def postings(ids: np.ndarray, vectors: np.ndarray):
    return Postings(ids, vectors).search


def op4_maxscore_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    whole = F.transform("embedding", lambda x: F.floor(x * SCALE).cast("double"))
    rows = usable(session.read(spark, sf_dir, "embeddings"), nonzero=False).select("vec_id", whole.alias("embedding"))
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0), postings, K, whole=True)


QUERIES = {"op4_maxscore_topk": op4_maxscore_topk}
ORACLE_SQL = {
    "op4_maxscore_topk": f"""
WITH usable AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * {SCALE}) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id WHERE q.vec_id % {EVERY} = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
}
