"""Approximate nearest neighbours by collision counting.

Every vector of a shard is projected on LINES random directions; each projection is kept as one sorted array. A query
opens a window around its own projection on every line, and a vector collides with it where it lies in the window;
windows widen by virtual rehashing (the same arrays, a factor of GROWTH at a time) until enough vectors have collided on a
share ALPHA of the lines. Those are verified by exact inner products. What lies outside of windows is counted, as it is
less, and what a wider window takes in is subtracted. The first width is found with a few vectors of the shard itself.
Largest inner product becomes nearest neighbour by one more coordinate, sqrt(M**2 - |x|**2), that queries have as 0;
queries are scaled to the length M, which changes no order.

Every vector is indexed, each shard once for a block of queries. Recall at 20 and the share verified are in the README;
tests hold recall to 0.9 against brute force and the share to a bound.
Defined results: see vectors.usable; with fewer than k candidates all are returned; ties go to the smaller id; other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .vectors import best, top_k, usable

K = 20
EVERY = 20
LINES = 160
ALPHA = 0.8
BETA = 0.05  # share of a shard that should be verified before windows stop growing,
LEAST = 6  # and so many times k besides
WIDTH = 0.8  # first half width that is tried, in standard deviations of the projections
GROWTH = 1.08
TRIED = 16  # vectors of the shard that the first width is found with
SEED = 5


class Index:
    """Sorted projections of one shard."""

    def __init__(self, vectors: np.ndarray, need: int):
        norms = (vectors**2).sum(axis=1)
        self.length, self.need = float(np.sqrt(norms.max())), need
        lifted = np.c_[vectors, np.sqrt(np.maximum(norms.max() - norms, 0))]
        self.lines = np.random.default_rng(SEED).standard_normal((LINES, lifted.shape[1]))
        places = self.lines @ lifted.T
        self.order = np.argsort(places, axis=1)
        self.sorted = np.take_along_axis(places, self.order, axis=1)
        self.half = WIDTH * (float(places.std()) or 1.0)
        some = vectors[:: max(1, len(vectors) // TRIED)][:TRIED]
        self.half = max(self.half, float(np.median(self._search(some)[1])) / GROWTH)

    def candidates(self, queries: np.ndarray) -> list[np.ndarray]:
        """For each query the places of the vectors that collide with it often enough, at least need if there are."""
        return self._search(queries)[0]

    def _search(self, queries: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        n, missed = self.order.shape[1], LINES - int(np.ceil(ALPHA * LINES))
        sizes = np.sqrt((queries**2).sum(axis=1))
        at = self.lines[:, :-1] @ (queries * (self.length / np.where(sizes > 0, sizes, 1.0))[:, None]).T
        outside: list = [None] * len(queries)
        found: list = [None] * len(queries)
        left = right = None
        active, half, halves = np.arange(len(queries)), self.half, np.zeros(len(queries))
        while len(active):
            low = np.stack([np.searchsorted(s, a[active] - half) for s, a in zip(self.sorted, at, strict=True)])
            high = np.stack([np.searchsorted(s, a[active] + half, side="right") for s, a in zip(self.sorted, at, strict=True)])
            again = []
            for k, q in enumerate(active):
                if outside[q] is None:
                    parts = [o[:a] for o, a in zip(self.order, low[:, k].tolist(), strict=True)] + [o[b:] for o, b in zip(self.order, high[:, k].tolist(), strict=True)]
                    outside[q] = np.bincount(np.concatenate(parts), minlength=n)
                else:
                    parts = [o[a:b] for o, a, b in zip(self.order, low[:, k].tolist(), left[:, k].tolist(), strict=True)]
                    parts += [o[a:b] for o, a, b in zip(self.order, right[:, k].tolist(), high[:, k].tolist(), strict=True)]
                    outside[q] = outside[q] - np.bincount(np.concatenate(parts), minlength=n)
                near = np.flatnonzero(outside[q] <= missed)
                if len(near) >= self.need or (high[:, k] - low[:, k] == n).all():
                    found[q], outside[q], halves[q] = near, None, half
                else:
                    outside[q] = outside[q].astype(np.uint8)  # LINES at most
                    again.append(k)
            left, right, active, half = low[:, again], high[:, again], active[again], half * GROWTH
        return found, halves


def collisions(ids: np.ndarray, vectors: np.ndarray):
    """The search of a shard: for each query the ids and inner products of the k best vectors that it finds (its own id excepted)."""
    index: dict[int, Index] = {}

    def search(query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if k not in index:
            index[k] = Index(vectors, min(len(ids), int(BETA * len(ids)) + LEAST * k))
        out = []
        for a in range(0, len(queries), 64):
            for own, q, at in zip(query_ids[a : a + 64], queries[a : a + 64], index[k].candidates(queries[a : a + 64]), strict=True):
                at = at[ids[at] != own]
                out.append(best(ids[at], exact(vectors[at], q), k))
        return out

    return search


def exact(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision."""
    return np.einsum("ij,j->i", vectors, query)


def op5_collision_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    rows = usable(session.read(spark, sf_dir, "embeddings"), nonzero=True)
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0), collisions, K, whole=False)


QUERIES = {"op5_collision_ann": op5_collision_ann}
ORACLE_SQL: dict[str, str] = {}
