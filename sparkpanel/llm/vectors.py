"""Top-k search of a stated query set against all vectors, in blocks of bounded size.

Vectors are dealt to shards, which stay in place: a task makes what it searches a shard with once, and the queries of a
block stream past it in batches. Blocks are large, so that a shard's vectors are shipped few times; the shards' best are
merged by rank. No side is broadcast or gathered whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD = 16_384  # vectors
BLOCK = 65_536  # queries that one copy of a shard answers


def usable(vectors: DataFrame, nonzero: bool) -> DataFrame:
    """vec_id, embedding (array<double>) of vectors that take part, one row for each id.

    Left out: null ids, vectors that are null, empty, hold null or non-finite components or (nonzero) only zeros, and
    vectors of another length than most. Of rows that share an id the least vector counts.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("embedding")).where("vec_id is not null and size(embedding) > 0")
    limit = F.lit(float("inf"))
    rows = rows.where(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < limit)))
    if nonzero:
        rows = rows.where(F.exists("embedding", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    sizes = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("embedding") == (sizes[0][0] if sizes else 0))


Found = list[tuple[np.ndarray, np.ndarray]]
Search = Callable[[np.ndarray, np.ndarray, int], Found]  # (ids, queries, k): ids and scores of each query's best
Prepare = Callable[[np.ndarray, np.ndarray], Search]  # (ids, vectors) of a shard


def _answers(search: Search, ids: np.ndarray, queries: np.ndarray, k: int, whole: bool) -> pa.RecordBatch:
    found = search(ids, queries, k)
    asked = np.repeat(ids, [len(f[0]) for f in found])
    near, score = (np.concatenate([f[i] for f in found]) for i in (0, 1))
    return pa.RecordBatch.from_arrays([pa.array(asked), pa.array(near.astype(np.int64)), pa.array(score.astype(np.int64 if whole else np.float64))], names=["query_id", "vec_id", "score"])


def _groups(prepare: Prepare, k: int, whole: bool):
    """Rows come sorted by group, and in a group the shard's vectors before the block's queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, search = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            group, kind, ids = (batch.column(c).to_numpy() for c in ("group", "kind", "vec_id"))
            x = batch.column("embedding").flatten().to_numpy().reshape(batch.num_rows, -1)
            mark = 2 * group.astype(np.int64) + kind
            cuts = np.r_[0, np.flatnonzero(np.diff(mark)) + 1, len(mark)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if group[a] != now:
                    now, shard, search = group[a], [], None
                if kind[a] == 0:
                    shard.append((ids[a:b].copy(), x[a:b].copy()))
                elif shard or search:
                    if search is None:
                        search, shard = prepare(*(np.concatenate([s[i] for s in shard]) for i in (0, 1))), []
                    yield _answers(search, ids[a:b], x[a:b], k, whole)

    return run


def top_k(vectors: DataFrame, queries: DataFrame, prepare: Prepare, k: int, whole: bool, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: the k best that prepare's search finds over all shards, ties to the
    smaller vec_id. Blocks are smaller than `block` only where there would be fewer groups than tasks at once."""
    n, m = vectors.count(), queries.count()
    shards = max(1, -(-n // shard))
    blocks = max(1, -(-m // block), min(-(-m // 256), -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // shards)))
    every = lambda column, count: F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias(column)
    of = lambda column, count, *more: F.pmod(F.xxhash64("vec_id", *more), F.lit(count)).cast("int").alias(column)
    dealt = vectors.select(F.lit(0).alias("kind"), "vec_id", "embedding", of("shard", shards), every("block", blocks))
    asked = queries.select(F.lit(1).alias("kind"), "vec_id", "embedding", every("shard", shards), of("block", blocks, F.lit(7)))
    rows = dealt.unionByName(asked).withColumn("group", F.col("block") * shards + F.col("shard")).select("group", "kind", "vec_id", "embedding")
    found = rows.repartitionById(shards * blocks, "group").sortWithinPartitions("group", "kind").mapInArrow(_groups(prepare, k, whole), f"query_id long, vec_id long, score {'long' if whole else 'double'}")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores, ties to smaller ids."""
    if len(ids) > 4 * k:
        bar = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = scores >= bar
        ids, scores = ids[keep], scores[keep]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]
