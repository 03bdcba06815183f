"""SimHash near-dedup: fingerprints of word shingles, linked exactly within a Hamming radius by vantage-point trees.

A tree over a sample of the distinct fingerprints (SAMPLE, or A_SHARD for each shard) deals them to shards; a fingerprint near a
boundary goes to both sides, so that every pair within the radius meets in a shard, where a tree of the shard's own
fingerprints prunes by the same triangle bound. Shards return forests, which connected components join.

Defined results: null or empty text, or text of white space, has the fingerprint zero, linked like any other; fewer
words than a shingle make one shingle; rows without doc_id are left out; repeated rows come as often as they are
there; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import near, session, vptree
from .components import components
from .repeats import _not_null

U = np.uint64
SAMPLE = 8192  # fingerprints that shape the tree above the shards, at least;
A_SHARD = 64  # so many for each shard where those are more: a thousandth of the fingerprints
SHARD = 65_536  # fingerprints that a shard should have
FAMILY = near.Permutations(64, bands=16, rows=4)  # a pair of similarity 0.8 shares none of the bands with probability 0.0002


def fingerprint(text: bytes, words: int) -> int:
    return simhash(near.shingles(text, words))


def simhash(codes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the codes."""
    if not len(codes):
        return 0
    ones = np.unpackbits(codes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(codes), bitorder="little").view("<u8")[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            codes = np.array([fingerprint(t or b"", words) for t in texts], dtype=U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(codes.view(np.int64))], names=["doc_id", "fp"])

    return run


def _dealt(tree, reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = batch.column("fp").to_numpy().view(U)
            routed = [(leaf, at) for leaf, at in vptree.route(tree, points, reach) if len(at)]
            if routed:
                leaves = np.repeat(np.array([leaf for leaf, _ in routed], dtype=np.int64), [len(at) for _, at in routed])
                yield pa.RecordBatch.from_pydict({"leaf": leaves, "fp": points[np.concatenate([at for _, at in routed])].view(np.int64)})

    return run


def _linked(reach: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by leaf and fingerprint."""
        leaf, parts = None, []

        def solved():
            points = np.unique(np.concatenate(parts))
            least = vptree.links(points, reach)
            moved = points != least
            return pa.RecordBatch.from_pydict({"u": points[moved].view(np.int64), "v": least[moved].view(np.int64)})

        for batch in batches:
            leaves, points = batch.column("leaf").to_numpy(), batch.column("fp").to_numpy().view(U)
            cuts = np.r_[0, np.flatnonzero(np.diff(leaves)) + 1, len(leaves)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                if leaf is not None and leaves[a] != leaf:
                    yield solved()
                    parts = []
                leaf = leaves[a]
                parts.append(points[a:b].copy())
        if parts:
            yield solved()

    return run


def _bounded(dealt: DataFrame, shard: int) -> DataFrame:
    """dealt, with shards that came out more than twice too large (balls that no vantage point splits) dealt anew.

    Their fingerprints go to blocks by hash, and every pair of blocks becomes a shard of its own: still exact, and no
    task holds more than about two blocks.
    """
    large = dealt.groupBy(F.col("leaf").alias("large")).count().where(F.col("count") > 2 * shard)
    joined = dealt.join(large, F.col("leaf") == F.col("large"), "left").withColumn("blocks", F.coalesce(F.ceil(F.col("count") / shard), F.lit(1)))
    joined = joined.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    pair = F.when(F.col("blocks") > 1, F.xxhash64("leaf", F.least("own", "other"), F.greatest("own", "other"))).otherwise(F.col("leaf"))
    return joined.select(pair.alias("leaf"), "fp")


def near_duplicates(docs: DataFrame, words: int = 3, reach: int = 2, shard: int = SHARD) -> DataFrame:
    """doc_id, fp (long: the fingerprint's 64 bits), component_id (least doc_id reachable over links, itself included).

    docs: doc_id, text. Two documents link if the fingerprints of their shingles of so many words differ in at most
    reach bits.
    """
    session.prepare(docs.sparkSession)
    docs = session.id_and_text(docs).where("doc_id is not null")
    prints = docs.mapInArrow(_fingerprints(words), _not_null("doc_id long, fp long", "doc_id", "fp")).checkpoint()
    named = _rooted(prints, reach, shard)
    ids = named.groupBy(F.col("root").alias("top")).agg(F.min("least").alias("component_id"))
    final = named.join(ids, F.col("root") == F.col("top")).select(F.col("fp").alias("code"), "component_id")
    return prints.join(final, F.col("fp") == F.col("code")).select("doc_id", "fp", "component_id")


def _rooted(prints: DataFrame, reach: int, shard: int) -> DataFrame:
    """fp, least (doc_id that has it), root (a fingerprint that names its component)."""
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    n = nodes.count()
    sample = np.array([r[0] for r in nodes.orderBy(F.xxhash64("fp"), "fp").select("fp").limit(max(SAMPLE, A_SHARD * -(-n // shard))).collect()], dtype=np.int64).view(U)
    depth = int(np.ceil(np.log2(max(1, n / shard)) * 1.5))  # a half more levels, for what goes to both sides
    tree = vptree.grow(sample, reach, depth)
    dealt = session.written(nodes.select("fp").mapInArrow(_dealt(tree, reach), "leaf long, fp long"))
    shards = _bounded(dealt, shard)
    edges = shards.repartition("leaf").sortWithinPartitions("leaf", "fp").mapInArrow(_linked(reach), "u long, v long")
    roots = components(edges)
    return nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_copies(docs: DataFrame, words: int, reach: int, least: float, shard: int = SHARD, block: int = near.BLOCK) -> DataFrame:
    """near.near_copies, with fingerprints at most reach bits apart as candidates beside the bands of least hashes: at
    similarity 0.8 fingerprints differ in about ten bits, more than a tree can prune by."""
    return near.near_copies(docs, words, least, FAMILY, block=block, mark=simhash, more=lambda prints: _rooted(prints, reach, shard).select(F.col("fp").alias("print"), F.col("root").alias("key")))


def op9_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(session.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op9_simhash_dedup": op9_simhash_dedup}
ORACLE_SQL: dict[str, str] = {}
