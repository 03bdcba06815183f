"""Near copies: candidates from bands of least hashes, joined in Spark, and exact Jaccard similarity of shingle sets.

Every text with a band in common with another is a candidate; components of candidates are verified whole. A component
of more texts (or bytes) than a block is dealt to all pairs of blocks. Within a leaf the shared shingles of all pairs are
counted at once, by matrix products and lists, so that groups of copies, and of texts with a passage in common, cost no
proof a pair.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import session
from .components import components
from .repeats import _not_null

U = np.uint64
BLOCK = 4096  # texts of a block
BLOCK_BYTES = 8 << 20  # and their bytes
FEW = 500_000  # candidates (of some 40 bytes) that are sent to the texts
STRIP = 512  # codes that are permuted at a time


def normal(text: bytes, fold: bool) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+; fold lower-cases A-Z only, as these are bytes."""
    return (text.lower() if fold else text).split()


def shingles(text: bytes, words: int, fold: bool = True) -> np.ndarray:
    """A code for each shingle, in order; fewer words than a shingle make one."""
    parts = normal(text, fold)
    if not parts:
        return np.zeros(0, dtype="<u8")
    line, code = b" ".join(parts), xxhash.xxh64_intdigest
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = np.r_[0, ends[:-1] + 1].tolist()
    ends = ends[min(words, len(parts)) - 1 :].tolist()
    return np.array([code(line[a:b], 42) for a, b in zip(starts, ends, strict=False)], dtype="<u8")


class Permutations:
    """Universal hashes x -> a x + b modulo 2**64 with odd a, each of which permutes the 64-bit codes."""

    def __init__(self, n: int, bands: int, rows: int, seed: int = 42):
        random = np.random.default_rng(seed)
        self.a = random.integers(0, 1 << 63, (n, 1), dtype=np.int64).astype(U) * U(2) + U(1)
        self.b = random.integers(0, 1 << 63, (n, 1), dtype=np.int64).astype(U)
        self.bands, self.rows = bands, rows

    def least(self, codes: np.ndarray) -> np.ndarray:
        """The signature: for each permutation the least value over the codes; all ones for no codes."""
        low = np.full(len(self.a), ~U(0))
        for at in range(0, len(codes), STRIP):
            values = self.a * codes[None, at : at + STRIP]
            values += self.b
            np.minimum(low, values.min(axis=1), out=low)
        return low

    def keys(self, signature: np.ndarray) -> list[int]:
        """A key for each band of a signature."""
        return [xxhash.xxh64_intdigest(signature[k * self.rows : (k + 1) * self.rows].tobytes(), k) for k in range(self.bands)]


def text_code(text: bytes, fold: bool = True) -> int:
    return xxhash.xxh64_intdigest(b" ".join(normal(text, fold)), 7)


def longs(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=U).view(np.int64))


def _printed(words: int, fold: bool, family: Permutations, mark: Callable[[np.ndarray], int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            found = [shingles(t, words, fold) for t in texts]
            keys = pa.array([np.array(family.keys(family.least(x)) if len(x) else [], dtype=U).view(np.int64) for x in found], pa.list_(pa.int64()))
            columns = [batch.column("doc_id"), longs([mark(x) for x in found]), longs([text_code(t, fold) for t in texts]), pa.array([len(t) for t in texts], pa.int64()), keys]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "code", "size", "bands"])

    return run


def _overlaps(sets: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For strips of sets, the first's place and how many values each of the strip shares with each of all. Exact.

    Values that over a quarter of the sets have are counted by products of a 0/1 matrix, the others along their lists.
    """
    m, sizes = len(sets), np.array([len(x) for x in sets], dtype=np.int64)
    value = np.unique(np.concatenate(sets), return_inverse=True)[1]
    owner = np.repeat(np.arange(m), sizes)
    spread = np.bincount(value)
    common = np.flatnonzero(spread > max(m // 4, 16))
    place = np.full(len(spread), -1)
    place[common] = np.arange(len(common))
    dense = np.zeros((m, len(common)), dtype=np.float32)
    at = place[value]
    dense[owner[at >= 0], at[at >= 0]] = 1.0
    rare = (at < 0) & (spread[value] > 1)
    value, owner = value[rare], owner[rare]
    order = np.argsort(value, kind="stable")
    listed, starts = owner[order], np.searchsorted(value[order], np.arange(len(spread) + 1))
    ends = np.searchsorted(owner, np.arange(m + 1))
    for a in range(0, m, STRIP):
        count = (dense[a : a + STRIP] @ dense.T).astype(np.int64)
        for i in range(a, min(a + STRIP, m)):
            mine = value[ends[i] : ends[i + 1]]
            if len(mine):
                count[i - a] += np.bincount(np.concatenate([listed[starts[v] : starts[v + 1]] for v in mine.tolist()]), minlength=m)
        yield a, count


def links(sets: list[np.ndarray], least: float) -> np.ndarray:
    """The class of each set (an array without repeats), named by a member: sets of at least that Jaccard similarity are
    of one class. Exact, over all pairs; a set without values is like others of its kind."""
    label = np.arange(len(sets))
    if not len(sets):
        return label
    sizes = np.array([len(x) for x in sets], dtype=np.int64)
    for a, shared in _overlaps(sets):
        for i, both in enumerate(shared, a):
            union = sizes[i] + sizes - both
            like = np.where(union > 0, both / np.maximum(union, 1) >= least, True)
            met = np.unique(label[like])
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def _verified(words: int, fold: bool, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by leaf and code."""
        leaf, sets = None, {}

        def solved() -> pa.RecordBatch:
            codes = np.array(list(sets), dtype=np.int64)
            label = links(list(sets.values()), least)
            moved = label != np.arange(len(label))
            return pa.RecordBatch.from_pydict({"u": codes[moved], "v": codes[label[moved]]})

        for batch in batches:
            for at, code, text in zip(*(batch.column(c).to_pylist() for c in ("leaf", "code")), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if at != leaf:
                    if len(sets) > 1:
                        yield solved()
                    leaf, sets = at, {}
                text = text or b""
                if code not in sets and text_code(text, fold) == code % 2**64:  # rows that share a doc_id may have other texts
                    sets[code] = np.unique(shingles(text, words, fold))
        if len(sets) > 1:
            yield solved()

    return run


def _no_mark(codes: np.ndarray) -> int:
    return 0


def near_copies(
    docs: DataFrame, words: int, least: float, family: Permutations, fold: bool = True, block: int = BLOCK, mark: Callable[[np.ndarray], int] = _no_mark, more: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """doc_id, code (of the row's words), component_id (least doc_id reachable over links, itself included) and first
    (whether the row's id and words are the least of its component) for rows with a doc_id.

    Two documents link if their words are the same or the exact Jaccard similarity of their sets of shingles is at least
    so much. Candidates share a band of least hashes, or a key that more() gives to their marks: from (doc_id, fp) to
    (print, key). All pairs within a component of candidates are verified, whatever made them candidates.
    """
    session.prepare(docs.sparkSession)
    docs = session.id_and_text(docs).where("doc_id is not null")
    prints = docs.mapInArrow(_printed(words, fold, family, mark), _not_null("doc_id long, fp long, code long, size long, bands array<long>", "doc_id", "fp", "code", "size")).checkpoint()
    nodes = prints.groupBy("code").agg(F.min("doc_id").alias("least"), F.min("fp").alias("fp"), F.max("size").alias("size"), F.first("bands").alias("bands"))  # bands follow from the code
    nodes = session.written(nodes)
    keyed = nodes.select("code", F.explode("bands").alias("key"))
    if more is not None:
        marks = more(prints.select("doc_id", "fp"))
        keyed = keyed.unionByName(nodes.join(marks, F.col("fp") == F.col("print")).select("code", "key"))
    firsts = keyed.groupBy(F.col("key").alias("shared")).agg(F.min("code").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = keyed.join(firsts, F.col("key") == F.col("shared")).select(F.col("code").alias("u"), F.col("first").alias("v")).where("u <> v").distinct()
    candidates = session.written(components(near).select(F.col("node"), F.col("root")))
    sized = candidates.join(nodes.select("code", "least", "size"), F.col("node") == F.col("code"))
    large = sized.groupBy(F.col("root").alias("top")).agg(F.ceil(F.greatest(F.count(F.lit(1)) / block, F.sum("size") / BLOCK_BYTES)).alias("blocks"))
    asked = sized.join(large, F.col("root") == F.col("top")).select("code", "root", F.col("least").alias("id"), "blocks")
    if candidates.count() <= FEW:
        asked = F.broadcast(asked)  # of checked size; beyond it, texts move to their candidates
    asked = docs.join(asked, F.col("doc_id") == F.col("id")).withColumn("own", F.pmod(F.xxhash64("code"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = asked.select(F.xxhash64("root", F.least("own", "other"), F.greatest("own", "other")).alias("leaf"), "code", "text")
    edges = dealt.repartition("leaf").sortWithinPartitions("leaf", "code").mapInArrow(_verified(words, fold, least), "u long, v long")
    classes = components(edges).select("node", F.col("root").alias("class"))
    named = nodes.join(classes, F.col("code") == F.col("node"), "left").select("code", "least", F.coalesce("class", "code").alias("class"))
    ids = named.groupBy(F.col("class").alias("top")).agg(F.min(F.struct("least", "code")).alias("head"))
    final = named.join(ids, F.col("class") == F.col("top")).select(F.col("code").alias("text_code"), "head")
    found = prints.select("doc_id", "code").join(final, F.col("code") == F.col("text_code"))
    return found.select("doc_id", "code", F.col("head.least").alias("component_id"), ((F.col("doc_id") == F.col("head.least")) & (F.col("code") == F.col("head.code"))).alias("first"))


def with_codes(docs: DataFrame, fold: bool = True) -> DataFrame:
    """docs (doc_id, text and other columns) with __code, near_copies' code of the row's words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = longs([text_code(t or b"", fold) for t in batch.column("text").cast(pa.binary()).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, codes], names=[*batch.schema.names, "__code"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__code", T.LongType())]))
