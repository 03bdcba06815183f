"""Best-fit packing by a length histogram.

The plan is made over counts per length, at most `capacity` of them: lengths go from long to short, and each takes the
open sequences with the least room that fits, many equal ones at a time. Documents then take planned slots by
joining on their rank within their length; ranks are dealt over salted groups, so that a length that a third of all
rows have is never ranked in one task.

Defined results: null text is empty (one piece that holds the end id alone); rows without doc_id are packed like any
other; repeated rows are packed as often as they come; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .ranks import ranked, salts_for

CAPACITY = 2048
CHUNK = 10_000  # slots that one row of the plan is spread to


@lru_cache(maxsize=2)
def encoder(path: str, added: bool = False):
    """The byte-level BPE of a tokenizers file, run by tiktoken, which makes the same ids in less time.

    A vocabulary file spells bytes as printable characters: printable Latin-1 stands for itself, the other bytes
    are numbered from 256 on. Special tokens are ordinary text, unless added: then their strings are their ids, as by
    the tokenizers library's default.
    """
    import public_tokenizers
    import tiktoken

    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spelled = {chr(b): b for b in plain}
    spelled |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        described = json.load(f)
    special = {x["content"]: x["id"] for x in described.get("added_tokens", []) if x.get("special")}
    ranks = {bytes(spelled[c] for c in token): k for token, k in described["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special if added else {})


def _cut(path: str, capacity: int, end: int, added: bool):
    names = ("doc_id", "piece", "start", "length", "ids_crc32", "position")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, allowed = encoder(path, added).encode_to_numpy, "all" if added else set()
        for batch in batches:
            rows: list[tuple] = []
            for doc, text, position in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "position")), strict=True):
                ids = np.append(encode(text or "", allowed_special=allowed, disallowed_special=()), end).astype("<u4")
                first = len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), position) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if n == "piece" else pa.int64()) for n, c in zip(names, columns, strict=True)], names=list(names))

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, ranks, first sequence, offset).

    Rank r of such a row goes to sequence first + (r - first rank). Work follows the number of lengths, not of
    documents.
    """
    room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by what is free: (first sequence, sequences)
    slots: list[tuple[int, int, int, int, int]] = []
    opened = 0
    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        free = length

        def fill(first: int, sequences: int, each: int, free: int) -> None:
            nonlocal rank, left
            for k in range(each):
                slots.append((length, rank, sequences, first, capacity - free + k * length))  # noqa: B023
                rank += sequences
            left -= sequences * each
            room[free - each * length].append((first, sequences))  # noqa: B023

        while left:
            while free <= capacity and not room[free]:
                free += 1
            if free > capacity:
                each = capacity // length
                whole, rest = divmod(left, each)
                if whole:
                    fill(opened, whole, each, capacity)
                if rest:
                    fill(opened + whole, 1, rest, capacity)
                opened += whole + bool(rest)
                break
            first, sequences = room[free].pop()
            each = free // length
            whole, rest = min(sequences, left // each), left % each
            if whole:
                fill(first, whole, each, free)
            if whole < sequences and left:
                fill(first + whole, 1, rest, free)
                whole += 1
            if whole < sequences:
                room[free].append((first + whole, sequences - whole))
            free = length
    return slots


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = 0, position: str | None = None, added: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of every document.

    docs: doc_id, text. A document is its ids and the end id; only documents longer than capacity are cut, into
    pieces of that length of which the first may be shorter. position: a column that numbers the documents from 0 in
    the order in which they are to come; pieces of a length then take their slots, and sequences their numbers (by the
    piece at offset 0, the longest), in that order. added: strings of the file's special tokens are those tokens, as for
    the query and the pipeline.
    """
    spark = docs.sparkSession
    session.prepare(spark)
    at = F.col(position) if position else F.lit(None)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), at.cast("long").alias("position"))
    pieces = texts.mapInArrow(_cut(tokenizer, capacity, end, added), "doc_id long, piece int, start long, length long, ids_crc32 long, position long")
    pieces = session.written(pieces)
    counts = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # capacity rows at most
    slot = spark.createDataFrame(plan(counts, capacity), "length long, rank long, n long, sequence_id long, offset long")
    slot = slot.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).select("length", (F.col("rank") + F.col("chunk") * CHUNK).alias("rank"), F.least(F.lit(CHUNK), F.col("n") - F.col("chunk") * CHUNK).alias("n"), (F.col("sequence_id") + F.col("chunk") * CHUNK).alias("sequence_id"), "offset")
    slot = slot.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(F.col("length").alias("slot_length"), (F.col("rank") + F.col("i")).alias("slot_rank"), (F.col("sequence_id") + F.col("i")).alias("sequence_id"), "offset")
    columns = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    salts, order, dealt = salts_for(max(counts.values(), default=0)), ["doc_id", "piece", "ids_crc32"], ["doc_id", "piece", "ids_crc32"]
    if position:
        salts = salts_for(sum(counts.values()))
        documents = (pieces.agg(F.max("position")).first()[0] or 0) + 1
        order, dealt = ["position", "piece"], F.floor(F.col("position") * salts / documents)
    placed = ranked(pieces, "length", order, dealt, salts=salts)
    placed = placed.join(slot, (F.col("length") == F.col("slot_length")) & (F.col("rank") == F.col("slot_rank"))).drop("rank")
    if not position:
        return placed.select(*columns)
    placed = session.written(placed.select(*columns, "position"))
    firsts = placed.where("offset = 0").select(F.lit(0).alias("all"), F.col("sequence_id").alias("planned"), "position", "piece")
    numbers = ranked(firsts, "all", order, dealt, rank="number", salts=salts).select("planned", "number")
    return placed.join(numbers, F.col("sequence_id") == F.col("planned")).withColumn("sequence_id", F.col("number")).select(*columns)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(session.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), added=True)


QUERIES = {"op6_best_fit_packing": op6_best_fit_packing}
ORACLE_SQL: dict[str, str] = {}
