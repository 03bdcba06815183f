"""Mixing sources to target weights by Pfair scheduling.

A source's documents form blocks. With exact integer weights (the caller's numbers as fractions of one denominator, not
rounded) the ideal mix gives every slot to the sources that have blocks left, in shares by weight; when a source ends, the
others go on and share by their weights. A block is released in the slot in which the ideal mix begins it and due when
that has ended it; every slot goes to the released block with the earliest deadline. As windows follow the ideal mix over
all its phases, every prefix of the whole mix holds each source to less than one block of its ideal share, however many
sources have ended. Every document is placed.

The driver makes the schedule slot by slot, in bounded pieces, and keeps a few numbers per source; documents get their
slots by a join on source and block.

Defined results: a null source is a source of its own; null or repeated doc_ids are placed like any other row; an empty
table gives no rows; any number of sources is scheduled unless the caller sets a bound.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import session
from .ranks import ranked, salts_for

BLOCK = 32  # documents
PARTS = 1000  # a source without a weight counts as 1 / PARTS of the sum of the weights
MAX_SOURCES = 256  # mix() raises beyond, unless told otherwise; the query and the pipeline have no bound
SMALL = 1_000_000  # blocks of a plan that is broadcast, and of a piece of a larger one


class Fluid:
    """The ideal mix: sources with blocks left share every slot by their weights, and a source ends with its last block.

    In virtual time v a source has a * v blocks, so it ends at n / a; with C blocks of ended sources and A the weights of
    the others, that is slot C + A v. Slots of whole blocks are therefore quotients of whole numbers, phase by phase.
    """

    def __init__(self, blocks: dict, weights: dict):
        ends = sorted(blocks, key=lambda s: Fraction(blocks[s], weights[s]))
        self.ends = [(blocks[s], weights[s]) for s in ends]
        self.near = [n / a for n, a in self.ends]  # to look phases up by; compared exactly after that
        self.phases = [(0, sum(weights[s] for s in blocks))]
        for n, a in self.ends:
            self.phases.append((self.phases[-1][0] + n, self.phases[-1][1] - a))

    def at(self, j: int, a: int) -> tuple[int, int]:
        """(C, A) where a source of weight a has j blocks."""
        k = bisect_left(self.near, j / a)
        while k and j * self.ends[k - 1][1] <= self.ends[k - 1][0] * a:
            k -= 1
        while j * self.ends[k][1] > self.ends[k][0] * a:
            k += 1
        return self.phases[k]

    def release(self, j: int, a: int) -> int:
        """The slot from which block j (from 0) may stand: the whole part of when the source has j blocks."""
        ended, rest = self.at(j, a)
        return ended + j * rest // a

    def deadline(self, j: int, a: int) -> int:
        """The slot before which block j (from 0) has to stand: when the source has j + 1 blocks, rounded up."""
        ended, rest = self.at(j + 1, a)
        return ended - (-(j + 1) * rest // a)


def schedule(blocks: dict, weights: dict) -> Iterator[tuple]:
    """(source, block) of slot 0, 1, ... blocks, weights: by source, positive whole numbers. Ties go to the source named first."""
    fluid, names = Fluid(blocks, weights), list(blocks)
    done = [0] * len(names)
    ready = [(fluid.deadline(0, weights[s]), k) for k, s in enumerate(names)]
    waiting: list[tuple[int, int]] = []  # (release, source)
    heapq.heapify(ready)
    for slot in range(sum(blocks.values())):
        while waiting and waiting[0][0] <= slot:
            _, k = heapq.heappop(waiting)
            heapq.heappush(ready, (fluid.deadline(done[k], weights[names[k]]), k))
        deadline, k = heapq.heappop(ready)
        if slot >= deadline:
            raise AssertionError("a block missed its deadline")
        yield names[k], done[k]
        done[k] += 1
        if done[k] < blocks[names[k]]:
            heapq.heappush(waiting, (fluid.release(done[k], weights[names[k]]), k))


def integer_weights(shares: dict) -> dict:
    """Whole numbers in exactly the same proportions."""
    exact = {s: Fraction(w) for s, w in shares.items()}
    one = lcm(*(w.denominator for w in exact.values()))
    return {s: int(w * one) for s, w in exact.items()}


def tempered(counts: dict, power: float = 0.5) -> dict:
    return {s: n**power for s, n in counts.items()}


def _plan(spark: SparkSession, blocks: dict, weights: dict) -> tuple[DataFrame, bool]:
    """(__source, __block, slot; whether it is small)."""
    slots, start = schedule(blocks, weights), 0

    def piece() -> DataFrame | None:
        nonlocal start
        some = list(islice(slots, SMALL))
        if not some and start:
            return None
        columns = [pa.array([s for s, _ in some], pa.string()), pa.array([b for _, b in some], pa.int64()), pa.array(range(start, start + len(some)), pa.int64())]
        start += len(some)
        table = pa.table(columns, names=["__source", "__block", "slot"])
        return spark.createDataFrame(table) if some else spark.createDataFrame([], "__source string, __block long, slot long")

    first = piece()
    if sum(blocks.values()) <= SMALL:
        return first, True
    pieces = [session.written(first)]
    while (more := piece()) is not None:
        pieces.append(session.written(more))
    plan = pieces[0]
    for more in pieces[1:]:
        plan = plan.unionByName(more)
    return plan, False


def mix(docs: DataFrame, weights: dict | None = None, block: int = BLOCK, most: int | None = MAX_SOURCES) -> DataFrame:
    """docs with block (of its source), slot (the block's place in the mix) and place (in the block).

    docs: doc_id, source and any other columns but those three. weights: target share by source, held as they are; a
    source without a positive one counts as 0.001 of their sum; by default the square roots of the sources' sizes. Order
    by slot, place to read the mix. More than `most` sources raise ValueError; None: no bound.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy("source").count()
    counts = {r[0]: int(r[1]) for r in (sizes if most is None else sizes.limit(most + 1)).collect()}
    if most is not None and len(counts) > most:
        raise ValueError(f"more than {most} sources")
    names = sorted(counts, key=lambda s: (s is None, s or ""))
    shares = {s: w for s, w in (weights or tempered(counts)).items() if w > 0}
    floor = sum(shares.values()) / PARTS if shares else 1
    held = integer_weights({s: shares.get(s, floor) for s in names}) if names else {}
    plan, small = _plan(spark, {s: -(-counts[s] // block) for s in names}, held)
    placed = ranked(docs, "source", [F.xxhash64("doc_id"), "doc_id"], ["doc_id"], rank="__rank", salts=salts_for(max(counts.values(), default=0)))
    placed = placed.withColumn("block", F.floor(F.col("__rank") / block)).withColumn("place", F.col("__rank") % block)
    joined = placed.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block")))
    return joined.drop("__rank", "__source", "__block")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    session.prepare(spark)
    docs = session.read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), F.col("source").cast("string"))
    return mix(docs, most=None).select("doc_id", "source", "block", "slot", "place")


QUERIES = {"op2_mixing": op2_mixing}
ORACLE_SQL: dict[str, str] = {}
