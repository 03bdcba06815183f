"""Imputation by a self-organising map: cells of a node get the hidden markers of a reference cell of that node, with noise.

The map is a batch map: a round is one aggregate of all cells by their nearest node (tasks sum theirs, a row a node moves)
and one smoothing of these sums over the grid. Nothing but the codebook and sums by node reaches the driver; every
reference cell can be drawn, and every query cell draws, whatever their numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .quantiles import large_quantiles
from .sampling import uniform

SHARE = 20_000  # reference cells of a node that are numbered in one task


@dataclass(frozen=True)
class Map:
    """A codebook over standardised features: nodes by row of the grid."""

    features: list[str]
    mean: np.ndarray
    scale: np.ndarray
    book: np.ndarray

    def node(self) -> Column:
        """The nearest node of a row, the first of several; null where a feature is null. By squared distances less the
        row's own square, summed in one order."""
        return F.when(reduce(and_, (F.col(f).isNotNull() for f in self.features)), _nearest(self.mean, self.scale, self.book)(*(F.col(f).cast("double") for f in self.features)))


def _nearest(mean: np.ndarray, scale: np.ndarray, book: np.ndarray):
    @F.pandas_udf("int")
    def nearest(*columns: pd.Series) -> pd.Series:
        away = np.zeros((len(columns[0]), len(book)))
        for x, m, s, v in zip(columns, mean, scale, book.T, strict=True):
            z = (x.to_numpy(dtype=float) - m) / s
            away += v * v - (2.0 * v) * z[:, None]
        return pd.Series(away.argmin(axis=1).astype(np.int32))

    return nearest


def nodes(x: np.ndarray, book: np.ndarray) -> np.ndarray:
    d = (book**2).sum(axis=1)[None] - 2 * x @ book.T
    return d.argmin(axis=1)


def _summed(features: list[str], mean: np.ndarray, scale: np.ndarray, book: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(book), len(features) + 1))
        for batch in batches:
            x = (np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features]).astype(float) - mean) / scale
            at = nodes(x, book)
            sums[:, 0] += np.bincount(at, minlength=len(book))
            for j in range(len(features)):
                sums[:, j + 1] += np.bincount(at, weights=x[:, j], minlength=len(book))
        yield pa.RecordBatch.from_pydict({"node": np.repeat(np.arange(len(book), dtype=np.int32), sums.shape[1]), "j": np.tile(np.arange(sums.shape[1], dtype=np.int32), len(book)), "value": sums.ravel()})

    return run


def fit(cells: DataFrame, features: list[str], rows: int = 8, columns: int = 8, rounds: int = 10, seed: int = 0) -> Map:
    """A map over all cells with every feature. It starts from a hash sample of a cell a node; the neighbourhood shrinks
    from half the grid to half a node. Equal cells in any order and partitions give the same start."""
    known = cells.select(*(F.col(f).cast("double").alias(f) for f in features)).dropna()
    about = known.agg(*(a for f in features for a in (F.avg(f), F.stddev_pop(f)))).first()
    mean = np.array([m or 0.0 for m in about[0::2]])
    scale = np.array([s if s and s > 1e-9 else 1.0 for s in about[1::2]])
    size = rows * columns
    first = known.distinct().orderBy(F.xxhash64(*features, F.lit(seed)), *features).limit(size).collect()  # a row a node
    start = (np.array([tuple(r) for r in first], dtype=float).reshape(-1, len(features)) - mean) / scale
    book = start[np.arange(size) % max(1, len(start))] if len(start) else np.zeros((size, len(features)))
    grid = np.stack(np.meshgrid(np.arange(rows), np.arange(columns), indexing="ij"), -1).reshape(-1, 2)
    away = ((grid[:, None] - grid[None]) ** 2).sum(-1)
    wide = max(rows, columns) / 2
    for k in range(rounds if len(start) else 0):
        sums = np.zeros((size, len(features) + 1))
        for r in known.mapInArrow(_summed(features, mean, scale, book), "node int, j int, value double").groupBy("node", "j").agg(F.sum("value").alias("value")).collect():
            sums[r["node"], r["j"]] = r["value"]
        reach = wide * (0.5 / wide) ** (k / max(1, rounds - 1))
        pulled = np.exp(-away / (2 * reach**2)) @ sums
        book = np.where(pulled[:, :1] > 1e-9, pulled[:, 1:] / np.maximum(pulled[:, :1], 1e-9), book)
    return Map(list(features), mean, scale, book)


def node_table(reference: DataFrame, fitted: Map, hidden: list[str]) -> DataFrame:
    """node, n and, for each hidden marker, low, high, and the width of a normal kernel by the rule of thumb: nine tenths of
    the lesser of the sample deviation and the quartiles' distance over 1.34, by the fifth root of n."""
    placed = reference.select(fitted.node().alias("node"), *(F.col(h).cast("double").alias(h) for h in hidden)).where("node is not null").dropna()
    out = placed.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *(a for h in hidden for a in (F.min(h).alias(f"low_{h}"), F.max(h).alias(f"high_{h}"), F.stddev_samp(h).alias(f"__s_{h}"))))
    for h in hidden:
        quarters = large_quantiles(placed, ["node"], h, [0.25, 0.75]).select("node", ((F.col("quantiles")[1] - F.col("quantiles")[0]) / 1.34).alias(f"__q_{h}"))
        out = out.join(quarters, "node")
        s, q = F.col(f"__s_{h}"), F.col(f"__q_{h}")
        least = F.least(s, q)
        spread = F.when(least > 0, least).when(s > 0, s).when(F.abs(f"low_{h}") > 0, F.abs(f"low_{h}")).otherwise(1.0)  # a node of one value has that
        out = out.withColumn(f"width_{h}", 0.9 * spread * F.pow("n", F.lit(-0.2)))
    return out.select("node", "n", *(f"{kind}_{h}" for h in hidden for kind in ("low", "high", "width")))


def normal(key: list[str | Column], salt: str) -> Column:
    """A standard normal number from two hashes of the key."""
    one, two = ((uniform(key, f"{salt}-{part}") + F.lit(0.5)) / F.lit(float(1 << 31)) for part in ("radius", "angle"))
    return F.sqrt(-2 * F.log(one)) * F.cos(F.lit(2 * np.pi) * two)


def draw(queries: DataFrame, reference: DataFrame, shared: list[str], hidden: list[str], key: list[str], least: int = 50, rows: int = 8, columns: int = 8, seed: int = 0, rounds: int = 10, fitted: Map | None = None, reference_key: list[str] | None = None) -> DataFrame:
    """queries with predicted_<h> and abstained.

    The map is fitted on all reference and query cells. A query takes a reference cell of its node, picked by a hash of its
    key, plus normal noise of the node's width, held to the node's range; nodes with fewer than `least` reference cells
    abstain, and the reference median stands in, as it does for queries with a null marker. key: columns that tell queries
    apart; reference_key: those that order the reference (by default the key's).
    """
    reference_key = reference_key or key
    if fitted is None:
        fitted = fit(reference.select(*shared).unionByName(queries.select(*shared)), shared, rows, columns, rounds, seed)
    middles = {h: large_quantiles(reference.select(F.lit(1).alias("one"), F.col(h).cast("double").alias(h)), ["one"], h, [0.5]).first() for h in hidden}
    middle = {h: float(r["quantiles"][0]) if r else float("nan") for h, r in middles.items()}
    table = node_table(reference, fitted, hidden)
    placed = reference.select(fitted.node().alias("node"), *reference_key, *(F.col(h).cast("double").alias(f"__y_{h}") for h in hidden)).where("node is not null").dropna(subset=[f"__y_{h}" for h in hidden])
    sizes = placed.groupBy("node").agg(F.ceil(F.count(F.lit(1)) / SHARE).alias("__salts"))
    order = F.xxhash64(*reference_key, F.lit(seed))
    salted = placed.join(sizes, "node").withColumn("__salt", F.pmod(order, F.col("__salts")))
    numbered = salted.withColumn("__local", F.row_number().over(W.partitionBy("node", "__salt").orderBy(order, *reference_key)) - 1)
    counted = salted.groupBy("node", "__salt").agg(F.count(F.lit(1)).alias("__m"))
    starts = counted.withColumn("__start", F.sum("__m").over(W.partitionBy("node").orderBy("__salt")) - F.col("__m"))
    starts = starts.groupBy("node").agg(F.collect_list(F.struct("__salt", "__start", "__m")).alias("__starts"))  # a part a SHARE of the node
    asked = queries.withColumn("__node", fitted.node())
    about = table.where(F.col("n") >= least).join(starts, "node").withColumnRenamed("node", "__of")
    asked = asked.join(about, F.col("__node") == F.col("__of"), "left")
    asked = asked.withColumn("__pick", F.pmod(F.xxhash64(*key, F.lit(f"{seed}-pick")), F.col("n")))
    part = F.get(F.filter("__starts", lambda p: (p["__start"] <= F.col("__pick")) & (F.col("__pick") < p["__start"] + p["__m"])), F.lit(0))
    asked = asked.withColumn("__part", part).withColumns({"__at_salt": F.col("__part.__salt"), "__at": F.col("__pick") - F.col("__part.__start")})
    values = numbered.select(F.col("node").alias("__n2"), F.col("__salt").alias("__s2"), F.col("__local").alias("__l2"), *(f"__y_{h}" for h in hidden))
    drawn = asked.join(values, (F.col("__node") == F.col("__n2")) & (F.col("__at_salt") == F.col("__s2")) & (F.col("__at") == F.col("__l2")), "left")
    gone = F.col("__n2").isNull()
    noisy = {h: F.least(F.greatest(F.col(f"__y_{h}") + normal(key, f"{seed}-{h}") * F.col(f"width_{h}"), F.col(f"low_{h}")), F.col(f"high_{h}")) for h in hidden}
    return drawn.select(*queries.columns, *(F.when(gone, F.lit(middle[h])).otherwise(noisy[h]).alias(f"predicted_{h}") for h in hidden), gone.alias("abstained"))


def coverage(queries: DataFrame, reference: DataFrame, fitted: Map, least: int = 50) -> DataFrame:
    """node, n_query, n_reference and whether its queries are covered: nodes that any query falls in."""
    sides = [t.select(fitted.node().alias("node")).where("node is not null").groupBy("node").agg(F.count(F.lit(1)).alias(name)) for t, name in ((queries, "n_query"), (reference, "n_reference"))]
    joined = sides[0].join(sides[1], "node", "left").withColumn("n_reference", F.coalesce("n_reference", F.lit(0)))
    return joined.select("node", "n_query", "n_reference", (F.col("n_reference") >= least).alias("covered"))
