"""Exact nearest-neighbour imputation: k nearest bank rows by Euclidean distance, ties by bank key, medians of targets.

Two medians are kept apart: "lower" takes the lower middle neighbour where k is even, "mean" the mean of both middles.
Banks of any size go the same way: bank rows are dealt to shards and queries to slices of bounded size, a task searches
one shard for one slice, and the shards' nearest are merged by rank. A task holds its slice and the nearest so far alone;
the shard's rows pass in pieces, in the order of their keys. Rows that occur twice are asked once. A bank of at most
GATHERED rows (a sampled one) goes to every task instead: queries are answered where they are, without a shuffle, and stay
dealt as they were; their other columns do not leave the JVM.
Rows at no finite distance (null, NaN or infinite features) are no neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MOST = 100_000  # bank rows of a shard
SLICE = 20_000  # queries of a slice, at most
HELD = 4 << 20  # values of them and of their nearest that a task holds
PIECE = 10_000  # bank rows that are compared at a time
GATHERED = 20_000  # bank rows that are sent to every task
GATHERED_VALUES = 400_000  # and features and targets of theirs
CHUNK_BYTES = 16 << 20
REMEMBERED = 100_000  # points whose answers a task keeps
PAIRS = 1 << 20  # components of candidates that are compared at a time


def nearest(query: np.ndarray, bank: np.ndarray, k: int, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and squared distances of the k nearest bank rows of each query, nearest first; the bank's order breaks ties.

    before: a query's k least squared distances, ascending, to rows that come before the bank; infinite where it has fewer.
    The j-th of these has place j - k, and so has what the bank lacks. Products find the candidates: all rows whose squared
    distance, by the square of norms less the product, lies within rounding of the k-th. Their distances are then summed
    component by component, and these alone decide.
    """
    own = (bank**2).sum(axis=1)
    finite = np.flatnonzero(np.isfinite(own))
    whole = len(finite) == len(bank)
    if not whole:
        bank, own = bank[finite], own[finite]
    if before is None:
        k = min(k, len(bank))
        before = np.full((len(query), k), np.inf)
    places, distances = np.tile(np.arange(-k, 0), (len(query), 1)), before.copy()
    if not k or not len(bank):
        return places, distances
    step = max(1, CHUNK_BYTES // (16 * len(bank)))
    for a in range(0, len(query), step):
        part, had = query[a : a + step], before[a : a + step]
        norms = (part**2).sum(axis=1)
        about = part @ bank.T
        about *= -2
        about += own
        about += norms[:, None]
        slack = 8 * (bank.shape[1] + 4) * np.finfo(float).eps * (np.sqrt(norms) + np.sqrt(own.max())) ** 2
        bars = had[:, -1].copy()
        open_ = np.flatnonzero(np.isinf(bars))
        if len(open_) and len(bank) > k:
            bars[open_] = np.partition(about[open_], k - 1, axis=1)[:, k - 1]
        held = about <= (bars + 2 * slack)[:, None]
        counts = np.count_nonzero(held, axis=1)
        ends = counts.cumsum()
        alone = np.isinf(had[:, 0]) & (counts >= k)  # nothing comes before, nothing lacks
        low = 0
        while low < len(part):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS // bank.shape[1], side="right")))
            i, j = np.divmod(np.flatnonzero(held[low:high]), len(bank))
            if len(i):
                d2 = np.add.accumulate((part[i + low] - bank[j]) ** 2, axis=1)[:, -1]
                some = np.flatnonzero(counts[low:high])  # queries that have candidates: others keep what they had
                if not alone[low + some].all():
                    i = np.concatenate([np.repeat(some, k), i])
                    j = np.concatenate([np.tile(np.arange(-k, 0), len(some)), j])
                    d2 = np.concatenate([had[low + some].ravel(), d2])
                order = np.lexsort((d2, i))
                i = i[order]
                order = order[np.arange(len(i)) - np.searchsorted(i, i) < k].reshape(-1, k)
                places[a + low + some], distances[a + low + some] = j[order], d2[order]
            low = high
    return places if whole else np.where(places < 0, places, finite[np.maximum(places, 0)]), distances


def middle(x: np.ndarray, rule: str) -> np.ndarray:
    """The median of each row: the lower middle value, or the mean of both middles."""
    x, n = np.sort(x, axis=1), x.shape[1]
    low, high = x[:, (n - 1) // 2], x[:, n // 2]
    return low if rule == "lower" or n % 2 else 0.5 * low + 0.5 * high


def _gathered(queries: DataFrame, bank: DataFrame, features: list[str], targets: list[str], key: list[str], k: int, rule: str, label: str | None) -> DataFrame:
    """impute by a bank of at most GATHERED rows, whose targets are all known."""
    of = F.col(label).cast("string") if label else F.lit(None).cast("string")
    values = [F.col(c).cast("double").alias(f"__v{j}") for j, c in enumerate([*features, *targets])]
    held = bank.orderBy(*key).select(of.alias("__label"), *values).collect()  # at most GATHERED rows
    table = np.array([r[1:] for r in held], dtype=float).reshape(len(held), len(values))
    x, y = table[:, : len(features)], table[:, len(features) :]
    finite = np.isfinite((x**2).sum(axis=1))
    places: dict[str, list[int]] = {}
    for n, r in enumerate(held):
        if r[0] is not None:
            places.setdefault(r[0], []).append(n)
    of_label = {name: np.array([n for n in at if finite[n]], dtype=np.int64) for name, at in places.items()}
    made = [*((f"predicted_{t}", "double") for t in targets), *((f"mad_{t}", "double") for t in targets), ("mean_distance", "double"), ("effective_k", "bigint"), ("used_fallback", "boolean")]

    def answers(points: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Medians, deviations, mean distance and number of neighbours of each point."""
        place, distance = nearest(points, x[rows], k)
        near = [y[rows[place], j] for j in range(len(targets))]
        middles = [middle(v, rule) for v in near]
        mads = [middle(np.abs(v - m[:, None]), rule) for v, m in zip(near, middles, strict=True)]
        out = np.column_stack([*middles, *mads, np.sqrt(distance).mean(axis=1), np.full(len(points), place.shape[1])])
        out[place[:, 0] < 0] = [*np.full(out.shape[1] - 1, np.nan), 0]
        return out

    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        width = 2 * len(targets) + 2
        most = min(REMEMBERED, HELD // (width + len(features)))
        kept_of: dict[str | None, tuple[dict[bytes, int], np.ndarray]] = {}
        for names, *values in batches:
            n = len(names)
            found = np.full((n, width), np.nan)
            found[:, -1] = 0
            points = np.column_stack([v.to_numpy(dtype=float) for v in values])
            places, labels = pd.factorize(names)  # no label has place -1
            known = np.array([*(v in of_label for v in labels), False], dtype=bool)[places]
            groups = [(name, np.flatnonzero(places == j), of_label[name]) for j, name in enumerate(labels) if name in of_label] + [(None, np.flatnonzero(~known), np.flatnonzero(finite))]
            for name, at, rows in groups:
                if not len(at) or not len(rows):
                    continue
                index, table = kept_of.get(name, ({}, np.zeros((0, width))))
                if sum(len(of) for of, _ in kept_of.values()) > most:
                    kept_of.clear()
                    index, table = {}, np.zeros((0, width))
                keys = np.ascontiguousarray(points[at]).view(np.dtype((np.void, 8 * points.shape[1]))).ravel().tolist()
                fresh = {key: i for key, i in zip(keys, at.tolist(), strict=True) if key not in index}
                if fresh:
                    index.update({key: len(table) + i for i, key in enumerate(fresh)})
                    table = np.vstack([table, answers(points[list(fresh.values())], rows)])
                kept_of[name] = index, table
                found[at] = table[[index[key] for key in keys]]
            none = found[:, -1] == 0
            out = {name: np.where(none, np.nan, found[:, j]) for j, (name, _) in enumerate(made[:-2])}
            yield pd.DataFrame({**out, "effective_k": found[:, -1].astype(np.int64), "used_fallback": ~known if label else np.zeros(n, dtype=bool)})

    answered = F.pandas_udf(run, ", ".join(f"`{c}` {t}" for c, t in made))
    out = queries.withColumn("__answer", answered(of, *(F.col(c).cast("double") for c in features)))
    return out.select(*(F.col(f"`{c}`") for c in queries.columns), *(F.col("__answer")[c].alias(c) for c, _ in made))


def _passed(features: int, kept: list[str], k: int):
    """A task's search: its queries (__side 0) come first, then the bank's rows in their order, of which it holds the k
    nearest so far. Yields __id, the kept columns of a near row and __d2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, names, points = [], [], []
        best = None
        for batch in batches:
            for piece in (batch.slice(a, PIECE) for a in range(0, batch.num_rows, PIECE)):
                x = piece.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(-1, features)
                labels = piece.column("__label").to_numpy(zero_copy_only=False)
                n = pc.sum(pc.equal(piece.column("__side"), 0)).as_py()
                if n:
                    ids.append(piece.column("__id").slice(0, n))
                    names.append(labels[:n])
                    points.append(x[:n].copy())
                if n == len(x) or not ids:
                    continue
                if best is None:
                    asked, name = np.concatenate(points), pd.Series(np.concatenate(names), dtype=object)
                    points.clear()
                    of = {**name.groupby(name).indices, None: np.flatnonzero(name.isna())}
                    best = np.full((len(asked), k), np.inf)
                    rows = {c: pa.nulls(best.size, piece.schema.field(c).type) for c in kept}
                bank, name = x[n:], pd.Series(labels[n:], dtype=object)
                source = np.arange(best.size).reshape(best.shape)
                for label, here in {**name.groupby(name).indices, None: np.arange(len(bank))}.items():
                    at = of.get(label, ())
                    if len(at):
                        place, best[at] = nearest(asked[at], bank[here], k, best[at])
                        source[at] = np.where(place < 0, source[at, -1:] + 1 + place, best.size + here[np.maximum(place, 0)])
                if source.max() >= best.size:
                    rows = {c: pa.concat_arrays([rows[c], piece.column(c).slice(n)]).take(pa.array(source.ravel())) for c in kept}
        if best is None:
            return
        found, id_ = np.flatnonzero(np.isfinite(best)), pa.concat_arrays(ids)
        for a in range(0, len(found), PIECE):
            at = found[a : a + PIECE]
            yield pa.RecordBatch.from_arrays([id_.take(pa.array(at // k)), *(rows[c].take(pa.array(at)) for c in kept), pa.array(best.ravel()[at])], names=["__id", *kept, "__d2"])

    return run


def impute(queries: DataFrame, bank: DataFrame, features: list[str], targets: list[str], key: list[str], k: int = 50, rule: str = "lower", label: str | None = None) -> DataFrame:
    """queries with predicted_<t> and mad_<t> for each target, mean_distance, effective_k and used_fallback.

    key: columns that order the bank, in their own order. label: neighbours have the query's label; a label that the
    bank lacks falls back to the whole bank. Without any bank row predictions are null and effective_k is 0.
    """
    if rule not in ("lower", "mean"):
        raise ValueError("rule is lower or mean")
    lacking = [F.count(F.when(F.col(t).isNull() | F.isnan(F.col(t).cast("double")), 1)) for t in targets]
    size, *gaps = bank.agg(F.count(F.lit(1)), *lacking).first()
    if size <= min(GATHERED, MOST, GATHERED_VALUES // max(1, len(features) + len(targets))) and not any(gaps):
        return _gathered(queries, bank, features, targets, key, k, rule, label)
    doubles = lambda names: F.array(*(F.col(c).cast("double") for c in names))
    keys = {f"__k{j}": c for j, c in enumerate(key)}
    types = ", ".join(f"{n} {bank.schema[c].dataType.simpleString()}" for n, c in keys.items())
    of = F.col(label).cast("string") if label else F.lit(None).cast("string")
    named = queries.withColumn("__id", F.md5(F.to_json(F.struct(*queries.columns), {"ignoreNullFields": "false"}))).withColumn("__label", of)
    slice_ = max(1, min(SLICE, HELD // (len(features) + k * (len(key) + len(targets) + 2))))
    shards, slices = max(1, -(-size // MOST)), max(1, -(-queries.count() // slice_))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bucket = lambda columns, n: F.pmod(F.xxhash64(*columns), F.lit(n)).cast("int")
    if label:
        known = bank.select(of.alias("__known")).where("__known is not null").distinct()
        named = named.join(known, F.col("__label") == F.col("__known"), "left")
    else:
        named = named.withColumn("__known", F.lit(None).cast("string"))
    ys = [f"__y{j}" for j in range(len(targets))]
    asked = named.dropDuplicates(["__id"]).select(
        F.lit(0).alias("__side"), "__id", F.col("__known").alias("__label"), doubles(features).alias("__x"), *(F.lit(None).cast(bank.schema[c].dataType).alias(n) for n, c in keys.items()),
        *(F.lit(None).cast("double").alias(y) for y in ys), bucket(["__id"], slices).alias("__slice"), spread(shards).alias("__shard"),
    )
    dealt = bank.select(
        F.lit(1).alias("__side"), F.lit(None).cast("string").alias("__id"), of.alias("__label"), doubles(features).alias("__x"), *(F.col(c).alias(n) for n, c in keys.items()),
        *(F.col(t).cast("double").alias(y) for y, t in zip(ys, targets, strict=True)), spread(slices).alias("__slice"), bucket(key, shards).alias("__shard"),
    )
    met = asked.unionByName(dealt).repartitionById(slices * shards, F.col("__slice") * shards + F.col("__shard")).sortWithinPartitions("__side", *keys)
    found = met.drop("__slice", "__shard").mapInArrow(_passed(len(features), [*keys, *ys], k), f"__id string, {types}, {''.join(f'{y} double, ' for y in ys)}__d2 double")
    near = found.withColumn("__rank", F.row_number().over(W.partitionBy("__id").orderBy("__d2", *keys))).where(F.col("__rank") <= k)
    pick = (lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c})")) if rule == "lower" else (lambda c: F.percentile(F.expr(c), F.lit(0.5)))
    placed = near.withColumns({f"__m{j}": pick(y).over(W.partitionBy("__id")) for j, y in enumerate(ys)})
    middles = placed.groupBy("__id").agg(
        *(F.first(f"__m{j}").alias(f"predicted_{t}") for j, t in enumerate(targets)), *(pick(f"abs(__y{j} - __m{j})").alias(f"mad_{t}") for j, t in enumerate(targets)),
        F.avg(F.sqrt("__d2")).alias("mean_distance"), F.count(F.lit(1)).alias("effective_k"),
    )
    fallback = F.col("__known").isNull() if label else F.lit(False)
    out = named.join(middles, "__id", "left")
    return out.select(*queries.columns, *(f"predicted_{t}" for t in targets), *(f"mad_{t}" for t in targets), "mean_distance", F.coalesce("effective_k", F.lit(0)).alias("effective_k"), fallback.alias("used_fallback"))
