"""How well predicted cells keep what markers have in common: kernel distance of populations, and errors of correlations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gramian

BLOCK = 200  # sums of one aggregate


def frequencies(markers: int, n: int, bandwidth: float, seed: int) -> np.ndarray:
    """n random frequencies of the Gaussian kernel exp(-|x - y|**2 / (2 bandwidth**2)), one a row."""
    return np.random.default_rng(seed).normal(0.0, 1.0 / bandwidth, (n, markers))


def _waves(omega: np.ndarray, markers: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([batch.column(m).to_numpy(zero_copy_only=False) for m in markers]).astype(float)
            if not len(x):
                continue
            names = batch.column("group").dictionary_encode()
            codes = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + batch.column("side").to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            own, first = np.unique(codes[order], return_index=True)
            phase = x[order] @ omega.T
            sums = np.add.reduceat(np.column_stack([np.ones(len(x)), np.cos(phase), np.sin(phase)]), first, axis=0)
            of = np.array([*names.dictionary.to_pylist(), None], dtype=object)[own // 2]
            yield pa.RecordBatch.from_arrays([pa.array(of, pa.string()), pa.array((own % 2).astype(np.int32)), *(pa.array(np.ascontiguousarray(s)) for s in sums.T)], names=["group", "side", *(f"s{k}" for k in range(sums.shape[1]))])

    return run


def embeddings(points: DataFrame, group: str, markers: list[str], omega: np.ndarray) -> DataFrame:
    """group, side, k, value: sums over cells of 1 (k = 0) and of the cosines and sines of each frequency.

    Batches sum their own cells, all groups of a batch at once and none held beyond it; a row a group and side of a batch
    goes on, with up to BLOCK sums side by side. points: group, side (0 or 1), markers; cells with a null
    marker are left out.
    """
    picked = points.select(F.col(group).cast("string").alias("group"), F.col("side").cast("int").alias("side"), *(F.col(m).cast("double").alias(m) for m in markers)).dropna(subset=markers)
    names = [f"s{k}" for k in range(1 + 2 * len(omega))]
    summed = picked.where("group is not null and side is not null").mapInArrow(_waves(omega, markers), ", ".join(["group string", "side int", *(f"{c} double" for c in names)]))
    if len(names) <= BLOCK:
        wide = summed.groupBy("group", "side").agg(*(F.sum(c).alias(c) for c in names))
        return wide.select("group", "side", F.posexplode(F.array(*names)).alias("k", "value"))
    each = summed.select("group", "side", F.posexplode(F.array(*names)).alias("k", "value"))
    return each.groupBy("group", "side", "k").agg(F.sum("value").alias("value"))


def mmd(points: DataFrame, group: str, markers: list[str], omega: np.ndarray) -> DataFrame:
    """group, n0, n1, mmd2: the squared kernel distance of the two sides' mean embeddings; null where a side is empty.

    An estimate of the (biased) squared maximum mean discrepancy; its error falls with the root of the frequencies.
    """
    sums = embeddings(points, group, markers, omega)
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("value")))
    sizes = sums.where("k = 0").groupBy("group").agg(side(0).alias("n0"), side(1).alias("n1"))
    waves = sums.where("k > 0").groupBy("group", "k").agg(side(0).alias("s0"), side(1).alias("s1"))
    gap = F.col("s0") / F.col("n0") - F.col("s1") / F.col("n1")
    per = waves.join(sizes, "group").groupBy("group").agg(F.first("n0").cast("long").alias("n0"), F.first("n1").cast("long").alias("n1"), (F.sum(gap * gap) / F.lit(float(len(omega)))).alias("mmd2"))
    return per.select(F.col("group").alias(group), F.coalesce("n0", F.lit(0)).alias("n0"), F.coalesce("n1", F.lit(0)).alias("n1"), F.when((F.col("n0") > 0) & (F.col("n1") > 0), F.col("mmd2")).alias("mmd2"))


def correlations(points: DataFrame, group: str, markers: list[str]) -> DataFrame:
    """group, i, j (i < j, places in markers), n and the Pearson correlation; null where a marker does not vary."""
    sums = gramian.products(points, [F.col(m) for m in markers], F.col(group))
    one = sums.where("i = 0").select("group", F.col("j").alias("m"), F.col("value").alias("sum"))
    own = sums.where("i = j and i > 0").select("group", F.col("i").alias("m"), F.col("value").alias("square"))
    n = sums.where("i = 0 and j = 0").select("group", F.col("value").alias("n"))
    each = one.where("m > 0").join(own, ["group", "m"]).join(n, "group")
    each = each.select("group", "m", "n", (F.col("sum") / F.col("n")).alias("mean"), (F.col("square") / F.col("n") - F.pow(F.col("sum") / F.col("n"), 2)).alias("variance"))
    a = each.select("group", F.col("m").alias("i"), "n", F.col("mean").alias("mi"), F.col("variance").alias("vi"))
    b = each.select("group", F.col("m").alias("j"), F.col("mean").alias("mj"), F.col("variance").alias("vj"))
    pairs = sums.where("i > 0 and i < j").join(a, ["group", "i"]).join(b, ["group", "j"])
    flat = 1e-12
    varies = (F.col("vi") > flat * F.greatest(F.lit(1.0), F.pow("mi", 2))) & (F.col("vj") > flat * F.greatest(F.lit(1.0), F.pow("mj", 2)))
    r = F.when(varies, (F.col("value") / F.col("n") - F.col("mi") * F.col("mj")) / F.sqrt(F.col("vi") * F.col("vj")))
    return pairs.select(F.col("group").alias(group), (F.col("i") - 1).alias("i"), (F.col("j") - 1).alias("j"), F.col("n").cast("long").alias("n"), r.alias("correlation"))


def joint_error(points: DataFrame, group: str, markers: list[str]) -> DataFrame:
    """group, n_pairs, mean_error, worst_error: how far the correlations of side 0 lie from those of side 1.

    Pairs of markers of which either side has no correlation are left out.
    """
    sides = [correlations(points.where(F.col("side") == s), group, markers).select(group, "i", "j", F.col("correlation").alias(f"r{s}")) for s in (0, 1)]
    gaps = sides[0].join(sides[1], [group, "i", "j"]).withColumn("gap", F.abs(F.col("r0") - F.col("r1"))).where("gap is not null")
    return gaps.groupBy(group).agg(F.count("gap").alias("n_pairs"), F.avg("gap").alias("mean_error"), F.max("gap").alias("worst_error"))
