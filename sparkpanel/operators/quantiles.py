"""Exact quantiles of groups of any size.

Spark's percentile() keeps every distinct value of a group in one buffer, which suits specimens and patients but not a
marker over a whole cohort. Here few groups of any size are counted in ever narrower ranges: each round reads the rows
once, counts at most BUCKETS ranges an interval with map-side sums, and keeps for each order statistic the range that holds
it, bounded by values that occur. A few rounds leave ranges of a handful of values.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 2048
GROUPS = 10_000  # groups that the driver keeps intervals for, at most


def large_quantiles(rows: DataFrame, keys: list[str], value: str, probabilities: list[float]) -> DataFrame:
    """keys, quantiles (array, in the order of probabilities): linear interpolation between order statistics.

    Null and non-finite values are left out.
    """
    spark = rows.sparkSession
    v = F.col(value).cast("double")
    fine = rows.select(*keys, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < F.lit(float("inf"))))
    found = fine.groupBy(*keys).agg(F.count(F.lit(1)), F.min("__v"), F.max("__v")).limit(GROUPS + 1).collect()
    if len(found) > GROUPS:
        raise ValueError(f"more than {GROUPS} groups; use percentile()")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), "__lo double", "__hi double"])
    groups = [tuple(r[: len(keys)]) for r in found]
    sizes = [int(r[len(keys)]) for r in found]
    wanted = {(g, k): (float(found[g][-2]), float(found[g][-1]), k) for g in range(len(found)) for p in probabilities for k in _places(sizes[g], p)[:2]}  # interval, rank within it
    exact: dict[tuple[int, int], float] = {}
    while open_ := {t: s for t, s in wanted.items() if t not in exact}:
        for t, (lo, hi, _) in open_.items():
            if lo == hi:
                exact[t] = lo
        intervals = sorted({(t[0], s[0], s[1]) for t, s in open_.items() if t not in exact})
        if not intervals:
            break
        table = spark.createDataFrame([(*groups[g], lo, hi) for g, lo, hi in intervals], schema).withColumnsRenamed({k: f"__k_{k}" for k in keys})
        here = (F.col("__v") >= F.col("__lo")) & (F.col("__v") <= F.col("__hi"))
        for k in keys:
            here = here & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
        bucket = F.least(F.lit(BUCKETS - 1), F.floor((F.col("__v") - F.col("__lo")) / (F.col("__hi") - F.col("__lo")) * BUCKETS)).cast("int")
        names = [*(f"__k_{k}" for k in keys), "__lo", "__hi"]
        counted = fine.join(F.broadcast(table), here).groupBy(*names, bucket.alias("__b")).agg(F.count(F.lit(1)), F.min("__v"), F.max("__v")).collect()
        place = {g: i for i, g in enumerate(groups)}
        ranges: dict[tuple, list] = {}
        for r in counted:
            ranges.setdefault((place[tuple(r[: len(keys)])], r["__lo"], r["__hi"]), []).append((r["__b"], *r[-3:]))
        for t, (lo, hi, rank) in open_.items():
            if t in exact:
                continue
            for _, n, low, high in sorted(ranges[(t[0], lo, hi)]):
                if rank < n:
                    wanted[t] = (low, high, rank)
                    break
                rank -= n
    out = []
    for g, key in enumerate(groups):
        values = []
        for p in probabilities:
            a, b, share = _places(sizes[g], p)
            values.append(exact[(g, a)] + share * (exact[(g, b)] - exact[(g, a)]))
        out.append((*key, values))
    return spark.createDataFrame(out, ", ".join([*(f"`{k}` {types[k]}" for k in keys), "quantiles array<double>"]))


def _places(n: int, p: float) -> tuple[int, int, float]:
    at = (n - 1) * p
    low = int(np.floor(at))
    return low, min(low + 1, n - 1), at - low
