"""Screens beyond single panels: ridge skill of every marker subset from one Gramian, contributions, Pareto fronts, risk
against coverage, energy distances, and agreement of neighbourhoods."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import neighbours


def gramian(rows: DataFrame, columns: list[str]) -> tuple[float, np.ndarray, np.ndarray]:
    """Number of rows, means, and centred products of columns: one aggregate, whatever the number of rows."""
    k = len(columns)
    row = rows.agg(F.count(F.lit(1)), *(F.sum(c) for c in columns), *(F.sum(F.col(columns[i]) * F.col(columns[j])) for i in range(k) for j in range(i, k))).first()
    n, means = float(row[0]), np.array(row[1 : 1 + k], dtype=float) / max(1, row[0])
    products, at = np.zeros((k, k)), 1 + k
    for i in range(k):
        for j in range(i, k):
            products[i, j] = products[j, i] = float(row[at])
            at += 1
    return n, means, products - n * np.outer(means, means)


def subset_skill(fit: DataFrame, test: DataFrame, features: list[str], targets: list[str], alpha: float = 1.0) -> DataFrame:
    """subset (names joined by +), size, target, r_squared on the test rows, for each non-empty subset of features.

    Both tables are read once; 2**features - 1 small systems are solved on the driver (511 for nine features).
    """
    if len(features) > 12:
        raise ValueError("at most twelve features are screened")
    columns, p = [*features, *targets], len(features)
    n, mean, c = gramian(fit, columns)
    m, test_mean, t = gramian(test, columns)
    scale = np.sqrt(np.maximum(np.diag(c)[:p] / n, 1e-24))
    out = []
    for size in range(1, p + 1):
        for chosen in combinations(range(p), size):
            at = list(chosen)
            s = scale[at]
            weights = np.linalg.solve(c[np.ix_(at, at)] / np.outer(s, s) + alpha * np.eye(size), c[np.ix_(at, range(p, len(columns)))] / s[:, None]) / s[:, None]
            for j, target in enumerate(targets):
                w = weights[:, j]
                shift = (mean[p + j] - mean[at] @ w) - (test_mean[p + j] - test_mean[at] @ w)  # bias carried over from the fit
                error = t[p + j, p + j] - 2 * w @ t[at, p + j] + w @ t[np.ix_(at, at)] @ w + m * shift**2
                total = t[p + j, p + j] + m * (mean[p + j] - test_mean[p + j]) ** 2
                out.append(("+".join(features[i] for i in at), size, target, float(1 - error / total) if total > 0 else None))
    return fit.sparkSession.createDataFrame(out, "subset string, size int, target string, r_squared double")


def contributions(skill: dict[frozenset, float], markers: list[str]) -> dict[str, float]:
    """Shapley value of each marker: its mean gain over all orders; skill of the empty set is 0 unless given."""
    n = len(markers)
    value = lambda s: skill.get(frozenset(s), 0.0)
    return {m: sum((value({*s, m}) - value(s)) / (n * comb(n - 1, len(s))) for k in range(n) for s in combinations([x for x in markers if x != m], k)) for m in markers}


def interactions(skill: dict[frozenset, float], a: str, b: str) -> float:
    value = lambda *s: skill.get(frozenset(s), 0.0)
    return value(a, b) - value(a) - value(b) + value()


def pareto_front(rows: DataFrame, cost: str, gain: str) -> DataFrame:
    """Rows that no other row beats: none costs at most as much and gains more, or costs less and gains as much.

    One ordered pass over the costs, which are few: panels, not cells.
    """
    best = rows.groupBy(cost).agg(F.max(gain).alias("__best"))
    before = best.withColumn("__before", F.max("__best").over(W.orderBy(cost).rowsBetween(W.unboundedPreceding, -1)))
    front = before.where(F.col("__before").isNull() | (F.col("__best") > F.col("__before"))).select(F.col(cost).alias("__cost"), "__best")
    return rows.join(F.broadcast(front), (F.col(cost) == F.col("__cost")) & (F.col(gain) == F.col("__best"))).drop("__cost", "__best")


def risk_coverage(rows: DataFrame, groups: list[str], uncertainty: str, error: str, key: list[str], parts: int = 10) -> DataFrame:
    """groups, part, coverage, risk: mean error of the rows kept when the least uncertain parts are answered."""
    cut = rows.withColumn("part", F.ntile(parts).over(W.partitionBy(*groups).orderBy(uncertainty, *key)))
    per = cut.groupBy(*groups, "part").agg(F.count(F.lit(1)).alias("__n"), F.sum(error).alias("__e"))
    upto, every = W.partitionBy(*groups).orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow), W.partitionBy(*groups)
    return per.select(*groups, "part", (F.sum("__n").over(upto) / F.sum("__n").over(every)).alias("coverage"), (F.sum("__e").over(upto) / F.sum("__n").over(upto)).alias("risk"))


def energy_distance(points: DataFrame, groups: list[str], side: str = "side", value: str = "value") -> DataFrame:
    """groups, energy: twice the integral of the squared difference of both distribution functions."""
    masses = points.groupBy(*groups, value).agg(F.count(F.when(F.col(side) == 0, 1)).alias("__a"), F.count(F.when(F.col(side) == 1, 1)).alias("__b"))
    order, every = W.partitionBy(*groups).orderBy(value), W.partitionBy(*groups)
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    gap = F.try_divide(F.sum("__a").over(upto), F.sum("__a").over(every)) - F.try_divide(F.sum("__b").over(upto), F.sum("__b").over(every))
    return masses.select(*groups, (gap * gap * (F.lead(value).over(order) - F.col(value))).alias("__x"), gap.alias("__g")).groupBy(*groups).agg(F.when(F.count("__g") > 0, 2 * F.coalesce(F.sum("__x"), F.lit(0.0))).alias("energy"))


def positive_fraction_error(points: DataFrame, groups: list[str], threshold: float = 0.0) -> DataFrame:
    """groups, error: absolute difference of the shares of both sides above a threshold."""
    share = lambda s: F.avg(F.when(F.col("side") == s, (F.col("value") > threshold).cast("double")))
    return points.groupBy(*groups).agg(F.abs(share(0) - share(1)).alias("error"))


def marker_status(rows: DataFrame, low: str = "ci_lower", high: str = "ci_upper", margin: float = 0.05) -> DataFrame:
    """rows with status by an interval: unknown, recoverable, weakly_recoverable, equivalent, harmful or inconclusive."""
    a, b = F.col(low), F.col(high)
    state = F.when(a.isNull() | b.isNull(), "unknown").when(a > margin, "recoverable").when((a > -margin) & (b < margin), "equivalent").when(a > 0, "weakly_recoverable").when(b < 0, "harmful")
    return rows.withColumn("status", state.otherwise("inconclusive"))


def neighbourhoods(rows: DataFrame, groups: list[str], key: str, before: list[str], after: list[str], k: int = 15, label: str | None = None) -> DataFrame:
    """groups, n, jaccard (of each cell's k neighbours before and after) and purity (share of `after` neighbours of the
    cell's label), of groups of any size."""
    return neighbours.agreement(rows, groups, key, before, after, k, label)


def two_sample(rows: DataFrame, groups: list[str], key: str, side: str, features: list[str], k: int = 5) -> DataFrame:
    """groups, n, same_side: mean share of a cell's k neighbours that are of its own side (expected: the sides' shares)."""
    return neighbours.mixing(rows, groups, key, side, features, k)
