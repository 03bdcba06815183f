"""Percentile bootstrap of means. Draws are seeded by the group's name, so an interval depends on nothing else."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scales import finite
from .sampling import stable_seed

REPLICATES = 2000


def interval(values: np.ndarray, replicates: int, seed: int, block: int = 1 << 22) -> tuple[float, float]:
    """2.5 and 97.5 hundredths of the means of resamples; nan without values."""
    values = values[np.isfinite(values)]
    if not len(values):
        return float("nan"), float("nan")
    rng, means, step = np.random.RandomState(seed), [], max(1, block // len(values))
    for a in range(0, replicates, step):
        means.append(values[rng.randint(0, len(values), size=(min(step, replicates - a), len(values)))].mean(axis=1))
    low, high = np.quantile(np.concatenate(means), (0.025, 0.975))
    return float(low), float(high)


def intervals(rows: DataFrame, groups: list[str], metrics: list[str], replicates: int = REPLICATES, seed: int = 4207) -> DataFrame:
    """groups, metric, ci_lower, ci_upper; a group holds a value a patient, so it is small. Null groups count."""
    long = rows.select(*groups, *(finite(F.col(m)).alias(m) for m in metrics)).unpivot(groups, metrics, "metric", "value")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        first = frame.iloc[0]
        key = [str(first[g]) for g in [*groups, "metric"]]
        low, high = interval(np.sort(frame["value"].to_numpy(dtype=float)), replicates, stable_seed(seed, *key))
        return pd.DataFrame({**{g: [first[g]] for g in groups}, "metric": [first["metric"]], "ci_lower": [None if np.isnan(low) else low], "ci_upper": [None if np.isnan(high) else high]})

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in long.schema if f.name in groups), "metric string, ci_lower double, ci_upper double"])
    return long.groupBy(*groups, "metric").applyInPandas(run, schema)


def summarize(rows: DataFrame, groups: list[str], metrics: list[str], patient: str = "patient", replicates: int | None = REPLICATES, seed: int = 4207) -> DataFrame:
    """groups, n_patients and per metric mean, median and (with replicates) interval; values that are not finite are left out."""
    fine = rows.select(*groups, patient, *(finite(F.col(m)).alias(m) for m in metrics))
    wide = fine.groupBy(*groups).agg(F.countDistinct(patient).alias("n_patients"), *(a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.percentile(m, F.lit(0.5)).alias(f"{m}_median"))))
    if replicates is None:
        return wide
    cis = intervals(fine, groups, metrics, replicates, seed).groupBy(*groups).agg(*(F.max(F.when(F.col("metric") == m, F.col(f"ci_{side}"))).alias(f"{m}_ci_{side}") for m in metrics for side in ("lower", "upper")))
    same = F.lit(True)
    for g in groups:
        same = same & wide[g].eqNullSafe(cis[g])
    return wide.join(cis, same).select(wide["*"], *(cis[f"{m}_ci_{side}"] for m in metrics for side in ("lower", "upper")))
