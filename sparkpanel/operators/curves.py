"""Fits on growing numbers of patients: one pass over the cells, one plan for all counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import gramian
from .models import Ridge
from .sampling import priority


def patient_order(rows: DataFrame, seed: int | str, patient: str = "patient_id") -> DataFrame:
    """group, place: patients in hash order from 1, so that the first n lie in the first n + 1. A row a patient."""
    patients = rows.select(F.col(patient).alias("group")).distinct()
    return patients.withColumn("place", F.row_number().over(W.orderBy(priority(["group"], seed), "group")))


def nested_ridges(rows: DataFrame, features: list[str], targets: list[str], counts: list[int], seed: int | str, alpha: float = 1.0, patient: str = "patient_id") -> dict[int, Ridge]:
    """The ridge on the first so many patients, for each count that there are patients for.

    Columns are moved to their overall mean before they are multiplied, so that sums of squares lose no digits. What
    reaches the driver is a matrix a count.
    """
    columns = [*features, *targets]
    centre = rows.agg(*(F.coalesce(F.avg(c), F.lit(0.0)) for c in columns)).first()
    moved = [F.col(c) - F.lit(float(m)) for c, m in zip(columns, centre, strict=True)]
    sums = gramian.products(rows, moved, F.col(patient))
    found: dict[int, list] = {}
    for r in gramian.prefixes(sums, patient_order(rows, seed, patient), counts).collect():
        found.setdefault(r["count"], []).append(r)
    k, out = len(features), {}
    for count in sorted(found):
        mean, scale, weights, level = gramian.ridge(gramian.matrix(found[count], 1 + len(columns)), k, alpha)
        out[count] = Ridge(features, targets, [], mean + centre[:k], scale, weights, level + centre[k:], None)
    return out


def along(models: dict[int, Ridge], rows: DataFrame) -> DataFrame:
    """rows once for each model, with count and predicted_<target>: one projection over one scan, whatever the counts."""
    targets = next(iter(models.values())).targets
    each = []
    for count, model in models.items():
        columns = {t: sum((x * F.lit(float(w)) for x, w in zip(model.terms(), model.weights[:, j], strict=True)), F.lit(float(model.intercept[j]))) for j, t in enumerate(targets)}
        each.append(F.struct(F.lit(count).alias("count"), *(c.alias(f"predicted_{t}") for t, c in columns.items())))
    return rows.withColumn("__x", F.explode(F.array(*each))).select(*rows.columns, "__x.*")
