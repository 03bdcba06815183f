"""Representations of translated cells: what a probe is given, at a stated number of paired patients.

A translation point holds the baseline from shared markers, three residual models taught by transport between paired
specimens (shared markers alone; with the source's own markers shuffled; with them as they are) and a gate a marker.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import metrics, models, ranks, sampling, transport
from ..sources.shared import kept
from . import probe
from .runs import KEYS, CrossPanel, _iqr

RESIDUALS = ("h_residual", "h_shuffled_x", "h_plus_x")


@dataclass(frozen=True)
class Point:
    """Fitted models of one number of paired patients."""

    spec: CrossPanel
    base: models.Ridge
    target_only: models.Network
    residuals: dict[str, models.Network]
    gates: dict[str, float]
    specimens: list[str]


def paired_specimens(source: DataFrame, target: DataFrame, roles: DataFrame, count: int | str, seed: int) -> list[str]:
    """Specimens that both sides have of the first `count` train patients; sets of growing count are nested."""
    train = roles.where("role = 'train'").select("specimen_id").distinct()
    both = source.select("patient_id", "specimen_id").distinct().join(target.select("specimen_id").distinct(), "specimen_id", "leftsemi").join(train, "specimen_id", "leftsemi")
    of: dict[str, list[str]] = {}
    for patient, specimen in both.select("patient_id", "specimen_id").collect():  # a row a specimen
        of.setdefault(patient, []).append(specimen)
    return sampling.patient_prefix(sorted(of), of, count, seed)


def fit_point(source: DataFrame, target: DataFrame, roles: DataFrame, spec: CrossPanel, count: int | str = "all") -> Point:
    """source, target: patient_id, specimen_id, cell_id, cell_type and markers in one space; roles: specimen_id, role."""
    def of(rows: DataFrame, role: str) -> DataFrame:
        return rows.join(F.broadcast(roles.where(F.col("role") == role).select("specimen_id").distinct()), "specimen_id", "leftsemi")

    chosen = paired_specimens(source, target, roles, count, spec.seed)
    base = models.fit_ridge(of(target, "train"), spec.shared, spec.target_only)
    mlp = models.fit_network(of(target, "train"), spec.shared, spec.target_only, "specimen_id", hidden=(32,), epochs=spec.epochs, seed=spec.seed)
    pairs = [x.where(F.col("specimen_id").isin(chosen)) for x in (source, target)]
    taught = transport.teacher(*pairs, ["specimen_id", "cell_type"], ["cell_id"], spec.shared, spec.target_only, spec.most, spec.least, seed=spec.seed, keep=spec.source_only)
    left = [f"left_{t}" for t in spec.target_only]
    both = [*spec.shared, *spec.source_only]
    fitted = kept(base.predict(taught).select(*KEYS, *both, *((F.col(f"pseudo_{t}") - F.col(f"predicted_{t}")).alias(f"left_{t}") for t in spec.target_only)), "taught")
    shuffled = sampling.shuffled_within(fitted, ["specimen_id"], spec.source_only, ["cell_id"], f"{spec.seed}-x")
    taken = {"h_residual": (fitted, spec.shared), "h_shuffled_x": (shuffled, both), "h_plus_x": (fitted, both)}
    nets = {name: models.fit_network(rows, features, left, "specimen_id", hidden=(32,), epochs=spec.epochs, seed=spec.seed) for name, (rows, features) in taken.items()}
    point = Point(spec, base, mlp, nets, dict.fromkeys(spec.target_only, 1.0), chosen)
    return Point(spec, base, mlp, nets, _gates(point, of(source, "validation"), of(target, "validation"), _iqr(of(target, "train"), spec.target_only)), chosen)


def _gates(point: Point, source: DataFrame, target: DataFrame, scales: DataFrame) -> dict[str, float]:
    """For each marker the share of the residual with the least validation error, patients counting alike."""
    wide, keys = represented(source, point, ["h_plus_x"]), ["patient_id", "specimen_id", "cell_type"]
    apart = lambda t: F.col(f"translated_y_h_plus_x_ungated__{t}") - F.col(f"translated_y_h_only__{t}")
    points = metrics.sides(wide, target, keys, {t: (F.col(f"translated_y_h_only__{t}"), apart(t)) for t in point.spec.target_only})
    curve = metrics.residual_curve(points, [*keys, "marker"], scales, list(point.spec.alphas)).where("error is not null")
    per = curve.groupBy("patient_id", "marker", "alpha").agg(F.avg("error").alias("error")).groupBy("marker", "alpha").agg(F.avg("error").alias("error"))
    found = {r["marker"]: float(r["alpha"]) for r in ranks.least_on_grid(per, ["marker"], "alpha", "error").collect()}  # a row a marker
    return {t: found.get(t, 0.0) for t in point.spec.target_only}


def features_of(spec: CrossPanel) -> dict[str, list[str]]:
    """Columns of each representation, as represented() names them."""
    own = lambda name: [f"{name}__{t}" for t in spec.target_only]
    out = {"source_h": list(spec.shared), "source_h_plus_x": [*spec.shared, *spec.source_only]}
    for name in ("h_only", "target_h_mlp", "h_residual_ungated", "h_shuffled_x_ungated", "h_plus_x_ungated", "h_plus_x_gate"):
        out[f"translated_y_{name}"] = own(f"translated_y_{name}")
    out["target_like_h_y_h_only"] = [*spec.shared, *own("translated_y_h_only")]
    out["target_like_h_y_h_plus_x_gate"] = [*spec.shared, *own("translated_y_h_plus_x_gate")]
    return out


def represented(rows: DataFrame, point: Point, only: list[str] | None = None) -> DataFrame:
    """rows with a column <representation>__<marker> for each translated representation.

    only: the residual models asked for; the target's own network is then left out as well.
    """
    spec, kept = point.spec, rows.columns
    both, targets = [*spec.shared, *spec.source_only], spec.target_only
    out = point.base.predict(rows).withColumnsRenamed({f"predicted_{t}": f"translated_y_h_only__{t}" for t in targets})
    if only is None:
        out = models.predict_network(out, point.target_only, spec.shared, targets).withColumnsRenamed({f"predicted_{t}": f"translated_y_target_h_mlp__{t}" for t in targets})
    for name, net in point.residuals.items():
        if only is not None and name not in only:
            continue
        values = spec.shared if name == "h_residual" else both
        if name == "h_shuffled_x":
            mixed = sampling.shuffled_within(out.select(*KEYS, *both), ["specimen_id"], spec.source_only, ["cell_id"], f"{spec.seed}-x")
            moved = models.predict_network(mixed, net, values, [f"left_{t}" for t in targets]).select(*KEYS, *(f"predicted_left_{t}" for t in targets))
            out = out.join(moved, KEYS)
        else:
            out = models.predict_network(out, net, values, [f"left_{t}" for t in targets])
        out = out.withColumns({f"translated_y_{name}_ungated__{t}": F.col(f"translated_y_h_only__{t}") + F.col(f"predicted_left_{t}") for t in targets})
        if name == "h_plus_x":
            out = out.withColumns({f"translated_y_h_plus_x_gate__{t}": F.col(f"translated_y_h_only__{t}") + F.lit(point.gates[t]) * F.col(f"predicted_left_{t}") for t in targets})
        out = out.drop(*(f"predicted_left_{t}" for t in targets))
    return out.select(*kept, *(c for c in out.columns if "__" in c and c.startswith("translated_y")))


def probe_fold(source: DataFrame, target: DataFrame, roles: DataFrame, spec: CrossPanel, classes: list[str], count: int | str = "all", label: str = "cell_type") -> tuple[DataFrame, DataFrame]:
    """(per class, overall) of a classifier for each representation, fitted on the fold's train cells, per test patient."""
    wide = represented(source, fit_point(source, target, roles, spec, count)).join(F.broadcast(roles.select("specimen_id", "role").distinct()), "specimen_id")
    fit, test = (wide.where(F.col("role") == r).drop("role") for r in ("train", "test"))
    return probe.probe(fit, kept(test, "represented"), features_of(spec), label, classes, seed=spec.seed)
