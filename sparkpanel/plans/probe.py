"""Cell-type probes: one classifier for each representation of a cell, scored on held-out patients, merged over folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import PROBE_REPRESENTATIONS, RARE_T_LABELS, T_LABELS
from ..operators import bootstrap, metrics, models, percentiles, sampling
from ..sources.shared import kept


def probe(fit: DataFrame, test: DataFrame, representations: dict[str, list[str]], label: str, classes: list[str], per_specimen: int = 200, per_label: int = 5_000, seed: int = 4207) -> tuple[DataFrame, DataFrame]:
    """(per class, overall) per representation and patient. representations: by name, the feature columns.

    Training cells (at most per_label of a label) are drawn once and kept: every classifier reads them many times.
    """
    features = list(dict.fromkeys(f for columns in representations.values() for f in columns))
    drawn = fit.select(*dict.fromkeys(["specimen_id", "cell_id", label, *features]))
    train = kept(sampling.probe_rows(drawn, "specimen_id", label, per_specimen, per_label, ["specimen_id", "cell_id"], seed), "probe")
    rows = scores = None
    for name, features in representations.items():
        model = models.fit_classifier(train, features, label, classes)
        out = model.predict(test).select(F.lit(name).alias("representation"), "patient_id", F.col(label).alias("label"), "predicted", "probabilities")
        pairs = F.explode(F.arrays_zip(F.array(*(F.lit(c) for c in classes)).alias("class"), F.col("probabilities").alias("score")))
        one = out.select("representation", "patient_id", "label", pairs.alias("x")).select("representation", "patient_id", "label", F.col("x.class").alias("class"), F.col("x.score").alias("score"))
        rows = out.drop("probabilities") if rows is None else rows.unionByName(out.drop("probabilities"))
        scores = one if scores is None else scores.unionByName(one)
    subsets = {"t_subtype": [c for c in T_LABELS if c in classes], "rare_t": [c for c in RARE_T_LABELS if c in classes]}
    return metrics.label_metrics(rows, ["representation", "patient_id"], classes, scores, variant="probe", subsets={k: v for k, v in subsets.items() if v})


def held_out(source: DataFrame, folds: DataFrame, shared: list[str], own: list[str], label: str, classes: list[str], n_knots: int = percentiles.KNOTS, seed: int = 4207) -> tuple[DataFrame, DataFrame]:
    """(per class, overall) of source cells by representation and patient, over all folds: a patient's cells are scored by
    the classifiers of the fold that tests it, which have seen cells of the fold's train patients alone.

    Shared markers are percentiles of the fold's train cells (source_h); source_h_plus_x has the source's own besides.
    source: patient_id, specimen_id, cell_id, label and markers; folds: fold, specimen_id, role.
    """
    roles = kept(folds.select("fold", "specimen_id", "role").distinct(), "folds")  # a row a fold and specimen
    train = source.join(F.broadcast(roles.where("role = 'train'")), "specimen_id")
    knots = percentiles.knots(train.select("fold", *shared).unpivot(["fold"], shared, "marker", "value"), ["fold", "marker"], n=n_knots)
    knots = kept(knots, "knots")  # a row a fold and marker
    shown = {"source_h": list(shared), "source_h_plus_x": [*shared, *own]}
    tables: list[tuple[DataFrame, DataFrame]] = []
    for fold in sorted(r[0] for r in roles.select("fold").distinct().collect()):
        lines = knots.where(F.col("fold") == fold).drop("fold")
        of = lambda role: percentiles.transform_columns(source.join(F.broadcast(roles.where((F.col("fold") == fold) & (F.col("role") == role)).select("specimen_id")), "specimen_id", "leftsemi"), lines, shared)  # noqa: B023, E731
        tables.append(probe(of("train"), of("test"), shown, label, classes, seed=seed))
    per, overall = tables[0]
    for a, b in tables[1:]:
        per, overall = per.unionByName(a), overall.unionByName(b)
    return per, overall


def probe_resolutions(fit: DataFrame, test: DataFrame, representations: dict[str, list[str]], label: str, hierarchy: dict[str, str], per_specimen: int = 200, per_label: int = 5_000, seed: int = 4207) -> dict[str, DataFrame]:
    """per_class, overall and confusion per representation, patient and resolution.

    Three classifications are scored: fine, by a classifier of fine labels; coarse, by one of coarse labels; and
    coarse_from_fine, the fine one rolled up. label: the column of fine labels; hierarchy: fine to coarse.
    """
    coarse = metrics._coarse(F.col(label), hierarchy)
    known = [rows.where(coarse.isNotNull()).withColumn("__coarse", coarse) for rows in (fit, test)]
    groups = ["representation", "patient_id"]
    tables: dict[str, list[DataFrame]] = {"per_class": [], "overall": [], "confusion": []}

    def add(found: tuple, names: dict[str, str]) -> None:
        for kind, frame in zip(tables, found, strict=True):
            tables[kind].append(frame.where(F.col("resolution").isin(list(names))).replace(names, subset=["resolution"]))

    for column, scheme, names in ((label, hierarchy, {"fine": "fine", "coarse": "coarse_from_fine"}), ("__coarse", {c: c for c in sorted(set(hierarchy.values()))}, {"fine": "coarse"})):
        train = sampling.probe_rows(known[0], "specimen_id", column, per_specimen, per_label, ["specimen_id", "cell_id"], seed)
        classes, rows, scores = list(scheme), None, None
        for name, features in representations.items():
            out = models.fit_classifier(train, features, column, classes).predict(known[1]).select(F.lit(name).alias("representation"), "patient_id", "specimen_id", "cell_id", F.col(column).alias("label"), "predicted", "probabilities")
            pairs = F.explode(F.arrays_zip(F.array(*(F.lit(c) for c in classes)).alias("class"), F.col("probabilities").alias("score")))
            one = out.select(*groups, "specimen_id", "cell_id", "label", pairs.alias("x")).select(*groups, "specimen_id", "cell_id", "label", F.col("x.class").alias("class"), F.col("x.score").alias("score"))
            rows = out.drop("probabilities") if rows is None else rows.unionByName(out.drop("probabilities"))
            scores = one if scores is None else scores.unionByName(one)
        add(metrics.resolution_metrics(rows, groups, scheme, scores, ["specimen_id", "cell_id"]), names)
    return {kind: frames[0].unionByName(frames[1]) for kind, frames in tables.items()}


def in_order(tables: list[DataFrame]) -> DataFrame:
    """Results of shared and paired representations in the fixed order of representations."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    place = F.array_position(F.array(*(F.lit(r) for r in PROBE_REPRESENTATIONS)), F.col("representation"))
    return out.withColumn("ordinal", F.when(place > 0, place)).orderBy("ordinal", "representation")


def summarize(overall: DataFrame, reference: str, metric: str, folds: int, replicates: int = bootstrap.REPLICATES, seed: int = 4207) -> DataFrame:
    """representation, n_patients, mean, and the mean paired difference to a reference with its interval.

    overall: fold, representation, patient_id, metric. Raises unless there are exactly so many folds and no patient is
    tested in two.
    """
    if overall.select("fold").distinct().count() != folds:
        raise ValueError(f"{folds} folds are needed")
    if not overall.groupBy("patient_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty():
        raise ValueError("a patient is tested in two folds")
    base = overall.where(F.col("representation") == reference).select("patient_id", F.col(metric).alias("__base"))
    paired = overall.join(base, "patient_id").withColumn("delta", F.col(metric) - F.col("__base"))
    return bootstrap.summarize(paired, ["representation"], [metric, "delta"], patient="patient_id", replicates=replicates, seed=seed)


def summed_confusion(matrix: DataFrame) -> DataFrame:
    """representation, label, predicted, n over folds."""
    return matrix.groupBy("representation", "label", "predicted").agg(F.sum("n").alias("n"))
