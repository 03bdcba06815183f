"""Same-cell marker metrics, confusion-based label metrics (two variants), and uncertainty of a residual gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distance import wasserstein
from .ranks import auc, average_precision, of_ranks, quintiles, ranked, spearman


def marker_metrics(rows: DataFrame, groups: list[str], scales: DataFrame, truth: str = "truth", prediction: str = "prediction", null: str = "null_prediction") -> DataFrame:
    """Per groups (which include marker): errors, skill against the null prediction, rank correlation, dynamic range.

    scales: marker (and any other of groups), scale. Skill is null where the null prediction is perfect, retention where the truth has no range.
    """
    quarter = F.array(*(F.lit(p) for p in (0.25, 0.5, 0.75, 0.9)))
    # one shuffle by groups serves ranks and sums, so that predictions are made once
    per = ranked(rows.select(*dict.fromkeys([*groups, truth, prediction, null])), groups, truth, prediction).groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.avg(F.abs(F.col(prediction) - F.col(truth))).alias("mae"),
        F.avg(F.abs(F.col(null) - F.col(truth))).alias("null_mae"),
        F.percentile(truth, quarter).alias("__t"),
        F.percentile(prediction, quarter).alias("__p"),
        of_ranks(truth, prediction).alias("spearman"),
    )
    joined = per.join(F.broadcast(scales), [c for c in scales.columns if c != "scale"])
    t, p = F.col("__t"), F.col("__p")
    observed, predicted = t[2] - t[0], p[2] - p[0]
    return joined.select(
        *groups,
        "n_cells",
        "mae",
        (F.col("mae") / F.col("scale")).alias("normalized_mae"),
        "null_mae",
        F.when(F.col("null_mae") > 0, 1 - F.try_divide("mae", "null_mae")).alias("skill"),
        "spearman",
        observed.alias("observed_iqr"),
        predicted.alias("predicted_iqr"),
        F.when(observed > 0, F.try_divide(predicted, observed)).alias("range_retention"),
        (F.abs(p[1] - t[1]) / F.col("scale")).alias("normalized_median_error"),
        (F.abs(p[3] - t[3]) / F.col("scale")).alias("normalized_q90_error"),
    )


def confusion(rows: DataFrame, groups: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """groups, label, predicted, n: the confusion matrix in long form."""
    return rows.groupBy(*groups, label, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_counts(matrix: DataFrame, groups: list[str], classes: list[str], label: str = "label", predicted: str = "predicted") -> DataFrame:
    """groups, class, support, predicted_support, hits, total for every class, met or not."""
    sides = F.explode(F.array(F.struct(F.col(label).alias("c"), F.col("n").alias("s"), F.lit(0).cast("long").alias("p")), F.struct(F.col(predicted).alias("c"), F.lit(0).cast("long").alias("s"), F.col("n").alias("p"))))
    hit = F.when((F.col(label) == F.col(predicted)), F.col("n")).otherwise(0)
    rows = matrix.select(*groups, sides.alias("x"), hit.alias("h")).groupBy(*groups, F.col("x.c").alias("class")).agg(F.sum("x.s").alias("support"), F.sum("x.p").alias("predicted_support"), (F.sum("h") / 2).cast("long").alias("hits"))
    totals = matrix.groupBy(*groups).agg(F.sum("n").alias("total"))
    named = totals.withColumn("class", F.explode(F.array(*(F.lit(c) for c in classes))))
    return named.join(rows, [*groups, "class"], "left").select(*groups, "class", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("support", "predicted_support", "hits")), "total")


def _share(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(0.0)


def label_metrics(rows: DataFrame, groups: list[str], classes: list[str], scores: DataFrame | None = None, variant: str = "biology", subsets: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(per class, overall) of rows with label and predicted.

    variant "biology": F1 is averaged over classes that occur, precision is null where nothing was predicted as the
    class. variant "probe": F1 is averaged over all classes, precision is null where the class does not occur. scores:
    groups, class, label, score (one row a cell and class), for average precision. subsets: names of further means of
    average precision over some classes (the probe's).
    """
    return matrix_metrics(confusion(rows, groups), groups, classes, scores, variant, subsets)


def matrix_metrics(matrix: DataFrame, groups: list[str], classes: list[str], scores: DataFrame | None = None, variant: str = "biology", subsets: dict[str, list[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """label_metrics from a confusion matrix in long form."""
    per = class_counts(matrix, groups, classes)
    recall, precision = _share(F.col("hits"), F.col("support")), _share(F.col("hits"), F.col("predicted_support"))
    f1 = _share(2.0 * precision * recall, precision + recall)
    if scores is not None:
        ap = average_precision(scores.withColumn("outcome", (F.col("label") == F.col("class")).cast("int")), [*groups, "class"], "score", "outcome")
        per = per.join(ap, [*groups, "class"], "left")
    else:
        per = per.withColumn("auprc", F.lit(None).cast("double"))
    known = F.col("predicted_support") > 0 if variant == "biology" else F.col("support") > 0
    observed, predicted = F.col("support") / F.col("total"), F.col("predicted_support") / F.col("total")
    per = per.select(
        *groups,
        "class",
        "support",
        "predicted_support",
        "hits",
        "total",
        F.when(F.col("support") > 0, recall).alias("recall"),
        F.when(known, precision).alias("precision"),
        f1.alias("f1"),
        F.when(F.col("support") > 0, F.col("auprc")).alias("auprc"),
        observed.alias("observed_prevalence"),
        predicted.alias("predicted_prevalence"),
        (predicted - observed).alias("prevalence_error"),
    )
    averaged = F.when(F.col("support") > 0, F.col("f1")) if variant == "biology" else F.col("f1")
    extra = [F.avg(F.when(F.col("class").isin(names), F.col("auprc"))).alias(f"{name}_macro_auprc") for name, names in (subsets or {}).items()]
    overall = per.groupBy(*groups).agg((F.sum("hits") / F.max("total")).alias("accuracy"), F.avg("recall").alias("balanced_accuracy"), F.avg(averaged).alias("macro_f1"), F.avg("auprc").alias("macro_auprc"), *extra)
    return per, overall


RESOLUTIONS = ("fine", "coarse")


def _coarse(column: Column, hierarchy: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in hierarchy.items() for x in pair)), column)


def rolled_up(matrix: DataFrame, groups: list[str], hierarchy: dict[str, str]) -> DataFrame:
    """resolution, groups, label, predicted, n: a confusion matrix of fine labels, and the coarse one it adds up to.

    hierarchy: the coarse label of each fine one; labels without one stay in the fine part alone. Cells are counted once:
    the coarse part is a grouping set over the fine counts.
    """
    sides = {c: _coarse(F.col(c), hierarchy).alias(f"__{c}") for c in ("label", "predicted")}
    both = matrix.select(*groups, "label", "predicted", "n", *sides.values())
    fine, coarse = [*groups, "label", "predicted"], [*groups, "__label", "__predicted"]
    rows = both.groupingSets([fine, coarse], *groups, "label", "predicted", "__label", "__predicted").agg(F.sum("n").alias("n"), F.grouping("label").alias("__up"))
    up = F.col("__up") == 1
    named = rows.select(F.when(up, RESOLUTIONS[1]).otherwise(RESOLUTIONS[0]).alias("resolution"), *groups, *(F.when(up, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) for c in ("label", "predicted")), "n")
    return named.where("resolution = 'fine' or (label is not null and predicted is not null)")


def rolled_up_scores(scores: DataFrame, cell: list[str], hierarchy: dict[str, str]) -> DataFrame:
    """cell, class, label, score of coarse classes: a cell's probability of a coarse class is that of its fine ones together.

    scores: cell (the columns that tell cells apart), class, label, score of fine classes.
    """
    placed = scores.select(*cell, _coarse(F.col("class"), hierarchy).alias("class"), _coarse(F.col("label"), hierarchy).alias("label"), "score")
    return placed.where("class is not null and label is not null").groupBy(*cell, "class", "label").agg(F.sum("score").alias("score"))


def resolution_metrics(rows: DataFrame, groups: list[str], hierarchy: dict[str, str], scores: DataFrame | None = None, cell: list[str] | None = None, variant: str = "probe") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per class, overall, confusion) at both resolutions of rows with fine label and predicted, from one count of them.

    scores: groups, cell, class, label, score of fine classes.
    """
    matrix = rolled_up(confusion(rows, groups), groups, hierarchy)
    per = overall = None
    for resolution, classes in zip(RESOLUTIONS, (list(hierarchy), sorted(set(hierarchy.values()))), strict=True):
        own = None
        if scores is not None:
            own = scores if resolution == "fine" else rolled_up_scores(scores, [*groups, *(cell or [])], hierarchy)
            own = own.select(*groups, "class", "label", "score")
        found = matrix_metrics(matrix.where(F.col("resolution") == resolution).drop("resolution"), groups, classes, own, variant)
        one, all_ = (f.select(F.lit(resolution).alias("resolution"), "*") for f in found)
        per, overall = (one, all_) if per is None else (per.unionByName(one), overall.unionByName(all_))
    return per, overall, matrix


def rare_support(rows: DataFrame, labels: list[str], label: str = "cell_type") -> DataFrame:
    """label, cells, specimens, patients of each given label, met or not."""
    found = rows.where(F.col(label).isin(labels)).groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("cells"), F.countDistinct("specimen_id").alias("specimens"), F.countDistinct("patient_id").alias("patients"))
    names = rows.sparkSession.createDataFrame([(x,) for x in labels], "label string")
    return names.join(found, "label", "left").na.fill(0, ["cells", "specimens", "patients"])


def sides(source: DataFrame, target: DataFrame, keys: list[str], predicted: dict[str, tuple[Column, Column]], by: str = "specimen_id") -> DataFrame:
    """keys, marker, side (0 source, 1 target), baseline and residual (of sources), value (of targets), dealt by `by`.

    predicted: by marker, baseline and residual of source cells; targets have a column of the marker's name. Whole cells
    are dealt, before they become a row a marker.
    """
    none, names = F.lit(None).cast("double"), list(predicted)
    wide = lambda rows, side, of: rows.select(*keys, F.lit(side).alias("side"), *(x.cast("double").alias(f"__{k}_{j}") for j, m in enumerate(names) for k, x in zip("brv", of(m), strict=True)))
    both = wide(source, 0, lambda m: (*predicted[m], none)).unionByName(wide(target, 1, lambda m: (none, none, F.col(m)))).repartition(by)
    each = F.stack(F.lit(len(names)), *(x for j, m in enumerate(names) for x in (F.lit(m), *(F.col(f"__{k}_{j}") for k in "brv"))))
    return both.select(*keys, "side", each.alias("marker", "baseline", "residual", "value"))


def residual_curve(rows: DataFrame, groups: list[str], scales: DataFrame, alphas: list[float]) -> DataFrame:
    """groups (with marker), alpha, error: normalised W1 of baseline + alpha * residual against the target.

    rows: groups, side (0 source, 1 target), baseline and residual (of sources), value (of targets). Deal cells by some
    of groups first (sides() does): then no row is moved once for each alpha.
    """
    grid = F.explode(F.array(*(F.lit(float(a)) for a in alphas)))
    points = rows.withColumn("alpha", grid).withColumn("value", F.when(F.col("side") == 0, F.col("baseline") + F.col("alpha") * F.col("residual")).otherwise(F.col("value")))
    return wasserstein(points, [*groups, "alpha"]).join(F.broadcast(scales), "marker").select(*groups, "alpha", (F.col("distance") / F.col("scale")).alias("error"))


def uncertainty_units(curve: DataFrame, groups: list[str], selected: float) -> DataFrame:
    """groups, baseline_error, oracle_gain, selected_gain, oracle_alpha, oracle_active: from an error curve with alpha 0.

    The oracle takes the least error, ties to the alpha that stands first on the grid; the selected alpha is the
    nearest on the grid.
    """
    near, best = F.min(F.struct("gap", "alpha", "error")).alias("s"), F.min(F.struct("error", "alpha")).alias("o")
    units = curve.withColumn("gap", F.abs(F.col("alpha") - F.lit(selected))).groupBy(*groups).agg(near, best, F.max(F.when(F.col("alpha") == 0, F.col("error"))).alias("baseline_error"))
    return units.select(
        *groups,
        "baseline_error",
        (F.col("baseline_error") - F.col("o.error")).alias("oracle_gain"),
        (F.col("baseline_error") - F.col("s.error")).alias("selected_gain"),
        F.col("o.alpha").alias("oracle_alpha"),
        (F.col("o.alpha") > 0).cast("int").alias("oracle_active"),
    )


def uncertainty_summary(units: DataFrame, signals: list[str], key: list[str]) -> dict[str, DataFrame]:
    """Tables overall, markers, correlations (of each signal) and quintiles (of each signal)."""
    outcomes = ["baseline_error", "oracle_gain", "selected_gain"]
    one = units.withColumn("unit", F.lit(1))
    correlations, parts = [], []
    for s in signals:
        joined = auc(one, ["unit"], s, "oracle_active", "oracle_active_auc")
        for o in outcomes:
            joined = joined.join(spearman(one, ["unit"], s, o, o), "unit")
        correlations.append(joined.select(F.lit(s).alias("signal"), *outcomes, "oracle_active_auc"))
        parts.append(quintiles(one, ["unit"], s, [*outcomes, "oracle_active"], key).drop("unit").withColumn("signal", F.lit(s)))
    stack = lambda frames: frames[0] if len(frames) == 1 else stack([frames[0].unionByName(frames[1]), *frames[2:]])
    means = [F.count(F.lit(1)).alias("n"), *(F.avg(o).alias(o) for o in outcomes), F.avg("oracle_active").alias("oracle_active_fraction"), F.avg("oracle_alpha").alias("mean_oracle_alpha")]
    return {"overall": units.agg(*means), "markers": units.groupBy("marker").agg(*means), "correlations": stack(correlations), "quintiles": stack(parts)}
