"""Tables over finished runs: paired panel effects, retention, unions of methods, means over runs, dose-response curves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import BASE_METHODS
from ..functions.scales import finite
from .bootstrap import REPLICATES, intervals
from .ranks import steps_down

CLOSE = 1e-12


def patient_means(rows: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """groups (with patient) and the means of finite values: seeds and specimens are no replicates."""
    return rows.groupBy(*groups).agg(*(F.avg(finite(F.col(m))).alias(m) for m in metrics))


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).count().where("count > 1")


def paired_effects(rows: DataFrame, ids: list[str], metrics: list[str], base: str, upper: str, replicates: int | None = REPLICATES, seed: int = 4207) -> DataFrame:
    """Per modality, panel, panel_kind, added_marker, ids and metric: how a panel moves from the base towards the upper panel.

    rows: modality, panel, panel_kind, added_marker, patient, ids, metrics, one row a patient and panel. Patients that
    lack a panel, or a finite value in one, are left out. The rescued share of the gap is null where the gap is none.
    """
    keys = ["modality", *ids, "patient"]
    long = rows.select("modality", "panel", "panel_kind", "added_marker", "patient", *ids, *(finite(F.col(m)).alias(m) for m in metrics)).unpivot(["modality", "panel", "panel_kind", "added_marker", "patient", *ids], metrics, "metric", "value")
    side = lambda panel, name: long.where(F.col("panel") == panel).select(*keys, "metric", F.col("value").alias(name))
    joined = long.where(F.col("panel") != base).join(side(base, "base_value"), [*keys, "metric"]).join(side(upper, "upper_value"), [*keys, "metric"])
    groups = ["modality", "panel", "panel_kind", "added_marker", *ids, "metric"]
    whole = joined.where("value is not null and base_value is not null and upper_value is not null").withColumn("delta", F.col("value") - F.col("base_value"))
    sized = joined.groupBy(*groups).agg(F.countDistinct("patient").alias("n_patients"))
    means = whole.groupBy(*groups).agg(F.avg("base_value").alias("base_mean"), F.avg("value").alias("panel_mean"), F.avg("upper_value").alias("upper_mean"), F.avg("delta").alias("delta_mean"))
    gap = F.col("upper_mean") - F.col("base_mean")
    out = _null_safe(sized, means, groups).withColumn("gap_rescue_fraction", F.when(F.abs(gap) > CLOSE, F.try_divide(F.col("delta_mean"), gap)))
    if replicates is None:
        return out
    cis = intervals(whole.withColumnRenamed("metric", "measure"), [g if g != "metric" else "measure" for g in groups], ["delta"], replicates, seed).drop("metric").withColumnsRenamed({"measure": "metric", "ci_lower": "delta_ci_lower", "ci_upper": "delta_ci_upper"})
    return _null_safe(out, cis, groups)


def _null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join in which null keys meet."""
    other = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(other, same, "left").drop(*(f"__{k}" for k in keys))


def retention(rows: DataFrame, methods: list[str], metrics: list[str], groups: list[str] | None = None) -> DataFrame:
    """groups, probe, method, metric, n_patients, true_mean, null_mean, method_mean, retention.

    rows: groups, patient, representation, metrics. A probe "full" compares full_true, full_hybrid_median and
    full_hybrid_<method>, "hidden" the same with hidden_; only patients with all three finite count.
    """
    groups = groups or ["modality", "panel"]
    long = rows.select(*groups, "patient", "representation", *(finite(F.col(m)).alias(m) for m in metrics)).unpivot([*groups, "patient", "representation"], metrics, "metric", "value").where("value is not null")
    names = [(p, m, f"{p}_true", f"{stem}median", f"{stem}{m}") for p, stem in (("full", "full_hybrid_"), ("hidden", "hidden_")) for m in methods]
    roles = [(p, m, role, name) for p, m, *three in names for role, name in zip(("true", "null", "method"), three, strict=True)]
    wanted = rows.sparkSession.createDataFrame(roles, "probe string, method string, role string, representation string")
    keys = [*groups, "probe", "method", "metric"]
    value = {r: F.max(F.when(F.col("role") == r, F.col("value"))) for r in ("true", "null", "method")}
    triples = long.join(F.broadcast(wanted), "representation").groupBy(*keys, "patient").agg(*(v.alias(f"{r}_value") for r, v in value.items()))
    whole = triples.where("true_value is not null and null_value is not null and method_value is not null")
    means = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_patients"), *(F.avg(f"{r}_value").alias(f"{r}_mean") for r in value))
    gap = F.col("true_mean") - F.col("null_mean")
    return means.withColumn("retention", F.when(F.abs(gap) > CLOSE, F.try_divide(F.col("method_mean") - F.col("null_mean"), gap)))


def completed(runs: DataFrame) -> DataFrame:
    return runs.where(F.col("status") == "ok")


def literature_union(base: DataFrame, literature: DataFrame, run_key: list[str]) -> DataFrame:
    """Rows of both with method and information_access: base runs only where a literature run has the same key.

    base: representation names in BASE_METHODS; literature: rows whose representation is their own method.
    """
    table = base.sparkSession.createDataFrame([(r, m, a) for r, (m, a) in BASE_METHODS.items()], "representation string, method string, information_access string")
    kept = base.join(literature.select(*run_key).distinct(), run_key, "leftsemi").join(F.broadcast(table), "representation")
    own = literature.where(F.col("representation") == F.col("method")).withColumn("information_access", F.lit("transductive_query_H"))
    return kept.unionByName(own)


def run_means(runs: DataFrame, groups: list[str], metrics: list[str]) -> DataFrame:
    """groups, n, mean and sample deviation (0 for one run) of each metric."""
    return runs.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_runs"), *(a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias(f"{m}_std"))))


def wins(runs: DataFrame, run_key: list[str], method: str, against: list[str], score: str) -> DataFrame:
    """against, wins, runs, beats_mean: in how many runs the method's score is lower, and whether its mean is."""
    own = runs.where(F.col("method") == method).select(*run_key, F.col(score).alias("own"))
    other = runs.where(F.col("method").isin(against)).select(*run_key, F.col("method").alias("against"), F.col(score).alias("other"))
    return own.join(other, run_key).groupBy("against").agg(F.count(F.when(F.col("own") < F.col("other"), 1)).alias("wins"), F.count(F.lit(1)).alias("n_runs"), (F.avg("own") < F.avg("other")).alias("beats_mean"))


def curve_trend(curve: DataFrame, groups: list[str], count: str = "count", score: str = "score") -> DataFrame:
    """groups and the trend of a score over counts: linear fits of the improvement over the least count, on counts and on
    log2 of positive counts, the number of steps that do not rise, and of all steps. A flat curve fits with R2 1."""
    mean = curve.groupBy(*groups, count).agg(F.avg(score).alias("__s"))
    first = mean.groupBy(*groups).agg(F.min(F.struct(F.col(count), F.col("__s"))).alias("__f"))
    moved = (mean.join(first, groups) if groups else mean.crossJoin(first)).withColumn("__gain", F.col("__f.__s") - F.col("__s"))
    x, lg = F.col(count).cast("double"), F.log2(F.when(F.col(count) > 0, F.col(count).cast("double")))
    fits = [a for name, z in (("raw", x), ("doubling", lg)) for y in [F.when(z.isNotNull(), F.col("__gain"))] for a in (F.regr_slope(y, z).alias(f"{name}_slope"), F.regr_intercept(y, z).alias(f"{name}_intercept"), F.coalesce(F.regr_r2(y, z), F.lit(1.0)).alias(f"{name}_r_squared"))]
    fitted = moved.groupBy(*groups).agg(*fits) if groups else moved.agg(*fits)
    steps = steps_down(mean, groups, count, "__s")
    return fitted.join(steps, groups) if groups else fitted.crossJoin(steps)


def first_below(curve: DataFrame, baselines: DataFrame, count: str = "count", score: str = "score") -> DataFrame:
    """baseline, first_count: the least count whose mean score is under the baseline's mean; null if none."""
    mean = curve.groupBy(count).agg(F.avg(score).alias("__s"))
    base = baselines.groupBy("baseline").agg(F.avg("value").alias("__b"))
    return base.crossJoin(F.broadcast(mean)).groupBy("baseline").agg(F.min(F.when(F.col("__s") < F.col("__b"), F.col(count))).alias("first_count"))  # a row a baseline and count


def nested(subsets: DataFrame, run_key: list[str], count: str = "count") -> DataFrame:
    """run_key, nested: whether each set of specimens lies in that of the next larger count. subsets: run_key, count, specimen_id."""
    from pyspark.sql import Window as W

    sets = subsets.groupBy(*run_key, count).agg(F.collect_set("specimen_id").alias("s"))
    ahead = sets.withColumn("next", F.lead("s").over(W.partitionBy(*run_key).orderBy(count)))
    return ahead.groupBy(*run_key).agg((F.count(F.when(F.size(F.array_except("s", "next")) > 0, 1)) == 0).alias("nested"))


def flatten_biology(runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(overall, per class) rows of run documents with specimens: map of specimen to patient, n_cells and a map of
    representation to metrics with a per_class map."""
    common = ["modality", "panel", "fold", "seed"]
    s = runs.select(*common, F.explode("specimens").alias("specimen", "x"))
    r = s.select(*common, "specimen", F.col("x.patient").alias("patient"), F.col("x.n_cells").alias("n_cells"), F.explode("x.metrics").alias("representation", "m"))
    keys = [*common, "specimen", "patient", "n_cells", "representation"]
    overall = r.select(*keys, *(F.col(f"m.{c}").alias(c) for c in ("accuracy", "balanced_accuracy", "macro_f1", "macro_auprc")))
    per = r.select(*keys, F.explode("m.per_class").alias("label", "c")).select(*keys, "label", "c.*")
    return overall, per


RUN_SCHEMA = """modality string, panel string, fold int, seed int, status string, specimens map<string, struct<patient: string, n_cells: bigint,
 metrics: map<string, struct<accuracy: double, balanced_accuracy: double, macro_f1: double, macro_auprc: double,
 per_class: map<string, struct<support: bigint, predicted_support: bigint, recall: double, precision: double, auprc: double,
 observed_prevalence: double, predicted_prevalence: double, prevalence_error: double>>>>>>"""
