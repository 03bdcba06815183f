"""Audits as relations: annotation reconciliation, support, visits, banks, inventory, marker roles, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.names import TECHNICAL_CHANNELS, canonical, is_technical

UNKNOWN, CONFLICT = "unknown", "conflict"


def reconcile(annotations: DataFrame, specimens: DataFrame, endpoints: list[str], single_source_is_unknown: bool = True) -> DataFrame:
    """specimen_id, patient_id, endpoint, value, n_sources, provenance: one value for each specimen and endpoint.

    annotations: source, specimen_id, endpoint, value. specimens: specimen_id, patient_id. Blank values do not count.
    Two unlike values conflict; a specimen that a single source describes is unknown until a second one does.
    """
    rows = annotations.withColumn("value", F.trim("value"))
    sources = rows.groupBy("specimen_id").agg(F.countDistinct("source").alias("n_sources"))
    said = rows.where("value <> ''").groupBy("specimen_id", "endpoint").agg(F.sort_array(F.collect_set("value")).alias("values"), F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "source", "value"))), ";").alias("provenance"))
    every = specimens.select("specimen_id", "patient_id").distinct().withColumn("endpoint", F.explode(F.array(*(F.lit(e) for e in endpoints))))
    joined = every.join(said, ["specimen_id", "endpoint"], "left").join(sources, "specimen_id", "left").withColumn("n_sources", F.coalesce("n_sources", F.lit(0)).cast("long"))
    value = F.when(F.size("values") > 1, CONFLICT).when(F.col("values").isNull(), UNKNOWN)
    if single_source_is_unknown:
        value = value.when(F.col("n_sources") == 1, UNKNOWN)
    return joined.select("specimen_id", "patient_id", "endpoint", value.otherwise(F.col("values")[0]).alias("value"), "n_sources", F.coalesce("provenance", F.lit("no_annotation")).alias("provenance"))


def patient_status(reconciled: DataFrame) -> DataFrame:
    """patient_id, endpoint, status: the one known value of a patient's specimens; unlike ones, or any conflict, conflict."""
    known = F.collect_set(F.when(~F.col("value").isin(UNKNOWN, CONFLICT), F.col("value")))
    per = reconciled.groupBy("patient_id", "endpoint").agg(F.sort_array(known).alias("known"), F.max((F.col("value") == CONFLICT).cast("int")).alias("clash"))
    return per.select("patient_id", "endpoint", F.when((F.col("clash") == 1) | (F.size("known") > 1), CONFLICT).when(F.size("known") == 1, F.col("known")[0]).otherwise(UNKNOWN).alias("status"))


def endpoint_records(reconciled: DataFrame, status: DataFrame) -> DataFrame:
    """specimen_id, patient_id, endpoint, value, eligibility, reason."""
    joined = reconciled.join(status, ["patient_id", "endpoint"])
    clash = (F.col("status") == CONFLICT) | (F.col("value") == CONFLICT)
    reason = F.when(clash, "longitudinal_or_annotation_source_conflict").when(F.col("value") == UNKNOWN, F.when(F.col("n_sources") == 1, "single_source_annotation_unverified").otherwise("missing_annotation")).otherwise("")
    return joined.select("specimen_id", "patient_id", "endpoint", "value", F.when(reason == "", "secondary").otherwise("not_evaluable").alias("eligibility"), reason.alias("reason"))


def endpoint_support(status: DataFrame, splits: DataFrame, positive: str, negative: str) -> DataFrame:
    """endpoint, fold, role and the number of patients by status, missing patients of a role counting as unknown."""
    roles = splits.select("fold", "role", "patient_id").distinct().crossJoin(F.broadcast(status.select("endpoint").distinct()))
    joined = roles.join(status, ["patient_id", "endpoint"], "left").withColumn("status", F.coalesce("status", F.lit(UNKNOWN)))
    return joined.groupBy("endpoint", "fold", "role").agg(
        *(F.count(F.when(F.col("status") == v, 1)).alias(n) for v, n in ((positive, "positive_patients"), (negative, "negative_patients"), (UNKNOWN, "unknown_patients"), (CONFLICT, "conflict_patients"))), F.count(F.lit(1)).alias("patients")
    )


def endpoint_eligibility(support: DataFrame, status: DataFrame, positive: str, negative: str, least_total: int, least_test: int) -> DataFrame:
    """endpoint, eligibility: by totals and by the thinnest test fold."""
    test = support.where("role = 'test'").groupBy("endpoint").agg(F.min("positive_patients").alias("p"), F.min("negative_patients").alias("n"))
    total = status.groupBy("endpoint").agg(F.count(F.when(F.col("status") == positive, 1)).alias("tp"), F.count(F.when(F.col("status") == negative, 1)).alias("tn"))
    tier = F.when((F.col("p") == 0) | (F.col("n") == 0), "descriptive_only_not_foldwise_evaluable").when((F.least("tp", "tn") >= least_total) & (F.least("p", "n") >= least_test), "support_qualified_secondary")
    return test.join(total, "endpoint").select("endpoint", tier.otherwise("secondary_only_sparse_support").alias("eligibility"))


def annotation_duplicates(annotations: DataFrame, source: str = "source", specimen: str = "specimen_id") -> DataFrame:
    """source, specimen, kind: specimens that a source names more than once, with the same row or with unlike ones."""
    others = [c for c in annotations.columns if c not in (source, specimen)]
    per = annotations.groupBy(source, specimen).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(F.struct(*others)).alias("k"))
    return per.where("n > 1").select(source, specimen, F.when(F.col("k") == 1, "exact_duplicate").otherwise("unlike_duplicate").alias("kind"))


def visit_order(visits: DataFrame, date: str = "collection_date", visit: str = "visit_id") -> DataFrame:
    """visits with visit_order (from 1) of each patient by date, then visit."""
    return visits.withColumn("visit_order", F.row_number().over(W.partitionBy("patient_id").orderBy(date, visit)))


def metadata_issues(metadata: DataFrame, specimens: DataFrame) -> DataFrame:
    """specimen_id, issue: specimens without metadata, with more than one row, or with an unreadable date."""
    missing = specimens.select("specimen_id").distinct().join(metadata, "specimen_id", "leftanti").select("specimen_id", F.lit("missing").alias("issue"))
    twice = metadata.groupBy("specimen_id").count().where("count > 1").select("specimen_id", F.lit("duplicate").alias("issue"))
    undated = metadata.where(F.col("collection_date").isNull()).select("specimen_id", F.lit("no_date").alias("issue")).distinct()
    return missing.unionByName(twice).unionByName(undated)


def bank_weights(members: DataFrame, banks: list[str]) -> DataFrame:
    """members with patient, specimen and event weights: each level shares its parent's weight alike; a bank sums to 1.

    members: banks' key columns, patient_id, specimen_id, event_count.
    """
    patients = members.select(*banks, "patient_id").distinct().groupBy(*banks).agg(F.count(F.lit(1)).alias("__p"))
    specimens = members.groupBy(*banks, "patient_id").agg(F.count(F.lit(1)).alias("__s"))
    joined = members.join(F.broadcast(patients), banks).join(specimens, [*banks, "patient_id"])
    return joined.withColumn("patient_weight", 1.0 / F.col("__p")).withColumn("specimen_weight", F.col("patient_weight") / F.col("__s")).withColumn("event_weight", F.col("specimen_weight") / F.col("event_count")).drop("__p", "__s")


STAGES = {"inner_fit": ("train",), "outer_refit": ("train", "validation")}


def reference_banks(splits: DataFrame, events: DataFrame, directions: list[tuple[str, str]], seeds: list[int], cap: int) -> DataFrame:
    """Members and weights of every bank: fold, stage, direction, seed, role and modality.

    splits: fold, role, patient_id, specimen_id. events: modality, specimen_id, eligible_events. Test patients are in
    no bank; a predictor and a prior bank hold the target, a calibration bank both sides.
    """
    spark = splits.sparkSession
    stage = spark.createDataFrame([(s, r) for s, roles in STAGES.items() for r in roles], "fit_stage string, role string")
    parts = [(f"{a}_to_{b}", bank, m) for a, b in directions for bank, ms in (("target_predictor_bank", (b,)), ("null_prior_bank", (b,)), ("calibration_bank", (a, b))) for m in ms]
    part = spark.createDataFrame(parts, "direction string, bank_role string, modality string")
    seed = spark.createDataFrame([(s,) for s in seeds], "seed int")
    members = splits.join(F.broadcast(stage), "role").drop("role").crossJoin(F.broadcast(part.crossJoin(seed)))  # small, stated tables
    counted = members.join(events, ["modality", "specimen_id"]).withColumn("event_count", F.least("eligible_events", F.lit(cap))).drop("eligible_events")
    return bank_weights(counted, ["fold", "fit_stage", "direction", "seed", "bank_role", "modality"])


def inventory(events: DataFrame, least: int, low: int) -> DataFrame:
    """specimen_id, pairing, events (of the thinner modality), flag: specimens of one or both modalities.

    events: modality, specimen_id, events; two modalities at most.
    """
    per = events.groupBy("specimen_id").agg(F.sort_array(F.collect_set("modality")).alias("m"), F.min("events").alias("events"))
    flag = F.when(F.col("events") < least, "ineligible").when(F.col("events") < low, "low_event").otherwise("ok")
    return per.select("specimen_id", F.when(F.size("m") > 1, "exact_pair").otherwise(F.concat(F.col("m")[0], F.lit("_only"))).alias("pairing"), "events", flag.alias("flag"))


def modality_rollup(events: DataFrame, pairing: DataFrame) -> DataFrame:
    """modality, specimens, events, paired_specimens, paired_events."""
    paired = F.col("pairing") == "exact_pair"
    joined = events.join(pairing.select("specimen_id", "pairing"), "specimen_id")
    return joined.groupBy("modality").agg(F.count(F.lit(1)).alias("specimens"), F.sum("events").alias("events"), F.count(F.when(paired, 1)).alias("paired_specimens"), F.sum(F.when(paired, F.col("events")).otherwise(0)).alias("paired_events"))


def label_profile(labels: DataFrame, coarse: str, fine: str) -> DataFrame:
    """specimen_id, rows, unmapped_rows, fine_labels."""
    return labels.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col(coarse).isNull(), 1)).alias("unmapped_rows"), F.sort_array(F.collect_set(fine)).alias("fine_labels"))


def marker_roles(markers: DataFrame, source: str, target: str, technical: tuple[str, ...] = TECHNICAL_CHANNELS) -> DataFrame:
    """direction, modality, original_channel, canonical_marker, role and ordinal within the role, in both directions.

    markers: modality, original_channel, ordinal. Shared markers are H; a source's others are source_only, a target's Y;
    technical channels are technical. The source's order holds for H.
    """
    rows = markers.withColumn("canonical_marker", canonical(F.col("original_channel"))).withColumn("technical", is_technical(F.col("original_channel"), technical))
    shared = rows.where("not technical").groupBy("canonical_marker").agg(F.countDistinct("modality").alias("n")).where("n > 1").select("canonical_marker", F.lit(True).alias("shared"))
    named = rows.join(shared, "canonical_marker", "left")
    out = None
    for a, b in ((source, target), (target, source)):
        role = F.when(F.col("technical"), "technical").when(F.col("shared"), "H").when(F.col("modality") == a, "source_only").otherwise("Y")
        order = named.where(F.col("modality") == a).select("canonical_marker", F.col("ordinal").alias("lead"))
        one = named.where(F.col("modality").isin(a, b)).join(order, "canonical_marker", "left").withColumn("role", role)
        place = F.row_number().over(W.partitionBy("modality", "role").orderBy(F.when(F.col("role") == "H", F.col("lead")).otherwise(F.col("ordinal")))) - 1
        one = one.select(F.lit(f"{a}_to_{b}").alias("direction"), "modality", "original_channel", "canonical_marker", "role", place.alias("ordinal"))
        out = one if out is None else out.unionByName(one)
    return out


def duplicate_markers(markers: DataFrame) -> DataFrame:
    """modality, canonical_marker: more than one column of a panel for a marker."""
    return markers.groupBy("modality", canonical(F.col("original_channel")).alias("canonical_marker")).count().where("count > 1").select("modality", "canonical_marker")


def bundle_digest(files: DataFrame, digest: str = "sha256", path: str = "path") -> DataFrame:
    """digest, files: SHA-256 of the sorted lines "digest  path"; pending while any digest is."""
    lines = F.concat(F.array_join(F.sort_array(F.collect_list(F.concat(F.col(digest), F.lit("  "), F.col(path)))), "\n"), F.lit("\n"))
    return files.agg(F.when(F.max((F.col(digest) == "pending").cast("int")) == 1, "pending").otherwise(F.sha2(lines, 256)).alias("digest"), F.count(F.lit(1)).alias("files"))


def header_digest(names: DataFrame, groups: list[str], name: str, order: str) -> DataFrame:
    """groups, digest: SHA-256 of the column names in order, as compact JSON."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct(order, name))), lambda x: x[name])
    return names.groupBy(*groups).agg(F.sha2(F.to_json(ordered), 256).alias("digest"))
