"""Manifest tables: required columns, and one violation query for each cross-table rule. All fields are strings."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .audit import STAGES
from .contract import ContractError

# Fixed values.
COLUMNS = {
    "data": (
        "dataset", "pair", "modality", "specimen_id", "patient_id", "visit_id", "collection_id", "collection_date", "visit_order", "source_path",
        "source_sha256", "cells_path", "cells_sha256", "labels_path", "labels_sha256", "metadata_source_id", "metadata_sha256", "header_sha256",
        "total_events", "eligible_events", "event_selection_rule_id", "preprocessing_id", "upstream_label_selection", "runtime_label_selection",
        "claim_scope", "pair_status", "excluded", "exclusion_reason", "qc_flag",
    ),
    "markers": (
        "dataset", "direction", "modality", "canonical_marker", "original_channel", "role", "analysis_role", "channel_type", "marker_order", "panel_order",
        "analysis_order", "transformation", "transformation_confidence", "alias_rule", "alias_evidence",
    ),
    "splits": (
        "dataset", "pair", "evaluation_fold", "role", "patient_id", "specimen_id",
    ),
    "endpoints": (
        "dataset", "endpoint", "patient_id", "visit_id", "value", "provenance", "eligibility", "reason",
    ),
    "banks": (
        "reference_bank_id", "dataset", "pair", "direction", "modality", "evaluation_fold", "fit_stage", "included_split_roles", "seed", "bank_role",
        "patient_id", "specimen_id", "row_index_file", "row_index_sha256", "row_index_seed", "event_count", "patient_weight", "specimen_weight",
        "event_weight", "sampling_algorithm", "row_index_dtype", "status",
    ),
    "stress": (
        "condition_id", "dataset", "factor", "level", "seed", "content_file", "content_sha256",
    ),
}
REFERENCED = {"banks": ("row_index_file", "row_index_sha256"), "stress": ("content_file", "content_sha256")}
BANK_ROLES = ("target_predictor_bank", "calibration_bank", "null_prior_bank")
DIGEST = "^[0-9a-f]{64}$"


def load(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A manifest's records, all strings, blank where empty; raises on a wrong set of columns or no rows."""
    rows = spark.read.option("header", True).csv(path)
    if set(rows.columns) != set(COLUMNS[kind]):
        raise ContractError(f"{kind}: columns differ by {sorted(set(rows.columns) ^ set(COLUMNS[kind]))}")
    if rows.isEmpty():
        raise ContractError(f"{kind}: no records")
    return rows.na.fill("")


def load_index(spark: SparkSession, path: str, kind: str, protocol: str, digest: str) -> dict:
    """The records of an index file, once everything about it holds: its own digest, its header (type, protocol, frozen,
    version), the digest of its records, and those of the files that banks and stress records name. All that fails is
    told at once."""
    from pathlib import Path

    import yaml

    if kind not in COLUMNS:
        raise ContractError(f"no manifest of type {kind}")
    index = Path(path)
    content = index.read_bytes() if index.is_file() else b""
    try:
        about = yaml.safe_load(content.decode("utf-8")) if content else None
    except (UnicodeDecodeError, yaml.YAMLError):
        about = None
    about = about if isinstance(about, dict) else {}
    header, listed = (about.get(k) if isinstance(about.get(k), dict) else {} for k in ("manifest", "records"))
    version, name = header.get("version"), listed.get("path")
    table = (index.parent / name).resolve() if isinstance(name, str) and name.strip() else None
    held = table.read_bytes() if table and table.is_file() else b""
    rules = {
        "index missing or empty": bool(content),
        "index digest": hashlib.sha256(content).hexdigest() == digest,
        "not a mapping of manifest and records": bool(header) and bool(listed),
        "type": header.get("type") == kind,
        "protocol_id": header.get("protocol_id") == protocol,
        "status": header.get("status") == "frozen",
        "version": type(version) is int and version >= 1,
        "records missing or empty": bool(held),
        "records digest": hashlib.sha256(held).hexdigest() == listed.get("sha256"),
    }
    if broken := [rule for rule, holds in rules.items() if not holds]:
        raise ContractError(f"{kind}: {', '.join(broken)}")
    records = load(spark, str(table), kind)
    if kind in REFERENCED:
        column, sums = REFERENCED[kind]
        named = [(r[0], str((table.parent / r[0]).resolve())) for r in records.select(column).distinct().collect()]  # a row a file
        there = [(n, hashlib.sha256(b).hexdigest(), len(b)) for n, p in named if Path(p).is_file() for b in [Path(p).read_bytes()]]
        files = spark.createDataFrame(there, "path string, sha256 string, bytes long")
        if lost := [tuple(r) for r in missing_files(records, files, column, sums).limit(100).collect()]:
            raise ContractError(f"{kind}: " + "; ".join("/".join(x) for x in lost[:5]))
    return {"type": kind, "index_path": str(index), "index_digest": digest, "records_path": str(table), "records_digest": listed["sha256"], "records": records}


def load_bundle(spark: SparkSession, config: dict, root: str) -> dict[str, DataFrame]:
    """The records of all indices that a protocol gives a digest and a path for, paths relative to root."""
    from pathlib import Path

    paths = config.get("manifests", {})
    ready = {k: d for k, d in config["manifest_digests"].items() if d != "pending" and paths.get(k)}
    return {k: load_index(spark, str(Path(root) / paths[k]), k, config["protocol"]["id"], d)["records"] for k, d in ready.items()}


def _integer(name: str, least: int = 0) -> Column:
    """Whether a string is a plain integer of at least the given value."""
    number = F.expr(f"try_cast(`{name}` as bigint)")
    return number.isNotNull() & (number.cast("string") == F.col(name)) & (number >= least)


def _positive(name: str) -> Column:
    number = F.expr(f"try_cast(`{name}` as double)")
    return number.isNotNull() & (number > 0) & (number < F.lit(float("inf")))


def _found(rows: DataFrame, table: str, rule: str, key: Column | str) -> DataFrame:
    key = F.col(key) if isinstance(key, str) else key
    return rows.select(F.lit(table).alias("table"), F.lit(rule).alias("rule"), key.cast("string").alias("key"))


def _row_rules(rows: DataFrame, table: str, key: Column, rules: dict[str, Column]) -> list[DataFrame]:
    """One pass over a table: the rules that each row breaks."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(holds, F.lit(False)), F.lit(name)) for name, holds in rules.items())))
    each = rows.select(key.cast("string").alias("key"), F.explode(broken).alias("rule"))
    return [each.select(F.lit(table).alias("table"), "rule", "key")]


def _twice(rows: DataFrame, table: str, rule: str, keys: list[str]) -> DataFrame:
    return _found(rows.groupBy(*keys).count().where("count > 1"), table, rule, F.concat_ws("/", *keys))


def violations(tables: dict[str, DataFrame], n_splits: int) -> DataFrame:
    """table, rule, key of everything that a bundle of the six manifests breaks; no rows for a valid one."""
    data, markers, splits, endpoints, banks = (tables[k] for k in ("data", "markers", "splits", "endpoints", "banks"))
    specimen = F.concat_ws("/", "dataset", "modality", "specimen_id")
    text = lambda c: F.trim(c) != ""
    out = _row_rules(
        data,
        "data",
        specimen,
        {
            **{f"{c}_is_no_digest": F.col(c).rlike(DIGEST) for c in ("source_sha256", "cells_sha256", "labels_sha256", "metadata_sha256", "header_sha256")},
            "source_differs_from_cells": (F.col("source_sha256") == F.col("cells_sha256")) & (F.col("source_path") == F.col("cells_path")),
            **{f"{c}_is_blank": text(c) for c in ("pair", "visit_id", "collection_id", "metadata_source_id", "event_selection_rule_id", "preprocessing_id", "claim_scope", "pair_status")},
            "visit_order_is_no_integer": _integer("visit_order", 1),
            "collection_date_is_no_date": F.col("collection_date").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.expr("try_cast(collection_date as date)").isNotNull(),
            **{f"{c}_is_no_boolean": F.col(c).isin("true", "false") for c in ("upstream_label_selection", "runtime_label_selection", "excluded")},
            "events_are_no_counts": _integer("total_events", 1) & _integer("eligible_events") & (F.expr("try_cast(eligible_events as bigint)") <= F.expr("try_cast(total_events as bigint)")),
            "exclusion_and_reason_disagree": (F.col("excluded") == "true") == text("exclusion_reason"),
        },
    )
    out.append(_twice(data, "data", "specimen_repeated", ["dataset", "modality", "specimen_id"]))
    for column, rule in (("excluded", "exclusion_differs_between_modalities"), ("patient_id", "specimen_of_two_patients")):
        out.append(_found(data.groupBy("dataset", "specimen_id").agg(F.countDistinct(column).alias("n")).where("n > 1"), "data", rule, F.concat_ws("/", "dataset", "specimen_id")))
    owners = data.groupBy(F.col("dataset").alias("d"), F.col("specimen_id").alias("s")).agg(F.min("patient_id").alias("owner"), F.min("excluded").alias("out"))
    included = data.where("excluded = 'false'").select("dataset", "specimen_id", "patient_id").distinct()

    fold = F.expr("try_cast(evaluation_fold as int)")
    split_key = F.concat_ws("/", "dataset", "pair", "evaluation_fold", "specimen_id")
    known = splits.join(owners, (F.col("dataset") == F.col("d")) & (F.col("specimen_id") == F.col("s")), "left")
    out += _row_rules(
        known,
        "splits",
        split_key,
        {
            "fold_out_of_range": _integer("evaluation_fold") & (fold < n_splits),
            "role_unknown": F.col("role").isin("train", "validation", "test"),
            "specimen_unknown": F.col("owner").isNotNull(),
            "specimen_excluded": F.col("owner").isNull() | (F.col("out") == "false"),
            "patient_differs_from_data": F.col("owner").isNull() | (F.col("owner") == F.col("patient_id")),
        },
    )
    out.append(_twice(splits, "splits", "row_repeated", ["dataset", "pair", "evaluation_fold", "specimen_id"]))
    role_of = splits.groupBy("dataset", "pair", "evaluation_fold", "patient_id").agg(F.countDistinct("role").alias("n"), F.min("role").alias("patient_role"))
    out.append(_found(role_of.where("n > 1"), "splits", "patient_in_two_roles", F.concat_ws("/", "dataset", "evaluation_fold", "patient_id")))
    people = lambda t: t.select("dataset", "patient_id").distinct()
    out.append(_found(people(included).join(people(splits), ["dataset", "patient_id"], "leftanti"), "splits", "patient_missing", F.concat_ws("/", "dataset", "patient_id")))
    out.append(_found(people(splits).join(people(included), ["dataset", "patient_id"], "leftanti"), "splits", "patient_not_in_data", F.concat_ws("/", "dataset", "patient_id")))
    pairs = splits.select("dataset", "pair").distinct().withColumn("evaluation_fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1)))).withColumn("evaluation_fold", F.col("evaluation_fold").cast("string"))
    wanted = pairs.join(included.select("dataset", "specimen_id"), "dataset")
    out.append(_found(wanted.join(splits, ["dataset", "pair", "evaluation_fold", "specimen_id"], "leftanti"), "splits", "specimen_missing_from_fold", split_key))
    tests = splits.groupBy("dataset", "pair", "patient_id").agg(F.countDistinct(F.when(F.col("role") == "test", F.col("evaluation_fold"))).alias("n"))
    out.append(_found(tests.where("n <> 1"), "splits", "patient_not_tested_once", F.concat_ws("/", "dataset", "pair", "patient_id")))

    marker_key = F.concat_ws("/", "dataset", "direction", "modality", "canonical_marker")
    analysed = F.col("analysis_role").isin("H", "Y")
    named = markers.join(data.select(F.col("dataset").alias("d")).distinct(), F.col("dataset") == F.col("d"), "left")
    out += _row_rules(
        named,
        "markers",
        marker_key,
        {
            "dataset_unknown": F.col("d").isNotNull(),
            "role_unknown": F.col("role").isin("H", "Y", "source_only", "technical"),
            "analysis_role_differs": F.col("analysis_role") == F.when(F.col("role") == "technical", "excluded").otherwise(F.col("role")),
            "channel_type_unknown": F.col("channel_type").isin("biological", "technical"),
            "technical_role_of_other_channel": (F.col("role") != "technical") | (F.col("channel_type") == "technical"),
            "order_is_no_integer": _integer("marker_order") & _integer("panel_order"),
            "analysis_order_wrong": F.when(analysed, _integer("analysis_order")).otherwise(F.col("analysis_order") == ""),
            **{f"{c}_is_blank": text(c) for c in ("transformation", "transformation_confidence", "alias_rule", "alias_evidence")},
        },
    )
    side = ["dataset", "direction", "modality"]
    out.append(_twice(markers, "markers", "marker_repeated", [*side, "canonical_marker"]))
    out.append(_twice(markers, "markers", "order_repeated", [*side, "marker_order"]))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("analysis_role") == "H", F.struct(F.expr("try_cast(analysis_order as int)").alias("o"), F.col("canonical_marker").alias("m"))))), lambda x: x["m"]), ",")
    sequences = markers.groupBy(*side).agg(ordered.alias("h"))
    out.append(_found(sequences.where("h = ''"), "markers", "no_shared_markers", F.concat_ws("/", *side)))
    out.append(_found(sequences.groupBy("dataset", "direction").agg(F.countDistinct("h").alias("n")).where("n > 1"), "markers", "shared_order_differs", F.concat_ws("/", "dataset", "direction")))

    out.append(_found(endpoints.join(people(included), ["dataset", "patient_id"], "leftanti"), "endpoints", "patient_unknown", F.concat_ws("/", "dataset", "patient_id")))
    out += _row_rules(endpoints, "endpoints", F.concat_ws("/", "dataset", "patient_id", "endpoint"), {"eligibility_unknown": F.col("eligibility").isin("primary", "secondary", "exploratory", "not_evaluable")})
    return _union([*out, *_bank_rules(banks, data, role_of, n_splits)])


def stress_violations(stress: DataFrame, data: DataFrame) -> DataFrame:
    """table, rule, key of what stress conditions break beyond their files (load_index checks those): stricter than a
    bundle has to be, so violations() does not ask for it."""
    named = stress.join(data.select(F.col("dataset").alias("d")).distinct(), F.col("dataset") == F.col("d"), "left")
    rules = {
        "dataset_unknown": F.col("d").isNotNull(),
        **{f"{c}_is_blank": F.trim(c) != "" for c in ("condition_id", "factor", "level", "content_file")},
        "seed_is_no_integer": _integer("seed"),
        "content_is_no_digest": F.col("content_sha256").rlike(DIGEST),
    }
    contents = stress.groupBy("content_file").agg(F.countDistinct("content_sha256").alias("n")).where("n > 1")
    return _union([*_row_rules(named, "stress", F.col("condition_id"), rules), _twice(stress, "stress", "condition_repeated", ["dataset", "condition_id"]), _found(contents, "stress", "file_of_two_digests", "content_file")])


def _bank_rules(banks: DataFrame, data: DataFrame, role_of: DataFrame, n_splits: int) -> list[DataFrame]:
    stage = F.create_map(*(x for s, roles in STAGES.items() for x in (F.lit(s), F.lit(";".join(roles)))))
    allowed = F.element_at(stage, F.col("fit_stage"))
    about = data.select(F.col("dataset").alias("d"), F.col("modality").alias("m"), F.col("specimen_id").alias("s"), F.col("patient_id").alias("owner"), F.col("excluded").alias("out"), F.expr("try_cast(eligible_events as bigint)").alias("eligible"))
    roles = role_of.select(F.col("dataset").alias("rd"), F.col("pair").alias("rp"), F.col("evaluation_fold").alias("rf"), F.col("patient_id").alias("rpatient"), "patient_role")
    key = F.concat_ws("/", "reference_bank_id", "specimen_id")
    joined = banks.join(about, (F.col("dataset") == F.col("d")) & (F.col("modality") == F.col("m")) & (F.col("specimen_id") == F.col("s")), "left")
    joined = joined.join(roles, (F.col("dataset") == F.col("rd")) & (F.col("pair") == F.col("rp")) & (F.col("evaluation_fold") == F.col("rf")) & (F.col("patient_id") == F.col("rpatient")), "left")
    count = F.expr("try_cast(event_count as bigint)")
    out = _row_rules(
        joined,
        "banks",
        key,
        {
            "specimen_unknown": F.col("owner").isNotNull(),
            "patient_differs_from_data": F.col("owner").isNull() | (F.col("owner") == F.col("patient_id")),
            "specimen_excluded": F.col("owner").isNull() | (F.col("out") == "false"),
            "fold_out_of_range": _integer("evaluation_fold") & (F.expr("try_cast(evaluation_fold as int)") < n_splits),
            "fit_stage_unknown": allowed.isNotNull(),
            "roles_differ_from_stage": allowed.isNull() | (F.col("included_split_roles") == allowed),
            "patient_outside_fitting_roles": allowed.isNull() | F.array_contains(F.split(allowed, ";"), F.coalesce("patient_role", F.lit("?"))),
            "seed_is_no_integer": _integer("seed") & _integer("row_index_seed"),
            "event_count_wrong": _integer("event_count", 1) & (F.col("eligible").isNull() | (count <= F.col("eligible"))),
            "weight_not_positive": _positive("patient_weight") & _positive("specimen_weight") & _positive("event_weight"),
            "algorithm_unknown": F.col("sampling_algorithm") == "numpy_pcg64_uniform_without_replacement_sorted_v1",
            "row_type_wrong": F.col("row_index_dtype") == "uint32",
            "not_materialized": F.col("status") == "materialized_validated",
            "bank_role_unknown": F.col("bank_role").isin(*BANK_ROLES),
        },
    )
    shared = banks.groupBy("dataset", "modality", "specimen_id", "seed").agg(F.countDistinct(F.struct("row_index_file", "row_index_sha256", "event_count")).alias("n"))
    out.append(_found(shared.where("n > 1"), "banks", "rows_not_shared_between_banks", F.concat_ws("/", "dataset", "modality", "specimen_id", "seed")))
    dimensions = ["dataset", "pair", "direction", "modality", "evaluation_fold", "fit_stage", "seed", "bank_role"]
    out.append(_found(banks.groupBy("reference_bank_id").agg(F.countDistinct(F.struct(*dimensions)).alias("n")).where("n > 1"), "banks", "bank_of_two_kinds", "reference_bank_id"))
    out.append(_twice(banks, "banks", "membership_repeated", ["reference_bank_id", "patient_id", "specimen_id"]))
    kinds = banks.select("reference_bank_id", *dimensions).distinct().withColumn("allowed", F.split(allowed, ";"))
    members = kinds.join(roles, (F.col("dataset") == F.col("rd")) & (F.col("pair") == F.col("rp")) & (F.col("evaluation_fold") == F.col("rf"))).where(F.array_contains("allowed", F.col("patient_role")))
    members = members.join(about.where("out = 'false'"), (F.col("dataset") == F.col("d")) & (F.col("modality") == F.col("m")) & (F.col("rpatient") == F.col("owner")))
    wanted = members.select("reference_bank_id", F.col("s").alias("specimen_id")).distinct()
    here = banks.select("reference_bank_id", "specimen_id").distinct()
    out.append(_found(wanted.join(here, ["reference_bank_id", "specimen_id"], "leftanti"), "banks", "member_missing", key))
    per_patient = W.partitionBy("reference_bank_id", "patient_id")
    patients = banks.groupBy("reference_bank_id").agg(F.countDistinct("patient_id").alias("p"))
    weighed = banks.withColumn("k", F.count(F.lit(1)).over(per_patient)).join(patients, "reference_bank_id")
    want_p = 1.0 / F.col("p")
    close = lambda c, want: F.abs(F.expr(f"try_cast(`{c}` as double)") - want) <= F.greatest(1e-12 * F.abs(want), F.lit(1e-15))
    out += _row_rules(weighed.where(_integer("event_count", 1)), "banks", key, {"patient_weight_wrong": close("patient_weight", want_p), "specimen_weight_wrong": close("specimen_weight", want_p / F.col("k")), "event_weight_wrong": close("event_weight", want_p / F.col("k") / count)})
    return out


def missing_files(records: DataFrame, files: DataFrame, path: str, digest: str) -> DataFrame:
    """path, rule: referenced files that are missing, empty or of another digest. files: path, sha256, bytes."""
    named = files.select(F.col("path").alias("__p"), "sha256", "bytes")
    joined = records.select(path, digest).distinct().join(named, F.col(path) == F.col("__p"), "left")
    rule = F.when(F.col("sha256").isNull(), "missing").when(F.col("bytes") == 0, "empty").when(F.col("sha256") != F.col(digest), "digest_differs")
    return joined.select(F.col(path).alias("path"), rule.alias("rule")).where("rule is not null")


def _union(frames: list[DataFrame]) -> DataFrame:
    while len(frames) > 1:  # pairwise, so that the plan stays shallow
        frames = [a.unionByName(b) for a, b in zip(frames[::2], frames[1::2])] + (frames[-1:] if len(frames) % 2 else [])
    return frames[0]


def preflight(config: dict, tables: dict[str, DataFrame] | None, mode: str = "draft") -> dict:
    """Readiness of a protocol and, where its six tables are given, of its bundle; full mode raises on anything open."""
    from .contract import MANIFESTS, check, protocol_digest

    check(config)
    if mode not in ("draft", "full"):
        raise ContractError("mode is draft or full")
    frozen = config["protocol"]["status"] == "frozen"
    pending = sorted(k for k, v in config["manifest_digests"].items() if v == "pending")
    missing = sorted(set(MANIFESTS) - set(tables or {}))
    if mode == "full" and (not frozen or missing or pending):
        raise ContractError(f"not ready: frozen={frozen}, missing={missing}, pending={pending}")
    broken = [tuple(r) for r in violations(tables, int(config["split"]["n_splits"])).limit(100).collect()] if not missing else []
    if broken:
        raise ContractError("; ".join("/".join(b) for b in broken[:5]))
    return {"status": "ok", "mode": mode, "protocol_digest": protocol_digest(config), "missing": missing, "pending": pending, "ready": frozen and not missing and not pending}
