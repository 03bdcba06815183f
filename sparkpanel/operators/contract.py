"""Fail-closed checks of a protocol: a table of rules over a nested configuration, method capabilities, digests."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping, Sequence
from datetime import date
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A protocol, manifest or artifact that breaks its contract."""


class Method(NamedTuple):
    uses_cell_labels: bool
    uses_endpoint_labels: bool
    uses_test_target: bool
    output: str
    status: str


# Fixed values.
METHODS = {
    "global_target_median": Method(False, False, False, "point", "implemented"),
    "target_prior_sampler": Method(False, False, False, "distribution", "implemented"),
    "ridge": Method(False, False, False, "point", "implemented"),
    "knn50": Method(False, False, False, "both", "implemented"),
    "boosted_tree": Method(False, False, False, "point", "pending_adapter"),
    "simple_mlp": Method(False, False, False, "point", "implemented"),
    "cytobackbone": Method(False, False, False, "distribution", "pending_adapter"),
    "cycombine": Method(False, False, False, "distribution", "implemented"),
    "cytovi": Method(False, False, False, "both", "implemented"),
    "uvae": Method(False, False, False, "both", "implemented"),
    "cell_type_median": Method(True, False, False, "point", "oracle_only"),
}
MANIFESTS = ("data", "markers", "splits", "endpoints", "banks", "stress")
LITERALS = {
    "information_access.translator_cell_labels": "forbidden",
    "information_access.translator_endpoint_labels": "forbidden",
    "information_access.downstream_outcome_labels": "outer_train_only",
    "information_access.test_target_statistics": "forbidden",
    "information_access.label_informed_track": "oracle_supplement_only",
    "data.sampling": "reservoir",
    "data.inference_unit": "patient",
    "data.longitudinal_aggregation": "patient_first_equal_specimen_weight",
    "data.specimen_event_policy.primary_low_event_action": "include_with_flag",
    "data.authoritative_metadata.artifact_id": "AML_meta_111224",
    "data.authoritative_metadata.patient_column": "Reg. ID",
    "data.authoritative_metadata.visit_column": "Coll. ID",
    "data.authoritative_metadata.collection_date_column": "Date",
    "data.authoritative_metadata.date_format": "%m/%d/%y",
    "data.event_selection.primary_requirement": "label_free",
    "data.event_selection.conditional_pregated_fallback_requires_claim_restriction": True,
    "data.event_selection.aml_primary_source_level": "raw_fcs",
    "data.event_selection.aml_primary_rule": "technical_qc_only",
    "data.event_selection.aml_processed_role": "conditional_sensitivity_only",
    "data.event_selection.nunez_local_row_selection": "all_public_pregated_rows",
    "data.event_selection.evaluation_labels_for_event_selection": "forbidden",
    "split.frozen_manifest_required": True,
    "split.dynamic_rebuild_forbidden": True,
    "split.sensitivity_patient_fold_policy": "preserve_primary_assignments",
    "training.label_conditioning": False,
    "reference_bank.primary_mode": "data_matched",
    "reference_bank.patient_set": "outer_training_target",
    "reference_bank.specimen_set": "all_eligible",
    "reference_bank.patient_weighting": "patient_then_equal_specimen",
    "reference_bank.sampled_rows_shared_across_methods": True,
    "reference_bank.pairing_curve_holds_bank_fixed": True,
    "reference_bank.native_bank_deviation": "secondary_only",
    "reference_bank.record_actual_budget": True,
    "evaluation.label_stratified_selection": False,
    "evaluation.require_exact_specimen_keys": True,
    "evaluation.primary_scale": "target_training_patient_balanced_iqr",
    "evaluation.split_half_interpretation": "finite_cell_sampling_floor",
    "endpoint_policy.role": "secondary_clinical_illustration",
    "endpoint_policy.exact_duplicate": "deduplicate_with_audit",
    "endpoint_policy.single_source_annotation": "unknown_until_common_provenance",
    "endpoint_policy.cross_source_conflict": "not_evaluable",
    "endpoint_policy.longitudinal_conflict": "endpoint_specific_not_evaluable",
    "endpoint_policy.ever_mutant_collapse": "forbidden",
    "reporting.record_git_state": True,
    "reporting.record_protocol_digest": True,
    "reporting.record_manifest_digests": True,
    "reporting.record_accessed_information": True,
    "reporting.record_sampled_row_indices": True,
    "reporting.record_method_failures": True,
}
INTEGERS = {  # least value
    "protocol.version": 1,
    "data.max_cells_per_specimen": 1,
    "data.specimen_event_policy.primary_min_events_per_modality": 1,
    "data.specimen_event_policy.low_event_flag_below": 1,
    "data.specimen_event_policy.sensitivity_exclude_below": 1,
    "split.n_splits": 2,
    "split.fold_seed": 0,
    "reference_bank.cells_per_specimen_cap": 1,
    "endpoint_policy.formal_support_min_total_per_class": 1,
    "endpoint_policy.formal_support_min_test_fold_per_class": 1,
}
FRACTIONS = ("split.validation_fraction", "evaluation.upper_quantile")
SEQUENCES = {
    "reference_bank.fit_stages.inner_fit": ("train",),
    "reference_bank.fit_stages.outer_refit": ("train", "validation"),
    "evaluation.zero_iqr_fallback": ("target_training_patient_balanced_mad", "locked_minimum_scale"),
}
REQUIRED_MEMBERS = {
    "evaluation.required_tracks": ("marginal", "joint", "individualization"),
    "evaluation.required_nulls": ("global_target_median", "target_prior_sampler", "wrong_patient_reference"),
}


def value_at(config: Mapping, path: str):
    """The value under a dotted path; raises where a step is no mapping or lacks the key."""
    here: object = config
    for step in path.split("."):
        if not isinstance(here, Mapping) or step not in here:
            raise ContractError(f"missing: {path}")
        here = here[step]
    return here


def is_sha256(value: object) -> bool:
    return isinstance(value, str) and len(value) == 64 and not set(value) - set("0123456789abcdef")


def integer(value: object, least: int) -> bool:
    return isinstance(value, int) and not isinstance(value, bool) and value >= least


def listed(value: object) -> tuple:
    if isinstance(value, (str, bytes)) or not isinstance(value, Sequence):
        raise ContractError(f"not a sequence: {value!r}")
    return tuple(value)


def method_violations(names, require_implemented: bool, methods: Mapping[str, Method] = METHODS) -> list[str]:
    """Sorted name:reason of unknown methods, methods of forbidden information, and (asked for) unfinished ones."""
    out = []
    for name in sorted(set(names)):
        m = methods.get(name)
        if m is None:
            out.append(f"{name}:unknown")
        elif m.uses_cell_labels or m.uses_endpoint_labels or m.uses_test_target:
            out.append(f"{name}:forbidden_information")
        elif require_implemented and m.status != "implemented":
            out.append(f"{name}:{m.status}")
    return out


def method_table(spark, methods: Mapping[str, Method] = METHODS) -> DataFrame:
    return spark.createDataFrame([(n, *m) for n, m in methods.items()], "method string, uses_cell_labels boolean, uses_endpoint_labels boolean, uses_test_target boolean, output string, status string")


def method_violation_rows(used: DataFrame, registry: DataFrame, require_implemented: bool) -> DataFrame:
    """method, reason: method_violations as a relation. used: method."""
    joined = used.select("method").distinct().join(F.broadcast(registry), "method", "left")
    reason = F.when(F.col("output").isNull(), "unknown").when(F.col("uses_cell_labels") | F.col("uses_endpoint_labels") | F.col("uses_test_target"), "forbidden_information")
    if require_implemented:
        reason = reason.when(F.col("status") != "implemented", F.col("status"))
    return joined.select("method", reason.alias("reason")).where("reason is not null")


def violations(config: Mapping) -> list[str]:
    """Every rule that a protocol breaks, as path: reason; empty for a valid one."""
    out: list[str] = []

    def rule(path: str, holds, reason: str) -> None:
        try:
            if not holds(value_at(config, path)):
                out.append(f"{path}: {reason}")
        except ContractError as error:
            out.append(f"{path}: {error}")

    text = lambda v: isinstance(v, str) and bool(v.strip())
    rule("protocol.id", text, "blank")
    rule("protocol.status", lambda v: v in ("draft", "frozen"), "neither draft nor frozen")
    rule("protocol.created_date", _iso_date, "no ISO date")
    for path, want in LITERALS.items():
        rule(path, lambda v, want=want: type(v) is type(want) and v == want, f"must be {want!r}")
    for path, least in INTEGERS.items():
        rule(path, lambda v, least=least: integer(v, least), f"must be an integer of at least {least}")
    for path in FRACTIONS:
        rule(path, lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and 0 < v < 1, "must lie between 0 and 1")
    for path, want in SEQUENCES.items():
        rule(path, lambda v, want=want: tuple(map(str, listed(v))) == want, f"must be {list(want)}")
    for path, want in REQUIRED_MEMBERS.items():
        rule(path, lambda v, want=want: set(want) <= set(map(str, listed(v))), f"must hold {list(want)}")
    rule("data.authoritative_metadata.expected_sha256", is_sha256, "no SHA-256")
    rule("training.seeds", lambda v: bool(listed(v)) and all(integer(s, -(2**63)) for s in v) and len(set(v)) == len(v), "must be unique integers")
    if out:
        return out
    frozen = value_at(config, "protocol.status") == "frozen"
    policy = value_at(config, "data.specimen_event_policy")
    least, low, excluded = (policy[k] for k in ("primary_min_events_per_modality", "low_event_flag_below", "sensitivity_exclude_below"))
    if low < least or excluded != low:
        out.append("data.specimen_event_policy: flag and exclusion thresholds must agree and not undercut the minimum")
    if value_at(config, "reference_bank.cells_per_specimen_cap") != value_at(config, "data.max_cells_per_specimen"):
        out.append("reference_bank.cells_per_specimen_cap: differs from data.max_cells_per_specimen")
    rule("data.authoritative_metadata.release_reference", lambda v: text(v) and not (frozen and v == "pending"), "must be portable before the freeze")
    rule("methods.primary", lambda v: all(text(x) for x in listed(v)) and len(set(v)) == len(v), "must be unique names")
    rule("methods.forbidden_primary", lambda v: not set(map(str, listed(v))) & set(map(str, value_at(config, "methods.primary"))), "meets methods.primary")
    rule("methods.primary", lambda v: "target_prior_sampler" in v, "must hold target_prior_sampler")
    rule("methods.primary", lambda v: not method_violations(map(str, v), frozen), "holds methods that are unknown, informed or unfinished")
    for name in MANIFESTS:
        rule(f"manifests.{name}", text, "must be a path")
        rule(f"manifest_digests.{name}", lambda v: is_sha256(v) or (not frozen and v == "pending"), "no SHA-256")
    return out


def _iso_date(value: object) -> bool:
    try:
        return bool(date.fromisoformat(str(value)))
    except ValueError:
        return False


def check(config: Mapping) -> None:
    if found := violations(config):
        raise ContractError("; ".join(found))


def protocol_digest(config: Mapping) -> str:
    """SHA-256 of the canonical JSON of a valid protocol."""
    check(config)
    return hashlib.sha256(json.dumps(config, sort_keys=True, separators=(",", ":"), default=str).encode()).hexdigest()


class LockedScales(NamedTuple):
    """Feature scales fitted on an outer training target, with where they come from."""

    values: tuple[float, ...]
    markers: tuple[str, ...]
    fold: int
    fit_role: str
    patient_digest: str
    manifest_digest: str


def locked_scales(values, markers, fold: int, fit_role: str, patient_digest: str, manifest_digest: str) -> LockedScales:
    values, markers = tuple(map(float, values)), tuple(markers)
    if fit_role != "outer_training_target":
        raise ContractError("scales are fitted on the outer training target")
    if not values or len(values) != len(markers) or len(set(markers)) != len(markers) or not all(0 < v < float("inf") for v in values) or not all(isinstance(m, str) and m.strip() for m in markers):
        raise ContractError("scales are finite, positive, and named once each")
    if not integer(fold, 0) or not is_sha256(patient_digest) or not is_sha256(manifest_digest):
        raise ContractError("scales carry a fold and two digests")
    return LockedScales(values, markers, fold, fit_role, patient_digest, manifest_digest)


def training_reference_violations(bank: DataFrame, markers: list[str]) -> DataFrame:
    """specimen_id, rule: specimens of two patients, and cells with missing or non-finite values."""
    two = bank.groupBy("specimen_id").agg(F.countDistinct("patient_id").alias("n")).where("n > 1").select("specimen_id", F.lit("specimen_of_two_patients").alias("rule"))
    bad = F.lit(False)
    for m in markers:
        bad = bad | F.col(m).isNull() | F.isnan(m) | (F.abs(F.col(m)) == F.lit(float("inf")))
    return two.unionByName(bank.where(bad).select("specimen_id", F.lit("value_not_finite").alias("rule")).distinct())
