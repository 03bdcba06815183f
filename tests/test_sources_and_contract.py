"""Files, configurations, protocols, manifests, streaming, plans, and the driver's entry points."""

import copy
import hashlib
import json
import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import contract, knn, manifests, sampling
from sparkpanel.sources import config, specimens
from sparkpanel.streaming import ingest
from tests.conftest import ROOT


def write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


@pytest.fixture
def tree(tmp_path):
    for modality, head in (("spectral_flow", "CD3,CD4,FSC-A"), ("cytof", "CD3,Y,Z")):
        for s, n in (("R1_1", 3), ("R2_1", 30)):
            write(f"{tmp_path}/{modality}/cells/{s}.csv", head + "\n" + "\n".join(f"{k},{100 + k},{k / 2}" for k in range(n)) + "\n")
            write(f"{tmp_path}/{modality}/labels/{s}.csv", "cell_type\n" + "\n".join(["Blast", "Debris", "T cell CD4"][k % 3] for k in range(n)))
    return str(tmp_path)


def test_scan_keeps_positions_and_order(spark, tree):
    got = specimens.scan(spark, tree, "spectral_flow", ["CD4", "CD3"])
    assert got.columns[-2:] == ["CD4", "CD3"]
    one = sorted((r.row_idx, r.CD4, r.CD3, r.cell_type, r.patient_id) for r in got.where("specimen_id = 'R1_1'").collect())
    assert one == [(0, 100.0, 0.0, "Blast", "R1"), (2, 102.0, 2.0, "T cell", "R1")]
    assert specimens.scan(spark, tree, "spectral_flow", ["CD3"], head=2, drop_unmapped=False).groupBy("specimen_id").count().where("count = 2").count() == 2
    assert specimens.row_mismatches(spark, tree, "cytof").count() == 0
    write(f"{tree}/cytof/labels/R1_1.csv", "label\nBlast\n")
    assert [tuple(r) for r in specimens.row_mismatches(spark, tree, "cytof").collect()] == [("R1_1", 3, 1)]
    with pytest.raises(ValueError):
        specimens.scan(spark, tree, "spectral_flow", ["CD99"])


def test_pairs_need_all_four_files(spark, tree):
    assert specimens.exact_pairs(spark, tree, "spectral_flow", "cytof").count() == 2
    os.remove(f"{tree}/cytof/labels/R2_1.csv")
    assert [r[0] for r in specimens.exact_pairs(spark, tree, "spectral_flow", "cytof").collect()] == ["R1_1"]


def test_frozen_rows_and_cache(spark, tree, tmp_path):
    counts = spark.createDataFrame([("spectral_flow", "R1_1", 3), ("spectral_flow", "R2_1", 30)], "modality string, specimen_id string, eligible_events long")
    rows = specimens.frozen_rows(counts, 10, [1, 2])
    assert rows.groupBy("specimen_id", "seed").count().orderBy("specimen_id").first()["count"] == 3 and rows.count() == 26
    assert specimens.frozen_row_violations(rows, counts, 10).count() == 0
    broken = rows.withColumn("row_idx", F.when(F.col("specimen_id") == "R2_1", F.col("row_idx") + 1).otherwise(F.col("row_idx")))
    assert {r.rule for r in specimens.frozen_row_violations(broken, counts, 10).collect()} <= {"row_out_of_bounds", "not_drawn_by_seed"}
    specimens.write_cache(specimens.scan(spark, tree, "spectral_flow", drop_unmapped=False), rows, f"{tmp_path}/cache", 1)
    cached = specimens.read_cache(spark, f"{tmp_path}/cache", "spectral_flow", ["R2_1"])
    assert cached.count() == 10 and "PartitionFilters: [isnotnull" in cached._jdf.queryExecution().toString()


def test_digests_metadata_csv(spark, tree, tmp_path):
    with open(f"{tree}/cytof/cells/R1_1.csv", "rb") as f:
        want = hashlib.sha256(f.read()).hexdigest()
    assert want in {r.sha256 for r in specimens.file_digests(spark, f"{tree}/cytof").collect()}
    write(f"{tmp_path}/meta.csv", "Reg. ID,Coll. ID,Date\nR1,2,3/14/21\nR1,1,12/1/20\nR2,1,never\n")
    got = sorted((r.specimen_id, str(r.collection_date)) for r in specimens.metadata(spark, f"{tmp_path}/meta.csv", "Reg. ID", "Coll. ID", "Date").collect())
    assert got == [("R1_1", "2020-12-01"), ("R1_2", "2021-03-14"), ("R2_1", "None")]
    specimens.write_csv(spark.createDataFrame([], "a string, b int"), f"{tmp_path}/out")


def test_configs(tmp_path):
    write(f"{tmp_path}/parent.yaml", "data: {root: x, cells: 5}\ntraining: {epochs: 3}\n")
    write(f"{tmp_path}/child.yaml", "extends: parent.yaml\ndata: {cells: 9}\n")
    assert config.load(f"{tmp_path}/child.yaml") == {"data": {"root": "x", "cells": 9}, "training": {"epochs": 3}}
    rows = [(0, "train", "R1", "R1_1"), (0, "validation", "R2", "R2_1"), (0, "test", "R3", "R3_1")]
    config.write_splits(rows, f"{tmp_path}/splits.json")
    assert sorted(config.read_splits(f"{tmp_path}/splits.json")) == sorted(rows)


def protocol():
    out: dict = {}

    def put(path, value):
        here = out
        *steps, last = path.split(".")
        for s in steps:
            here = here.setdefault(s, {})
        here[last] = value

    for path, value in contract.LITERALS.items():
        put(path, value)
    for path, least in contract.INTEGERS.items():
        put(path, max(least, 5))
    for path in contract.FRACTIONS:
        put(path, 0.2)
    for path, value in {**contract.SEQUENCES, **contract.REQUIRED_MEMBERS}.items():
        put(path, list(value))
    for path, value in {"protocol.id": "p", "protocol.status": "draft", "protocol.created_date": "2026-01-02", "training.seeds": [1, 2], "data.authoritative_metadata.expected_sha256": "a" * 64, "data.authoritative_metadata.release_reference": "pending", "methods.primary": ["target_prior_sampler", "knn50", "boosted_tree"], "methods.forbidden_primary": ["cell_type_median"]}.items():
        put(path, value)
    for name in contract.MANIFESTS:
        put(f"manifests.{name}", f"{name}.yaml")
        put(f"manifest_digests.{name}", "pending")
    return out


@pytest.mark.parametrize(
    "path,value",
    [
        ("information_access.test_target_statistics", "allowed"),
        ("training.label_conditioning", True),
        ("training.label_conditioning", 0),
        ("split.n_splits", True),
        ("split.validation_fraction", 1),
        ("training.seeds", [1, 1]),
        ("methods.primary", ["knn50"]),
        ("methods.primary", ["target_prior_sampler", "cell_type_median"]),
        ("methods.primary", ["target_prior_sampler", "nobody"]),
        ("protocol.status", "frozen"),
        ("protocol.created_date", "soon"),
        ("reference_bank.fit_stages.inner_fit", ["train", "test"]),
        ("reference_bank.cells_per_specimen_cap", 6),
        ("manifest_digests.data", "x"),
        ("reporting.record_git_state", None),
    ],
)
def test_protocols_fail_closed(path, value):
    good = protocol()
    assert contract.violations(good) == []
    bad = copy.deepcopy(good)
    *steps, last = path.split(".")
    here = bad
    for s in steps:
        here = here[s]
    here[last] = value
    with pytest.raises(contract.ContractError):
        contract.check(bad)
    assert contract.protocol_digest(copy.deepcopy(good)) == contract.protocol_digest(good)


def test_methods(spark):
    names = ["ridge", "boosted_tree", "cell_type_median", "nobody"]
    assert contract.method_violations(names, True) == ["boosted_tree:pending_adapter", "cell_type_median:forbidden_information", "nobody:unknown"]
    rows = contract.method_violation_rows(spark.createDataFrame([(n,) for n in names], "method string"), contract.method_table(spark), True)
    assert sorted(f"{r.method}:{r.reason}" for r in rows.collect()) == contract.method_violations(names, True)
    with pytest.raises(contract.ContractError):
        contract.locked_scales([1.0, float("nan")], ["a", "b"], 0, "outer_training_target", "a" * 64, "b" * 64)
    assert contract.locked_scales([1, 2], ["a", "b"], 0, "outer_training_target", "a" * 64, "b" * 64).values == (1.0, 2.0)


def bundle():
    sha = "c" * 64
    people = [("R1_1", "R1"), ("R1_2", "R1"), ("R2_1", "R2"), ("R3_1", "R3")]
    blank = lambda kind, **values: {**dict.fromkeys(manifests.COLUMNS[kind], "x"), **values}
    data = [blank("data", dataset="d", modality=m, specimen_id=s, patient_id=p, collection_date="2020-01-02", visit_order="1", source_path="c", cells_path="c", total_events="20", eligible_events="10", excluded="false", exclusion_reason="", upstream_label_selection="true", runtime_label_selection="false", **{f"{k}_sha256": sha for k in ("source", "cells", "labels", "metadata", "header")}) for m in ("a", "b") for s, p in people]
    role = lambda f, p: ("test", "validation", "train")[(int(p[1]) - 1 + f) % 3]
    splits = [blank("splits", dataset="d", pair="ab", evaluation_fold=str(f), role=role(f, p), patient_id=p, specimen_id=s) for f in range(3) for s, p in people]
    markers = [blank("markers", dataset="d", direction="a_to_b", modality=m, canonical_marker=c, role=r, analysis_role="excluded" if r == "technical" else r, channel_type="technical" if r == "technical" else "biological", marker_order=str(k), panel_order=str(k), analysis_order=str(k) if r in "HY" else "") for m in ("a", "b") for k, (c, r) in enumerate([("CD3", "H"), ("CD4", "H"), ("T", "technical")])]
    endpoints = [blank("endpoints", dataset="d", patient_id="R1", eligibility="secondary")]
    banks = []
    for f in range(3):
        for stage, roles in (("inner_fit", ["train"]), ("outer_refit", ["train", "validation"])):
            inside = [(s, p) for s, p in people if role(f, p) in roles]
            n = len({p for _, p in inside})
            for s, p in inside:
                w = 1 / n
                v = w / sum(q == p for _, q in inside)
                banks.append(blank("banks", reference_bank_id=f"{f}{stage}", dataset="d", pair="ab", direction="a_to_b", modality="b", evaluation_fold=str(f), fit_stage=stage, included_split_roles=";".join(roles), seed="1", row_index_seed="7", bank_role="null_prior_bank", patient_id=p, specimen_id=s, event_count="10", patient_weight=repr(w), specimen_weight=repr(v), event_weight=repr(v / 10), sampling_algorithm="numpy_pcg64_uniform_without_replacement_sorted_v1", row_index_dtype="uint32", status="materialized_validated", row_index_file=f"{s}.npy", row_index_sha256=sha))
    return {"data": data, "splits": splits, "markers": markers, "endpoints": endpoints, "banks": banks, "stress": [blank("stress")]}


def tables(spark, content):
    return {k: spark.createDataFrame([tuple(r[c] for c in manifests.COLUMNS[k]) for r in rows], ", ".join(f"{c} string" for c in manifests.COLUMNS[k])) for k, rows in content.items()}


def test_manifest_bundle(spark, tmp_path):
    good = tables(spark, bundle())
    assert manifests.violations(good, 3).collect() == []
    ready = manifests.preflight({**protocol(), "split": {**protocol()["split"], "n_splits": 3}}, good)
    assert ready["status"] == "ok" and not ready["ready"]
    with pytest.raises(contract.ContractError):
        manifests.preflight(protocol(), good, mode="full")
    good["splits"].write.option("header", True).csv(f"{tmp_path}/splits")
    assert manifests.load(spark, f"{tmp_path}/splits", "splits").count() == 12
    with pytest.raises(contract.ContractError):
        manifests.load(spark, f"{tmp_path}/splits", "banks")


def test_manifest_violations_are_found_together(spark):
    broken = bundle()
    changes = [
        ("data", 0, "cells_sha256", "xyz", "cells_sha256_is_no_digest"),
        ("data", 1, "collection_date", "2020-13-01", "collection_date_is_no_date"),
        ("data", 2, "eligible_events", "21", "events_are_no_counts"),
        ("data", 3, "excluded", "true", "exclusion_and_reason_disagree"),
        ("splits", 0, "role", "train", "patient_in_two_roles"),
        ("splits", 3, "evaluation_fold", "9", "fold_out_of_range"),
        ("splits", 6, "patient_id", "R9", "patient_differs_from_data"),
        ("markers", 0, "analysis_order", "", "analysis_order_wrong"),
        ("markers", 3, "canonical_marker", "CD8", "shared_order_differs"),
        ("endpoints", 0, "patient_id", "R9", "patient_unknown"),
        ("banks", 0, "event_weight", "0.9", "event_weight_wrong"),
        ("banks", 1, "event_count", "99", "event_count_wrong"),
        ("banks", 2, "status", "pending", "not_materialized"),
    ]
    for table, row, column, value, _ in changes:
        broken[table][row] = {**broken[table][row], column: value}
    broken["banks"] = broken["banks"][:-1]
    found = {r.rule for r in manifests.violations(tables(spark, broken), 3).collect()}
    assert {rule for *_, rule in changes} | {"member_missing"} <= found


def test_missing_files(spark):
    records = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3"), ("d", "4")], "f string, h string")
    files = spark.createDataFrame([("a", "1", 5), ("b", "9", 5), ("c", "3", 0)], "path string, sha256 string, bytes long")
    got = {r.path: r.rule for r in manifests.missing_files(records, files, "f", "h").collect()}
    assert got == {"b": "digest_differs", "c": "empty", "d": "missing"}


def test_streams_match_batches(spark, tmp_path):
    rows = spark.createDataFrame([(f"2024-01-01 0{h}:30:00", "a", float(h)) for h in range(6)], "t string, label string, v double").withColumn("t", F.to_timestamp("t"))
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    batch = ingest.windowed_counts(rows, "t", "label", "v")
    live = ingest.windowed_counts(ingest.stream(spark, f"{tmp_path}/in", rows.schema), "t", "label", "v")
    query = live.writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert sorted(map(tuple, spark.table("w").collect())) == sorted(map(tuple, batch.collect()))
    ingest.append_batches(ingest.stream(spark, f"{tmp_path}/in", rows.schema), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 6


def test_plans(spark, tmp_path):
    frame = spark.range(1000).selectExpr("id", "id % 7 as g", "cast(id as string) as label", "cast(id as double) as x", "cast(id as double) as y")
    frame.write.parquet(f"{tmp_path}/t")
    rows = spark.read.parquet(f"{tmp_path}/t")
    top = sampling.reservoir(rows.select("g", "id", "x"), ["g"], 3, ["id"], 1)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "label" not in plan and "Python" not in plan
    asked = knn.impute(rows.where("id < 10"), rows.where("id >= 10"), ["x"], ["y"], ["id"], k=3)
    assert "Cartesian" not in asked._jdf.queryExecution().executedPlan().toString()


def test_entry_points_with_and_without_text_operators(tmp_path):
    for name in ("__spark_entry__.py", "sparkpanel", "jobs", "corpus_pipeline.py"):
        source = f"{ROOT}/{name}"
        if os.path.isdir(source):
            shutil.copytree(source, f"{tmp_path}/{name}")
        elif os.path.exists(source):
            shutil.copy(source, tmp_path)
    ask = "import json, __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); print(json.dumps([sorted(q), sorted(o)]))"
    run = lambda: json.loads(subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, check=True).stdout.splitlines()[-1])
    queries, oracles = run()
    assert set(oracles) <= set(queries) and "same_cell_recovery" in queries
    shutil.rmtree(f"{tmp_path}/sparkpanel/llm", ignore_errors=True)
    if os.path.exists(f"{tmp_path}/corpus_pipeline.py"):
        os.remove(f"{tmp_path}/corpus_pipeline.py")
    left, _ = run()
    assert set(left) == {q for q in queries if not q.startswith("op") and q != "pipeline"}
