"""Runs from configuration files, their documents and summaries, and manifest indices."""

import hashlib
import json

import numpy as np
import pytest
import yaml

from sparkpanel.__main__ import main
from sparkpanel.operators import manifests
from sparkpanel.operators.contract import ContractError
from sparkpanel.plans import configured, translation


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = np.random.default_rng(3)
    path = str(tmp_path_factory.mktemp("tables"))
    lines = []
    for k in range(1600):
        quantity, discount, tax = float(rng.integers(1, 50)), float(rng.integers(0, 10)) / 100, float(rng.integers(0, 8)) / 100
        lines.append((k, 1, k, k % 16, "OF"[k // 16 % 2], "ANR"[int(quantity) % 3], quantity, quantity * 900 + tax * 5000, discount, tax))
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_linestatus string, l_returnflag string, l_quantity double, l_extendedprice double, l_discount double, l_tax double").write.parquet(f"{path}/lineitem.parquet")
    spark.createDataFrame([(k, k // 2) for k in range(16)], "s_suppkey long, s_nationkey long").write.parquet(f"{path}/supplier.parquet")
    return path


def config(folder, tables, runner, options, name="one"):
    path = folder / f"{runner}.yaml"
    path.write_text(yaml.safe_dump({"experiment": {"name": name, "runner": runner}, "data": {"tables": tables}, "options": options, "output": {"root": str(folder / "out")}}))
    return path


SAME = {"observed": ["quantity", "discount", "tax"], "hidden": ["extendedprice"], "n_splits": 4, "bank": 300, "k": 5, "mlp": {"hidden": [8], "epochs": 3}}


def test_same_cell_grid_and_its_summary(spark, tables, tmp_path, capsys):
    path = config(tmp_path, tables, "same_cell", SAME)
    for fold in (0, 1):
        assert main(["run", str(path), "--fold", str(fold)]) == 0
    told = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert told["status"] == "ok" and told["hardware"]["spark"] and told["fold"] == 1
    found = configured.documents(spark, str(tmp_path / "out"), folds=2)
    rows = configured.results(found, "markers")
    assert {r[0] for r in rows.select("representation").distinct().collect()} == {"knn", "median", "mlp"}
    out = {r.representation: r for r in configured.summarize(spark, "same_cell", str(tmp_path / "out"), 2, 1, replicates=50)["markers"].where("modality = 'O'").collect()}
    assert out["knn"].skill_mean > 0.5 and abs(out["median"].skill_mean) < 1e-9 and out["knn"].n_patients == 4
    with pytest.raises(ValueError):
        configured.documents(spark, str(tmp_path / "out"), folds=4)
    with pytest.raises(ValueError):
        configured.summarize(spark, "nothing", str(tmp_path / "out"))
    assert configured.summarize(spark, "runs", str(tmp_path / "out"))["runs"].first().n_runs == 2


def test_biology_of_a_run_and_its_retention(spark, tables, tmp_path):
    configured.run(spark, config(tmp_path, tables, "same_cell", {**SAME, "methods": ["median", "knn"], "classes": ["A", "N", "R"]}, "bio"))
    found = configured.documents(spark, str(tmp_path / "out"))
    per = configured.results(found, "biology_per_class")
    assert {r["class"] for r in per.select("class").distinct().collect()} == {"A", "N", "R"}
    out = configured.summarize(spark, "same_cell", str(tmp_path / "out"), replicates=20)
    means = {(r.modality, r.representation): r for r in out["biology"].collect()}
    assert {k[1] for k in means} == {"full_true", "full_hybrid_knn", "full_hybrid_median"} and all(0 <= r.macro_f1_mean <= 1 for r in means.values())
    kept = {(r.modality, r.metric): r for r in out["retention"].where("probe = 'full'").collect()}
    one = kept["O", "macro_f1"]
    assert one.true_mean == pytest.approx(means["O", "full_true"].macro_f1_mean) and one.method_mean == pytest.approx(means["O", "full_hybrid_knn"].macro_f1_mean)


def test_sweep_literature_and_audit(spark, tables, tmp_path):
    configured.run(spark, config(tmp_path, tables, "addback_sweep", {"markers": ["quantity", "discount", "tax", "extendedprice"], "base": ["discount"], "upper": ["quantity", "discount", "tax"], "added": ["quantity"], "n_splits": 2, "bank": 200, "k": 5}, "sweep"))
    effects = configured.summarize(spark, "addback_sweep", str(tmp_path / "out/sweep"), replicates=20)["effects"]
    best = {r.panel: r.gap_rescue_fraction for r in effects.where("modality = 'O'").collect()}
    assert best["add_quantity"] > 0.5 and best["upper"] == pytest.approx(1.0)
    told = configured.run(spark, config(tmp_path, tables, "literature", {**SAME, "panel": "p"}, "som"))
    assert told["status"] == "ok"
    told = configured.run(spark, config(tmp_path, tables, "audit", {"low_events": 10}, "audit"))
    document = json.loads((tmp_path / "out/audit/fold_0/seed_4207/result.json").read_text())
    assert {r["modality"]: r["events"] for r in document["results"]["modalities"]} == {"O": 800, "F": 800} and len(document["results"]["bundle"][0]["digest"]) == 64
    assert (tmp_path / "out/audit/splits").exists() and told["git_commit"] is None


def test_audit_in_full(spark, tables, tmp_path):
    """Endpoints of two sources that disagree, banks, marker roles, the split manifest and what blocks a frozen protocol."""
    first, second = tmp_path / "first.csv", tmp_path / "second.csv"
    first.write_text("specimen_id,response,relapse\n" + "".join(f"s{k},{k // 2 % 2},{'' if k == 3 else 1}\n" for k in range(16)) + "s4,0,1\n")
    second.write_text("specimen_id,response\n" + "".join(f"s{k},{1 if k == 8 else k // 2 % 2}\n" for k in range(16)))
    options = {"source": "O", "target": "F", "channels": {"O": ["quantity", "tax", "Quantity"]}, "n_splits": 4, "bank_cap": 20, "seeds": [1, 2], "endpoints": {"sources": {"a": str(first), "b": str(second)}, "names": ["response", "relapse"], "least_total": 2}}
    configured.run(spark, config(tmp_path, tables, "audit", options, "full"))
    out = tmp_path / "out/audit"
    summary = json.loads((out / "audit_summary.json").read_text())
    assert {"specimens", "modalities", "labels", "splits", "violations", "markers", "banks", "endpoint_records", "endpoint_support", "endpoint_conflicts"} <= set(summary["tables"])
    assert summary["tables"]["endpoint_records"] == 32 and summary["tables"]["splits"] == 64 and summary["tables"]["violations"] == 0
    assert {"endpoint_conflicts", "marker_duplicates"} == set(summary["unresolved_blockers"])
    read = lambda name: spark.read.option("header", True).csv(str(out / name))
    conflicts = {(r.conflict, r.specimen_id) for r in read("endpoint_conflicts").collect()}
    assert ("sources_disagree", "s8") in conflicts and ("named_twice_by_a", "s4") in conflicts
    assert {r.fold for r in read("banks").select("fold").distinct().collect()} == {"0", "1", "2", "3"}
    assert {r.role for r in read("markers").collect()} >= {"H"}
    document = json.loads((tmp_path / "out/full/fold_0/seed_4207/result.json").read_text())
    assert len(document["results"]["bundle"][0]["digest"]) == 64 and document["results"]["bundle"][0]["files"] >= len(summary["tables"])
    assert len(json.loads((out / "split_manifest.json").read_text())["folds"]) == 4


CROSS = {"source": "O", "target": "F", "shared": ["quantity", "discount"], "source_only": ["tax"], "target_only": ["extendedprice"], "n_splits": 4, "least": 5, "epochs": 3, "classes": ["A", "N", "R"]}


def test_probe_of_ten_representations(spark, tables, tmp_path):
    path = config(tmp_path, tables, "cell_type_probe", {**CROSS, "paired_patients": 2}, "probe")
    configured.run(spark, path)
    rows = configured.results(configured.documents(spark, str(tmp_path / "out")), "overall")
    assert {r[0] for r in rows.select("representation").distinct().collect()} == set(translation.probe.PROBE_REPRESENTATIONS)
    source, target, roles, spec = configured._sides(spark, configured.load(path) | {"experiment": {"fold": 0, "seed": 1}})
    few, more = (translation.paired_specimens(source, target, roles, n, 1) for n in (1, 3))
    assert set(few) < set(more)
    point = translation.fit_point(source, target, roles, spec, 2)
    wide = translation.represented(source, point).limit(5).collect()
    gate = point.gates["extendedprice"]
    for r in wide:
        assert r["translated_y_h_plus_x_gate__extendedprice"] == pytest.approx((1 - gate) * r["translated_y_h_only__extendedprice"] + gate * r["translated_y_h_plus_x_ungated__extendedprice"])


def test_cross_panel_document(spark, tables, tmp_path):
    configured.run(spark, config(tmp_path, tables, "cross_panel", CROSS, "cross"))
    found = configured.documents(spark, str(tmp_path / "out"))
    assert configured.results(found, "gates").count() == 1 and configured.results(found, "gated").first().n_patients > 0


def test_paired_counts_and_their_summary(spark, tables, tmp_path):
    """Counts are numbers of paired specimens, and not the gate's values."""
    configured.run(spark, config(tmp_path, tables, "cross_panel", {**CROSS, "paired_counts": [0, 3], "k": 5, "alphas": [0.0, 1.0], "epochs": 2}, "curve"))
    found = configured.summarize(spark, "paired_curve", str(tmp_path / "out"), folds=1)
    curve = {r["count"]: r for r in found["curve"].collect()}
    assert set(curve) == {0, 3} and all(r.n_runs == 1 for r in curve.values())
    assert found["trend"].first().raw_slope == pytest.approx((curve[0].score_mean - curve[3].score_mean) / 3, abs=1e-9)
    assert all(r.nested for r in found["nested"].collect()) and found["first_below"].count() == 4
    configured.run(spark, config(tmp_path, tables, "cross_panel", {**CROSS, "paired_counts": [0], "k": 5}, "other"))
    with pytest.raises(ValueError, match="unlike paired counts"):
        configured.summarize(spark, "paired_curve", str(tmp_path / "out"))


def test_fit_save_and_predict_by_command(spark, tables, tmp_path, capsys):
    path = config(tmp_path, tables, "translation", CROSS, "fit")
    assert main(["run", str(path), "--fold", "1"]) == 0
    model = f"{tmp_path}/out/fit/fold_1/seed_4207/model"
    assert main(["predict", str(path), model, f"{tmp_path}/predicted"]) == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["rows"] == 800
    rows = spark.read.parquet(f"{tmp_path}/predicted")
    assert rows.count() == 800 and rows.where("predicted_extendedprice is null").count() == 0


def test_manifest_index(spark, tmp_path):
    header = manifests.COLUMNS["splits"]
    records = tmp_path / "records.csv"
    records.write_text(",".join(header) + "\n" + ",".join("x" for _ in header) + "\n")

    def index(**over):
        about = {"manifest": {"type": "splits", "protocol_id": "p1", "status": "frozen", "version": 1}, "records": {"path": "records.csv", "sha256": hashlib.sha256(records.read_bytes()).hexdigest()}}
        for key, value in over.items():
            about["records" if key in ("path", "sha256") else "manifest"][key] = value
        at = tmp_path / "index.yaml"
        at.write_text(yaml.safe_dump(about))
        return str(at), hashlib.sha256(at.read_bytes()).hexdigest()

    path, digest = index()
    assert manifests.load_index(spark, path, "splits", "p1", digest)["records"].count() == 1
    config = {"manifests": {"splits": "index.yaml", "data": "none.yaml"}, "manifest_digests": {"splits": digest, "data": "pending"}, "protocol": {"id": "p1"}}
    assert set(manifests.load_bundle(spark, config, str(tmp_path))) == {"splits"}
    for kind, protocol, sum_ in (("splits", "p2", digest), ("data", "p1", digest), ("splits", "p1", "0" * 64), ("other", "p1", digest)):
        with pytest.raises(ContractError):
            manifests.load_index(spark, path, kind, protocol, sum_)
    for over in ({"status": "draft"}, {"version": True}, {"version": 0}, {"type": "banks"}, {"path": "gone.csv"}, {"sha256": "0" * 64}):
        path, digest = index(**over)
        with pytest.raises(ContractError):
            manifests.load_index(spark, path, "splits", "p1", digest)


def test_index_of_files(spark, tmp_path):
    header = manifests.COLUMNS["stress"]
    content = tmp_path / "c.bin"
    content.write_bytes(b"abc")
    row = {"content_file": "c.bin", "content_sha256": hashlib.sha256(b"abc").hexdigest()}
    records = tmp_path / "r.csv"
    records.write_text(",".join(header) + "\n" + ",".join(row.get(c, "x") for c in header) + "\n")
    at = tmp_path / "i.yaml"
    at.write_text(yaml.safe_dump({"manifest": {"type": "stress", "protocol_id": "p", "status": "frozen", "version": 2}, "records": {"path": "r.csv", "sha256": hashlib.sha256(records.read_bytes()).hexdigest()}}))
    digest = hashlib.sha256(at.read_bytes()).hexdigest()
    assert manifests.load_index(spark, str(at), "stress", "p", digest)["records"].count() == 1
    content.write_bytes(b"other")
    with pytest.raises(ContractError):
        manifests.load_index(spark, str(at), "stress", "p", digest)


def test_markers_and_roots(tmp_path):
    configured.write_markers(["CD3", "CD4"], tmp_path / "m.txt")
    assert (tmp_path / "m.txt").read_text() == "CD3\nCD4\n"
    (tmp_path / "a/b").mkdir(parents=True)
    (tmp_path / "a/pyproject.toml").write_text("")
    assert configured.repository_root(tmp_path / "a/b/x.yaml") == (tmp_path / "a").resolve()
    assert configured.absolute({"data": {"tables": "t"}, "output": {"root": "/o"}}, tmp_path / "a/b/x.yaml") == {"data": {"tables": str((tmp_path / "a").resolve() / "t")}, "output": {"root": "/o"}}
    assert configured.git_commit(tmp_path) is None
