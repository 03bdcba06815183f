"""Screens, saved models, probes, and runs, on small inputs with known answers."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import models, percentiles, persistence, quantiles, screen, splits
from sparkpanel.plans import probe, runs


def test_subset_skill_is_that_of_direct_fits(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1, 2, 5]
    y = x @ [1.0, -0.5, 0.0] + rng.normal(size=300) * 0.1
    frame = spark.createDataFrame([(*map(float, a), float(b), k) for k, (a, b) in enumerate(zip(x, y))], "a double, b double, c double, y double, k int")
    fit, test = frame.where("k < 200"), frame.where("k >= 200")
    got = {frozenset(r.subset.split("+")): r.r_squared for r in screen.subset_skill(fit, test, ["a", "b", "c"], ["y"], alpha=2.0).collect()}
    assert len(got) == 7
    for size in (1, 2, 3):
        for names in combinations("abc", size):
            out = models.fit_ridge(fit, list(names), ["y"], alpha=2.0).predict(test).select("y", "predicted_y").toPandas()
            want = 1 - ((out.y - out.predicted_y) ** 2).sum() / ((out.y - y[:200].mean()) ** 2).sum()
            assert got[frozenset(names)] == pytest.approx(want, abs=1e-6)
    share = screen.contributions(got, list("abc"))
    assert sum(share.values()) == pytest.approx(got[frozenset("abc")]) and share["b"] > share["c"]
    assert abs(screen.interactions({frozenset("a"): 1.0, frozenset("b"): 2.0, frozenset("ab"): 3.0}, "a", "b")) < 1e-12


def test_distances_and_fronts(spark):
    points = spark.createDataFrame([(1, 0, 0.0), (1, 0, 1.0), (1, 1, 1.0), (1, 1, 3.0)], "g int, side int, value double")
    a, b = np.array([0.0, 1.0]), np.array([1.0, 3.0])
    mean = lambda x, y: np.abs(x[:, None] - y[None]).mean()
    assert screen.energy_distance(points, ["g"]).first().energy == pytest.approx(2 * mean(a, b) - mean(a, a) - mean(b, b))
    assert screen.positive_fraction_error(points, ["g"]).first().error == pytest.approx(0.5)
    panels = spark.createDataFrame([(1, 1, 5), (2, 1, 6), (3, 2, 6), (4, 3, 9), (5, 3, 9), (6, 4, 8)], "p int, size int, skill int")
    assert sorted(r.p for r in screen.pareto_front(panels, "size", "skill").collect()) == [2, 4, 5]


def test_neighbourhoods(spark):
    rng = np.random.default_rng(1)
    rows = [(1, k, float(v), float(k % 2), "ab"[k % 2], k % 2) for k, v in enumerate(rng.normal(size=60))] + [(2, 0, 0.0, 0.0, "a", 0)]
    frame = spark.createDataFrame(rows, "g int, k int, x double, y double, label string, side int")
    same = {r.g: r for r in screen.neighbourhoods(frame, ["g"], "k", ["x"], ["x"], 5, "label").collect()}
    assert same[1].jaccard == 1.0 and same[2].n == 1
    split = {r.g: r for r in screen.neighbourhoods(frame, ["g"], "k", ["x"], ["y"], 5, "label").collect()}
    assert split[1].purity == 1.0 and split[1].jaccard < 1
    assert {r.g: r.same_side for r in screen.two_sample(frame, ["g"], "k", "side", ["y"]).collect()}[1] == 1.0


def test_saved_models_predict_alike(spark, tmp_path):
    rng = np.random.default_rng(2)
    frame = spark.createDataFrame([(float(a), float(b), float(a - b), "AB"[int(a > 0)], f"p{k % 5}") for k, (a, b) in enumerate(rng.normal(size=(120, 2)))], "a double, b double, y double, label string, patient string")
    ridge = models.fit_ridge(frame, ["a", "b"], ["y"], label="label")
    persistence.save_ridge(ridge, tmp_path / "ridge.json")
    assert persistence.load_ridge(tmp_path / "ridge.json").predict(frame).collect() == ridge.predict(frame).collect()
    net = models.fit_network(frame, ["a", "b"], ["y"], "patient", hidden=(4,), epochs=3)
    persistence.save_network(net, tmp_path / "net.npz")
    assert (persistence.load_network(tmp_path / "net.npz").predict(rng.normal(size=(5, 2)) * 0 + 1) == net.predict(np.ones((5, 2)))).all()
    kind = models.fit_classifier(frame, ["a", "b"], "label", ["A", "B"])
    persistence.save_classifier(kind, tmp_path / "kind")
    assert persistence.load_classifier(tmp_path / "kind").predict(frame).collect() == kind.predict(frame).collect()


def test_probe_summary_fails_closed(spark):
    rows = spark.createDataFrame([(f, r, f"p{f}", 0.5 + 0.1 * f + (r == "source_h_plus_x") * 0.2) for f in (0, 1) for r in ("source_h", "source_h_plus_x")], "fold int, representation string, patient_id string, macro_f1 double")
    got = {r.representation: r for r in probe.summarize(rows, "source_h", "macro_f1", 2, replicates=50).collect()}
    assert got["source_h_plus_x"].delta_mean == pytest.approx(0.2) and got["source_h"].delta_ci_upper == 0.0
    with pytest.raises(ValueError):
        probe.summarize(rows, "source_h", "macro_f1", 3)
    with pytest.raises(ValueError):
        probe.summarize(rows.withColumn("patient_id", F.lit("p")), "source_h", "macro_f1", 2)
    assert [r.representation for r in probe.in_order([rows.where("representation <> 'source_h'"), rows.where("representation = 'source_h'")]).select("representation").distinct().collect()]


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s in range(8):
        for k in range(60):
            a, b = rng.normal(size=2)
            rows.append((f"p{s % 4}", f"s{s}", "c", f"{s}-{k}", ["Blast", "T cell"][k % 2], float(a), float(b), float(2 * a + 0.5 * b), float(rng.normal())))
    return spark.createDataFrame(rows, "patient_id string, specimen_id string, modality string, cell_id string, cell_type string, CD3 double, CD4 double, SIGNAL double, NOISE double")


def test_same_cell_run_recovers_signal_only(cohort):
    spec = runs.SameCell(["CD3", "CD4"], ["SIGNAL", "NOISE"], n_splits=4, cells_per_specimen=60, bank=2_000, k=5)
    skill = {r.marker: r for r in runs.same_cell(cohort, spec).collect()}
    assert skill["SIGNAL"].skill_mean > 0.8 and skill["NOISE"].skill_mean < 0.2 and skill["SIGNAL"].n_patients == 4
    shuffled = runs.scored(*runs.predictions(runs.sampled(cohort, spec), spec, 0, shuffled=True), spec)
    assert shuffled.where("marker = 'SIGNAL'").agg(F.avg("skill")).first()[0] < 0.2


def test_sweep_keeps_targets_fixed(cohort):
    names = [n for n, *_ in runs.panels(["CD3"], ["CD3", "CD4", "X"], ["CD4", "X"], [("CD4", "X")], removals=True)]
    assert names == ["base", "add_CD4", "add_X", "add_CD4_X", "remove_CD4", "remove_X", "upper"]
    with pytest.raises(ValueError):
        runs.panels(["CD3"], ["CD4"], [])
    spec = runs.SameCell([], [], n_splits=2, cells_per_specimen=40, bank=500, k=5)
    got = runs.sweep(cohort, ["CD3", "CD4", "SIGNAL"], ["CD3"], ["CD3", "CD4"], ["CD4"], spec)
    mean = {r.panel: r.s for r in got.where("marker = 'SIGNAL'").groupBy("panel").agg(F.avg("skill").alias("s")).collect()}
    assert mean["add_CD4"] == pytest.approx(mean["upper"]) and mean["add_CD4"] > mean["base"]
    assert {r.marker for r in got.collect()} == {"SIGNAL"}


def test_cross_panel_run(spark, cohort):
    roles = splits.hashed_folds(cohort, 4, 1).where("fold = 0").select("specimen_id", "role")
    source = cohort.select("patient_id", "specimen_id", "cell_id", "cell_type", "CD3", "CD4")
    target = cohort.select("patient_id", "specimen_id", F.concat(F.lit("t"), "cell_id").alias("cell_id"), "cell_type", "CD3", "SIGNAL")
    found = runs.cross_panel(source, target, roles, runs.CrossPanel(["CD3"], ["CD4"], ["SIGNAL"], least=5, epochs=3))
    base, gated = (found[k].first() for k in ("baseline", "gated"))
    assert base.n_patients == 1 and 0 < gated.patient_first_w1 < 2 and found["gates"].count() == 1


def test_large_quantiles_are_exact(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BUCKETS", 8)
    rng = np.random.default_rng(9)
    data = {"a": rng.normal(size=3000) ** 3, "b": np.r_[np.full(500, 2.5), 1e9, -1e9], "c": np.array([7.0]), None: rng.integers(0, 4, 100) * 1.0}
    rows = [(k, float(v)) for k, vs in data.items() for v in vs] + [("a", None), ("a", float("nan"))]
    frame = spark.createDataFrame(rows, "g string, x double")
    grid = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    got = {r.g: r.quantiles for r in quantiles.large_quantiles(frame, ["g"], "x", grid).collect()}
    for k, vs in data.items():
        assert got[k] == pytest.approx(np.quantile(vs, grid), rel=1e-12, abs=1e-12)
    some = frame.where("g = 'a'").withColumnsRenamed({"g": "marker", "x": "value"})
    one, two = (percentiles.knots(some, ["marker"], n=33, large=large).first() for large in (False, True))
    assert one.knots == pytest.approx(two.knots) and one.probabilities == pytest.approx(two.probabilities)
    with pytest.raises(ValueError):
        monkeypatch.setattr(quantiles, "GROUPS", 2)
        quantiles.large_quantiles(frame, ["g"], "x", grid)
