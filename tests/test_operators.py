"""Operators on small inputs with known answers."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.functions import names, scales
from sparkpanel.operators import audit, bootstrap, distance, knn, metrics, models, percentiles, ranks, sampling, som, splits, summaries, transport


def rows_of(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=repr)


# ---- names ----------------------------------------------------------------------------------------------------
def test_names(spark):
    frame = spark.createDataFrame([("r12_1", " pd1 "), ("R31x_1", "CD 197"), ("R7", "HLA-DR"), ("sample_visit2", "fsc-a")], "s string, m string")
    got = rows_of(frame.select(names.patient_of(F.col("s")).alias("p"), names.canonical(F.col("m")).alias("m"), names.is_technical(F.col("m")).alias("t")), "p", "m", "t")
    assert got == sorted([("R12", "PD-1", False), ("R31x", "CCR7", False), ("R7", "HLA-DR", False), ("sample", "FSC-A", True)], key=repr)
    for s, p in (("r12_1", "R12"), ("R31x_1", "R31x"), ("sample_visit2", "sample")):
        assert names.patient_id(s) == p
    assert names.label_column(["x", "event_type", "label"]) == "label" and names.label_column(["only"]) == "only"
    with pytest.raises(ValueError):
        names.label_column(["a", "b"])
    kinds = spark.createDataFrame([("full_hybrid_knn",), ("hidden_mlp",), ("observed_true",)], "r string")
    assert rows_of(kinds.select("r", names.method_of(F.col("r")).alias("m")), "m") == sorted([("knn",), ("mlp",), (None,)], key=repr)


def test_panels():
    assert names.panel(["CD3", "CD279", "CD4", "X"], ["PD1", "cd3"]) == (["CD279", "CD3"], ["CD4", "X"])
    for full, seen in ((["PD1", "CD279"], ["PD1"]), (["CD3"], ["CD3"]), (["CD3", "X"], ["CD4"]), (["CD3", "X"], ["CD3", "cd3"])):
        with pytest.raises(ValueError):
            names.panel(full, seen)


# ---- scales and percentiles ------------------------------------------------------------------------------------
def test_scale_rules(spark):
    frame = spark.createDataFrame([("a", float(x)) for x in (0, 0, 0, 0, 8)] + [("b", 5.0)] * 4 + [("c", float(x)) for x in range(9)], "marker string, value double")
    iqr = dict(rows_of(scales.iqr_scale(frame, ["marker"]), "marker", "scale"))
    assert iqr == pytest.approx({"a": 0.32, "b": 1e-3, "c": 4.0})
    robust = {m: (l, s) for m, l, s in rows_of(scales.robust_scale(frame, ["marker"]), "marker", "location", "scale")}
    assert robust == {"a": (0.0, 1.0), "b": (5.0, 1.0), "c": (4.0, 4.0)}


def test_percentiles_round_trip(spark):
    x = np.linspace(-2, 2, 101)
    frame = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 7.5)] * 20, "marker string, value double")
    table = percentiles.knots(frame, ["marker"])
    there = percentiles.transform(frame, table)
    assert {v for m, v in rows_of(there, "marker", "value") if m == "b"} == {0.5}
    back = np.array([v for m, v in rows_of(percentiles.inverse(there, table), "marker", "value") if m == "a"])
    assert np.abs(np.sort(back) - x).max() < 1e-5
    outside = spark.createDataFrame([("a", -99.0), ("a", 99.0)], "marker string, value double")
    assert rows_of(percentiles.transform(outside, table), "value") == [(0.0,), (1.0,)]
    other = percentiles.knots(frame.where("marker = 'a'").withColumn("value", F.col("value") * 5 + 20), ["marker"])
    moved = percentiles.translate(outside, table, other)
    assert rows_of(moved, "value") == [(10.0,), (30.0,)]


# ---- ranks -----------------------------------------------------------------------------------------------------
def test_rank_statistics(spark):
    rng = np.random.default_rng(0)
    s, y = rng.integers(0, 6, 60), rng.integers(0, 2, 60)
    frame = spark.createDataFrame([(1, float(a), int(b), k) for k, (a, b) in enumerate(zip(s, y))], "g int, s double, y int, k int")
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(a > b) + 0.5 * (a == b) for a in pos for b in neg])
    assert ranks.auc(frame, ["g"], "s", "y").first().auc == pytest.approx(auc)
    ap, last = 0.0, 0.0
    for t in sorted(set(s), reverse=True):
        recall = (y[s >= t] == 1).sum() / (y == 1).sum()
        ap += (recall - last) * (y[s >= t] == 1).mean()
        last = recall
    assert ranks.average_precision(frame, ["g"], "s", "y").first().auprc == pytest.approx(ap)
    for column in ("auc", "auprc"):
        only = frame.withColumn("y", F.lit(0))
        assert (ranks.auc if column == "auc" else ranks.average_precision)(only, ["g"], "s", "y").first()[column] is None
    assert ranks.spearman(frame.withColumn("c", F.lit(1.0)), ["g"], "s", "c").first().spearman is None
    sizes = [r.n for r in ranks.quintiles(frame.limit(13), ["g"], "s", ["y"], ["k"]).orderBy("quintile").collect()]
    assert sizes == [3, 3, 3, 2, 2]
    grid = spark.createDataFrame([(1, 0.0, 2.0), (1, 0.5, 1.0), (1, 1.0, 1.0)], "g int, alpha double, error double")
    assert ranks.least_on_grid(grid, ["g"], "alpha", "error").first().alpha == 0.5


# ---- distances -------------------------------------------------------------------------------------------------
def numpy_w1(a, b, wa=None, wb=None):
    wa, wb = (np.full(len(x), 1 / len(x)) if w is None else np.asarray(w) / np.sum(w) for x, w in ((a, wa), (b, wb)))
    at = np.sort(np.r_[a, b])
    f, g = (np.array([w[x <= t].sum() for t in at]) for x, w in ((np.asarray(a), wa), (np.asarray(b), wb)))
    return float((np.abs(f - g)[:-1] * np.diff(at)).sum())


def test_wasserstein(spark):
    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 9, 40), rng.integers(2, 12, 25), rng.uniform(0.1, 1, 65)
    data = [(0, float(v), float(x)) for v, x in zip(a, w)] + [(1, float(v), float(x)) for v, x in zip(b, w[40:])]
    frame = spark.createDataFrame([(1, *d) for d in data] + [(2, 0, 1.0, 1.0)], "g int, side int, value double, weight double")
    got = dict(rows_of(distance.wasserstein(frame, ["g"]), "g", "distance"))
    assert got[1] == pytest.approx(numpy_w1(a, b)) and got[2] is None
    got = dict(rows_of(distance.wasserstein(frame, ["g"], weight="weight"), "g", "distance"))
    assert got[1] == pytest.approx(numpy_w1(a, b, w[:40], w[40:]))


def cohort(spark, shift=0.0, sizes=(40, 10, 20)):
    rng = np.random.default_rng(3)
    data = []
    for k, n in enumerate(sizes):
        for i in range(n):
            v = float(rng.normal() + 5 * k)
            data += [(f"p{k // 2}", f"s{k}", "T", "m", v, 0), (f"p{k // 2}", f"s{k}", "T", "m", v + shift, 1)]
    return spark.createDataFrame(data, "patient_id string, specimen_id string, cell_type string, marker string, value double, side int")


def test_population_metrics(spark):
    unit = spark.createDataFrame([("m", 1.0)], "marker string, scale double")
    same = distance.population_metrics(cohort(spark), unit).first()
    assert same.patient_first_w1 == 0 and same.n_patients == 2 and same.n_specimens == 3
    moved = distance.population_metrics(cohort(spark, 2.0), unit).first()
    assert moved.patient_first_w1 == pytest.approx(2.0) and moved.patient_first_median_error == pytest.approx(2.0)
    assert distance.strata(cohort(spark, sizes=(4, 10)), unit).count() == 1  # four cells are too few


def test_patient_gain_weighs_specimens_alike(spark):
    big = [("p0", "s0", "m", 0.0)] * 1000 + [("p0", "s1", "m", 10.0)] + [("p1", "s2", "m", 50.0)] * 3
    frame = spark.createDataFrame(big, "patient_id string, specimen_id string, marker string, value double")
    weights = distance.mixture_weights(frame).groupBy("specimen_id").agg(F.sum("weight").alias("w"))
    assert dict(rows_of(weights, "specimen_id", "w")) == pytest.approx({"s0": 0.5, "s1": 0.5, "s2": 1.0})
    maps = spark.createDataFrame([(0, "p0", "p1"), (0, "p1", "p0")], "derangement int, patient_id string, wrong_patient string")
    unit = spark.createDataFrame([("m", 1.0)], "marker string, scale double")
    gain = {r.patient_id: r for r in distance.patient_gain(frame, frame, maps, unit).collect()}
    assert gain["p0"].matched_error == 0 and gain["p0"].gain == pytest.approx(45.0)
    assert distance.unmatched(frame, frame.where("specimen_id <> 's2'")).collect()[0].missing_from == "target"


def test_sliced_wasserstein(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(100, 3))
    data = [(0, *map(float, v)) for v in x] + [(1, *map(float, v)) for v in x]
    frame = spark.createDataFrame([(1, *d) for d in data], "g int, side int, a double, b double, c double")
    directions = distance.projections(3, 5, 1)
    one = dict.fromkeys("abc", 1.0)
    assert np.linalg.norm(directions, axis=1) == pytest.approx(np.ones(5))
    assert distance.sliced_wasserstein(frame, ["g"], "side", list("abc"), directions, one).first().sliced_w1 == pytest.approx(0.0)
    moved = frame.withColumn("a", F.col("a") + F.col("side") * 2)
    want = np.mean([abs(2 * d[0]) for d in directions])
    assert distance.sliced_wasserstein(moved, ["g"], "side", list("abc"), directions, one).first().sliced_w1 == pytest.approx(want)


# ---- metrics ---------------------------------------------------------------------------------------------------
def test_label_metric_variants(spark):
    pairs = [("A", "A"), ("A", "B"), ("B", "B"), ("B", "B"), ("A", "D")]
    frame = spark.createDataFrame([(1, *p) for p in pairs], "g int, label string, predicted string")
    per, overall = metrics.label_metrics(frame, ["g"], ["A", "B", "C", "D"])
    classes = {r["class"]: r for r in per.collect()}
    assert classes["A"].recall == pytest.approx(1 / 3) and classes["A"].precision == 1.0
    assert classes["C"].recall is None and classes["C"].precision is None and classes["D"].precision == 0.0 and classes["D"].recall is None
    f1 = {"A": 0.5, "B": 0.8}
    assert overall.first().macro_f1 == pytest.approx(np.mean(list(f1.values()))) and overall.first().accuracy == pytest.approx(0.6)
    per, overall = metrics.label_metrics(frame, ["g"], ["A", "B", "C", "D"], variant="probe")
    assert overall.first().macro_f1 == pytest.approx(sum(f1.values()) / 4)
    assert {r["class"]: r.precision for r in per.collect()}["D"] is None


def test_marker_metrics(spark):
    rows = [("m", float(k), float(k), 4.5) for k in range(10)] + [("flat", 1.0, 2.0, 1.0)] * 5
    frame = spark.createDataFrame(rows, "marker string, truth double, prediction double, null_prediction double")
    table = spark.createDataFrame([("m", 2.0), ("flat", 1.0)], "marker string, scale double")
    got = {r.marker: r for r in metrics.marker_metrics(frame, ["marker"], table).collect()}
    assert got["m"].skill == 1.0 and got["m"].spearman == pytest.approx(1.0) and got["m"].range_retention == 1.0
    assert got["flat"].skill is None and got["flat"].spearman is None and got["flat"].range_retention is None and got["flat"].normalized_mae == 1.0


def test_uncertainty_of_one_unit(spark):
    data = [("s", "T", "m", 0, 0.0, 1.0, None)] * 10 + [("s", "T", "m", 1, None, None, 1.0)] * 10
    frame = spark.createDataFrame(data, "specimen_id string, cell_type string, marker string, side int, baseline double, residual double, value double")
    unit = spark.createDataFrame([("m", 1.0)], "marker string, scale double")
    groups = ["specimen_id", "cell_type", "marker"]
    units = metrics.uncertainty_units(metrics.residual_curve(frame, groups, unit, [0.0, 1.0]), groups, 1.0)
    row = units.first()
    assert (row.baseline_error, row.oracle_gain, row.selected_gain, row.oracle_alpha) == (1.0, 1.0, 1.0, 1.0)
    summary = metrics.uncertainty_summary(units.withColumn("support", F.lit(0.3)), ["support"], groups)
    assert summary["overall"].first().n == 1 and summary["correlations"].first().baseline_error is None and summary["quintiles"].count() == 1


# ---- sampling and splits ---------------------------------------------------------------------------------------
def cell_rows(spark):
    return spark.createDataFrame([(f"p{k % 4}", f"s{k % 8}", k, "AB"[k % 2], float(k)) for k in range(400)], "patient_id string, specimen_id string, row_idx long, cell_type string, x double")


def test_samples_do_not_depend_on_partitions(spark):
    rows = cell_rows(spark)
    take = lambda f: {r.row_idx for r in sampling.reservoir(f, ["specimen_id"], 7, ["row_idx"], 1).collect()}
    first = take(rows)
    assert len(first) == 56 and first == take(rows.repartition(13)) and first != take(rows.limit(0).unionByName(rows.where("row_idx < 300")))
    assert sampling.sample(rows, 10, ["row_idx"], 1).count() == 10


def test_bank_quotas(spark):
    rows = cell_rows(spark).where("patient_id <> 'p3' or row_idx < 12")
    bank = sampling.balanced_bank(rows, "patient_id", 40, ["row_idx"], 3)
    counts = dict(rows_of(bank.groupBy("patient_id").count(), "patient_id", "count"))
    assert counts["p3"] == 3 and all(counts[p] == 10 for p in ("p0", "p1", "p2"))  # no top-up
    assert sampling.balanced_bank(rows, "patient_id", 10_000, ["row_idx"], 3).count() == rows.count()
    per = sampling.class_balanced(rows, "cell_type", "patient_id", 9, ["row_idx"], 3).groupBy("cell_type").count()
    assert all(n <= 9 for _, n in rows_of(per, "cell_type", "count"))
    probe = sampling.probe_rows(rows, "specimen_id", "cell_type", 5, 12, ["row_idx"], 3).groupBy("cell_type").count()
    assert rows_of(probe, "count") == [(12,), (12,)]


def test_shuffles_keep_margins(spark):
    rows = cell_rows(spark)
    shuffled = sampling.shuffled_within(rows, ["specimen_id"], ["x"], ["row_idx"], 5)
    assert rows_of(shuffled, "specimen_id", "x") == rows_of(rows, "specimen_id", "x")
    assert rows_of(shuffled, "row_idx", "x") != rows_of(rows, "row_idx", "x")


def test_prior_draws_balance_patients_and_visits(spark):
    bank = spark.createDataFrame([("a", "a1", k, 0.0) for k in range(900)] + [("b", "b1", 0, 1.0), ("b", "b2", 1, 1.0)], "patient_id string, specimen_id string, row_idx long, x double")
    asked = spark.range(4000).select(F.col("id").alias("q"))
    drawn = sampling.prior_draw(bank, asked, ["q"], 1, ["row_idx"])
    assert drawn.count() == 4000
    assert 0.45 < drawn.agg(F.avg("x")).first()[0] < 0.55
    share = drawn.where("x = 1").agg(F.avg((F.col("specimen_id") == "b1").cast("double"))).first()[0]
    assert 0.45 < share < 0.55


def test_derangements_and_pairings(spark):
    ids = [f"p{k}" for k in range(9)]
    one = sampling.derangement(ids, 5)
    assert sorted(one) == sorted(one.values()) == sorted(ids) and all(a != b for a, b in one.items())
    assert sampling.derangements_digest([one]) == sampling.derangements_digest([dict(reversed(one.items()))])
    with pytest.raises(ValueError):
        sampling.derangement(["a"], 1)
    frame = spark.createDataFrame([(i,) for i in ids], "patient_id string")
    maps = sampling.derangement_by_hash(frame, 1, 2).withColumn("derangement", F.lit(0))
    assert distance.derangement_violations(maps, frame).count() == 0
    patient = {f"{p}_{v}": p for p in ids for v in "ab"}
    target = sampling.paired_targets(sorted(patient), patient, "shuffled", 3)
    assert sorted(target) == sorted(patient) and all(patient[a] != patient[b] for a, b in zip(sorted(patient), target))
    small, large = (set(sampling.nested_subset(ids, n, 7)) for n in (3, 6))
    assert small < large
    for bad in (0, 10, True, "some"):
        with pytest.raises(ValueError):
            sampling.patient_prefix(ids, {}, bad, 1)
    assert spark.range(1).select(sampling.stable_seed_column(F.lit("a"), F.lit("b")).alias("s")).first().s == sampling.stable_seed("a", "b")


def test_folds_never_split_patients(spark):
    specimens = {f"R{k:04d}_{v}": f"R{k:04d}" for k in range(11) for v in ("A", "B")[: 1 + k % 2]}
    rows = splits.grouped_folds(specimens, 5, 4207, 0.2)
    table = splits.split_table(spark, rows)
    assert splits.violations(table, 5).count() == 0 and splits.grouped_folds(specimens, 5, 4207, 0.2) == rows
    leak = table.unionByName(table.where("role = 'test'").limit(1).withColumn("role", F.lit("train")))
    assert "patient_in_two_roles" in {r.rule for r in splits.violations(leak, 5).collect()}
    pairs = spark.createDataFrame([(p, s) for s, p in specimens.items()], "patient_id string, specimen_id string")
    assert splits.violations(splits.hashed_folds(pairs, 5, 1), 5).count() == 0
    train, held = splits.inner_partition(["a", "b"], 0.01, 1)
    assert len(train) == len(held) == 1


# ---- neighbours and models -------------------------------------------------------------------------------------
def test_knn_by_hand(spark, monkeypatch):
    bank = spark.createDataFrame([(k, x, y, "b" if x == 10 else "t") for k, (x, y) in enumerate([(0.0, 0.0), (1.0, 2.0), (2.0, 4.0), (10.0, 100.0)])], "k int, x double, y double, label string")
    asked = spark.createDataFrame([(1.1, "t"), (9.0, "zz")], "x double, label string")
    for most in (100_000, 3):
        monkeypatch.setattr(knn, "MOST", most)
        assert rows_of(knn.impute(asked, bank, ["x"], ["y"], ["k"], k=3), "predicted_y") == [(2.0,), (4.0,)]
    monkeypatch.setattr(knn, "MOST", 100_000)
    even = {rule: knn.impute(asked.limit(1), bank, ["x"], ["y"], ["k"], k=2, rule=rule).first().predicted_y for rule in ("lower", "mean")}
    assert even == {"lower": 2.0, "mean": 3.0}
    by_label = knn.impute(asked, bank, ["x"], ["y"], ["k"], k=50, label="label", rule="mean")
    assert rows_of(by_label, "x", "predicted_y", "effective_k", "used_fallback") == [(1.1, 2.0, 3, False), (9.0, 3.0, 4, True)]


def test_ridge_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 2)) * [1, 3]
    y = x @ [[2.0, -1.0], [0.5, 3.0]] + [1.0, 2.0] + rng.normal(size=(200, 2))
    frame = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y)], "a double, b double, u double, v double")
    model = models.fit_ridge(frame, ["a", "b"], ["u", "v"], alpha=5.0)
    z = (x - x.mean(0)) / x.std(0)
    w = np.linalg.solve(z.T @ z + 5 * np.eye(2), z.T @ (y - y.mean(0)))
    got = np.array([(r.predicted_u, r.predicted_v) for r in model.predict(frame).collect()])
    assert np.abs(got - (z @ w + y.mean(0))).max() < 1e-8


def test_ridge_with_labels(spark):
    rng = np.random.default_rng(1)
    data = [(float(h), "Blast" if k % 2 else "T cell", float(h * (2 if k % 2 else -2) + (10 if k % 2 else 0))) for k, h in enumerate(rng.normal(size=400))]
    frame = spark.createDataFrame(data, "h double, label string, y double")
    error = {}
    for label in (None, "label"):
        out = models.fit_ridge(frame, ["h"], ["y"], alpha=1e-3, label=label).predict(frame)
        error[label] = out.agg(F.avg(F.abs(F.col("predicted_y") - F.col("y")))).first()[0]
    assert error["label"] < 0.02 * error[None]
    with pytest.raises(Exception, match="unseen label"):
        models.fit_ridge(frame, ["h"], ["y"], label="label").predict(frame.withColumn("label", F.lit("new"))).collect()


def test_classifier_and_replay(spark):
    rng = np.random.default_rng(2)
    data = [(k, *(float(v) for v in rng.normal(size=2) + [4 * (k % 3), 0]), "ABC"[k % 3]) for k in range(300)]
    frame = spark.createDataFrame(data, "k int, x double, y double, label string").where("label <> 'C' or k < 60").withColumn("null_x", F.lit(0.0))
    model = models.fit_classifier(frame, ["x", "y"], "label", ["A", "B", "C", "D"])
    out = models.replay(model, frame, {"true": {}, "blind": {"x": "null_x"}}, "label", ["k"])
    good = dict(rows_of(out.groupBy("representation").agg(F.avg((F.col("label") == F.col("predicted")).cast("double")).alias("a")), "representation", "a"))
    assert good["true"] > 0.9 > good["blind"]
    assert all(r.probabilities[3] == 0.0 and abs(sum(r.probabilities) - 1) < 1e-9 for r in out.limit(20).collect())


def test_network_learns_and_is_deterministic(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 2))
    y = np.c_[np.abs(x[:, 0]), x[:, 1]]
    fit = lambda: models.Network(hidden=(24,), epochs=60, batch=64, rate=5e-3, seed=1).fit(x, y, np.arange(600) % 10).predict(x)
    out = fit()
    assert np.abs(out - y).mean() < 0.15 and (fit() == out).all()


def test_transport(spark):
    points = np.array([[0.0], [3.0], [7.0]])
    plan = transport.sinkhorn(transport.cost_matrix(points, points), 0.05, 500)
    assert np.trace(plan) > 0.99 and transport.barycentric(plan, points) == pytest.approx(points, abs=0.1)
    wide = transport.sinkhorn(transport.cost_matrix(points[:2], points), 1.0, 500)
    assert wide.sum(1) == pytest.approx([0.5, 0.5], abs=1e-5) and wide.sum(0) == pytest.approx([1 / 3] * 3, abs=1e-5)
    assert 0 <= transport.diagnostics(wide)["normalized_entropy_mean"] <= 1
    for bad in (lambda: transport.sinkhorn(np.array([[-1.0]]), 1), lambda: transport.sinkhorn(np.ones((2, 2)), 0)):
        with pytest.raises(ValueError):
            bad()
    rows = spark.createDataFrame([("s", k, float(k), float(k) * 10) for k in range(12)] + [("few", k, 0.0, 0.0) for k in range(3)], "specimen_id string, cell_id int, h double, y double")
    out = transport.teacher(rows, rows, ["specimen_id"], ["cell_id"], ["h"], ["y"], most=10, least=5)
    assert out.count() == 10 and {r.specimen_id for r in out.collect()} == {"s"}
    assert transport.mutual_nearest(rows, rows, ["specimen_id"], ["cell_id"], ["h"]).where("cell_id = target_cell_id").count() >= 12


def test_som_draws_stay_in_range(spark):
    rng = np.random.default_rng(4)
    ref = spark.createDataFrame([(k, float(h), float(h > 0) + 5) for k, h in enumerate(rng.normal(size=2000))], "k int, h double, y double")
    asked = spark.createDataFrame([(k, float(h)) for k, h in enumerate(rng.normal(size=200))], "k int, h double")
    out = som.draw(asked, ref, ["h"], ["y"], ["k"], rows=3, columns=3)
    got = out.collect()
    assert all(5 <= r.predicted_y <= 6 for r in got) and sum(not r.abstained for r in got) > 150
    assert rows_of(out, "k", "predicted_y") == rows_of(som.draw(asked, ref, ["h"], ["y"], ["k"], rows=3, columns=3), "k", "predicted_y")


# ---- summaries -------------------------------------------------------------------------------------------------
def test_bootstrap(spark):
    low, high = bootstrap.interval(np.arange(100.0), 2000, 1)
    assert 43 < low < 45 and 54 < high < 56
    assert all(np.isnan(bootstrap.interval(np.array([np.nan]), 10, 1)))
    rows = spark.createDataFrame([(None, f"p{k}", float(k)) for k in range(10)] + [("g", "p0", float("nan"))], "g string, patient string, m double")
    got = {r.g: r for r in bootstrap.summarize(rows, ["g"], ["m"]).collect()}
    assert got[None].m_mean == 4.5 and got[None].m_ci_lower < 4.5 < got[None].m_ci_upper and got["g"].m_mean is None and got["g"].m_ci_lower is None


def test_paired_effects(spark):
    rows = [("c", p, k, a, f"p{i}", v + i) for i in range(6) for p, k, a, v in (("base", "base", None, 0.0), ("add_X", "add", "X", 1.0), ("upper", "upper", None, 2.0))]
    frame = spark.createDataFrame(rows, "modality string, panel string, panel_kind string, added_marker string, patient string, skill double")
    got = {r.panel: r for r in summaries.paired_effects(frame, [], ["skill"], "base", "upper").collect()}
    assert set(got) == {"add_X", "upper"}
    assert got["add_X"].delta_mean == 1.0 and got["add_X"].gap_rescue_fraction == 0.5 and got["add_X"].delta_ci_lower == 1.0
    flat = summaries.paired_effects(frame.withColumn("skill", F.lit(1.0)), [], ["skill"], "base", "upper", replicates=None)
    assert {r.gap_rescue_fraction for r in flat.collect()} == {None}


def test_curves(spark):
    frame = spark.createDataFrame([(c, 1.0 - 0.1 * c) for c in (0, 1, 2, 4)], "count int, score double")
    got = summaries.curve_trend(frame, []).first()
    assert got.raw_slope == pytest.approx(0.1) and got.raw_r_squared == pytest.approx(1.0) and got.steps == 3 and got.falling == 3
    base = spark.createDataFrame([("a", 0.95), ("b", 0.1)], "baseline string, value double")
    assert rows_of(summaries.first_below(frame, base), "baseline", "first_count") == [("a", 1), ("b", None)]
    assert summaries.curve_trend(frame.withColumn("score", F.lit(3.0)), []).first().raw_r_squared == 1.0


def test_run_documents_flatten(spark):
    import json

    per = {"support": 3, "predicted_support": 2, "recall": 0.5, "precision": 1.0, "auprc": None, "observed_prevalence": 0.3, "predicted_prevalence": 0.2, "prevalence_error": -0.1}
    m = {"accuracy": 0.9, "balanced_accuracy": 0.8, "macro_f1": 0.7, "macro_auprc": None, "per_class": {"T": per}}
    doc = {"modality": "c", "panel": "p", "fold": 0, "seed": 1, "status": "ok", "specimens": {"s": {"patient": "p1", "n_cells": 10, "metrics": {"full_true": m}}}}
    runs = spark.createDataFrame([(json.dumps(doc),), (json.dumps({**doc, "status": "failed"}),)], "j string").select(F.from_json("j", summaries.RUN_SCHEMA).alias("r")).select("r.*")
    overall, classes = summaries.flatten_biology(summaries.completed(runs))
    assert overall.first().macro_f1 == 0.7 and classes.first().label == "T" and classes.first().support == 3


# ---- audits ----------------------------------------------------------------------------------------------------
def test_endpoints(spark):
    notes = spark.createDataFrame([("a", "s1", "E", "Mutant"), ("b", "s1", "E", "Mutant"), ("a", "s2", "E", "Wildtype"), ("b", "s2", "E", " "), ("a", "s3", "E", "Mutant"), ("a", "s4", "E", "x"), ("b", "s4", "E", "y")], "source string, specimen_id string, endpoint string, value string")
    people = spark.createDataFrame([("s1", "p1"), ("s2", "p1"), ("s3", "p2"), ("s4", "p3"), ("s5", "p4")], "specimen_id string, patient_id string")
    reconciled = audit.reconcile(notes, people, ["E"])
    assert dict(rows_of(reconciled, "specimen_id", "value")) == {"s1": "Mutant", "s2": "Wildtype", "s3": "unknown", "s4": "conflict", "s5": "unknown"}
    status = audit.patient_status(reconciled)
    assert dict(rows_of(status, "patient_id", "status")) == {"p1": "conflict", "p2": "unknown", "p3": "conflict", "p4": "unknown"}
    reasons = dict(rows_of(audit.endpoint_records(reconciled, status), "specimen_id", "reason"))
    assert reasons["s3"] == "single_source_annotation_unverified" and reasons["s5"] == "missing_annotation" and reasons["s1"].startswith("longitudinal")


def test_bank_weights_sum_to_one(spark):
    members = spark.createDataFrame([("b", "p1", "s1", 10), ("b", "p1", "s2", 40), ("b", "p2", "s3", 5)], "bank string, patient_id string, specimen_id string, event_count int")
    got = audit.bank_weights(members, ["bank"])
    assert got.agg(F.sum(F.col("event_weight") * F.col("event_count"))).first()[0] == pytest.approx(1.0)


def test_marker_roles(spark):
    rows = [("a", "CD3", 0), ("a", "PD-1", 1), ("a", "FSC-A", 2), ("a", "X", 3), ("b", "Y", 0), ("b", "CD279", 1), ("b", "CD3", 2)]
    frame = spark.createDataFrame(rows, "modality string, original_channel string, ordinal int")
    got = {(r.direction, r.modality, r.canonical_marker): (r.role, r.ordinal) for r in audit.marker_roles(frame, "a", "b").collect()}
    assert got[("a_to_b", "b", "PD-1")] == ("H", 1) and got[("b_to_a", "a", "PD-1")] == ("H", 0)
    assert got[("a_to_b", "a", "X")] == ("source_only", 0) and got[("b_to_a", "a", "X")] == ("Y", 0) and got[("a_to_b", "a", "FSC-A")][0] == "technical"
    assert audit.duplicate_markers(frame.unionByName(spark.createDataFrame([("b", "PD1", 9)], frame.schema))).first().canonical_marker == "PD-1"


@pytest.mark.parametrize("rule", ["lower", "mean"])
def test_label_conditioned_neighbours_do_not_depend_on_the_size_of_the_bank(spark, monkeypatch, rule):
    rng = np.random.default_rng(3)
    rows = [(k, int(rng.integers(0, 4)) if k % 19 else None, float(rng.integers(0, 9)), float(rng.normal())) for k in range(300)]
    frame = spark.createDataFrame(rows, "k long, label int, x double, y double")
    bank = frame.where("k % 3 > 0 AND (label is null or label <> 2)")
    asked = frame.where("k % 3 = 0").unionByName(frame.where("k = 0"))  # labels 2 and null fall back; one row comes twice
    got = []
    for most in (100_000, 60):
        monkeypatch.setattr(knn, "MOST", most)
        out = knn.impute(asked, bank, ["x"], ["y"], ["k"], k=6, rule=rule, label="label").collect()
        got.append(sorted((r.k, round(r.predicted_y, 9), round(r.mad_y, 9), round(r.mean_distance, 9), r.effective_k, r.used_fallback) for r in out))
    assert got[0] == got[1] and len(got[0]) == 101 and {r[5] for r in got[0]} == {True, False}


def test_runs_score_every_test_cell(spark):
    """The bank alone is sampled: a cap of cells per specimen, which once cut the table first, changes nothing."""
    from sparkpanel.plans import model_queries, runs
    from sparkpanel.sources.cells import cells

    rows = cells(spark, "/root/testdata/sf0.001")
    got = []
    for cap in (2, 10**6):
        spec = runs.SameCell(["quantity", "discount"], ["extendedprice"], n_splits=2, cells_per_specimen=cap, bank=200, k=5)
        scores = runs.same_cell(rows, spec).collect()  # means of doubles: the last digit follows the order of the shuffle
        got.append(sorted((r.modality, r.marker, r.n_patients, *(round(x, 12) for x in r[3:])) for r in scores))
    assert got[0] == got[1]
    folds = {r.fold for r in model_queries.shuffled_recovery_control(spark, "/root/testdata/sf0.001").select("fold").distinct().collect()}
    assert len(folds) == model_queries.SPEC.n_splits


def test_a_sampled_bank_goes_to_the_queries(spark):
    """Queries of a small bank are answered without a shuffle, null and fallback rows too."""
    asked = spark.createDataFrame([(1, "a", 0.1), (2, "b", 0.1), (3, None, 2.0), (4, "a", 0.1)], "q int, label string, x double")
    bank = spark.createDataFrame([(k, "a" if k < 4 else "c", float(k), 10.0 * k) for k in range(8)], "k int, label string, x double, y double")
    out = knn.impute(asked, bank, ["x"], ["y"], ["k"], k=2, label="label")
    assert "CoGroup" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [tuple(r) for r in out.orderBy("q").select("q", "predicted_y", "mad_y", "effective_k", "used_fallback").collect()] == [(1, 0.0, 0.0, 2, False), (2, 0.0, 0.0, 2, True), (3, 10.0, 0.0, 2, True), (4, 0.0, 0.0, 2, False)]
    assert out.columns == ["q", "label", "x", "predicted_y", "mad_y", "mean_distance", "effective_k", "used_fallback"]
