"""Evaluation views, nested fits, label hierarchies, joint structure, neighbours by balls, saved translations, bucketed rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import curves, distance, gramian, joint, metrics, models, neighbours, percentiles, sampling, som, splits
from sparkpanel.plans import runs, saved
from sparkpanel.sources import bucketed, specimens


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(2)
    rows = []
    for s in range(6):
        for side in (0, 1):
            for k in range(int(rng.integers(20, 60))):
                for m in ("a", "b"):
                    rows.append((f"p{s % 3}", f"s{s}", ["x", "y", None][k % 3], m, float(np.round(rng.normal() + side * 0.3, 2)), side))
    return spark.createDataFrame(rows, "patient_id string, specimen_id string, cell_type string, marker string, value double, side int"), rows


def w1(a, b):
    """By definition: the area between both distribution functions."""
    grid = sorted({*a, *b})
    cdf = lambda v, t: np.mean(np.asarray(v) <= t)
    return sum(abs(cdf(a, lo) - cdf(b, lo)) * (hi - lo) for lo, hi in zip(grid, grid[1:], strict=False))


@pytest.mark.parametrize("parts", [2, 32])
def test_views_against_separate_groups(spark, points, parts):
    frame, rows = points
    scales = spark.createDataFrame([("a", 2.0), ("b", 0.5)], "marker string, scale double")
    got = {(r.view, r.patient_id, r.specimen_id, r.cell_type, r.marker): r for r in distance.view_strata(frame, scales, 3, parts).collect()}
    naming = {"stratified": lambda r: r[:4], "unstratified": lambda r: (*r[:2], "All", r[3]), "pooled": lambda r: ("pooled", "pooled", *r[2:4]), "pooled_unstratified": lambda r: ("pooled", "pooled", "All", r[3])}
    n = 0
    for view, name in naming.items():
        groups = {}
        for r in rows:
            groups.setdefault(name(r), ([], []))[r[5]].append(r[4])
        for key, (a, b) in groups.items():
            if min(len(a), len(b)) < 3 or key[2] is None:
                continue
            n += 1
            one, scale = got[(view, *key)], {"a": 2.0, "b": 0.5}[key[3]]
            assert (one.prediction_median, one.target_median) == pytest.approx((np.median(a), np.median(b)))
            assert one.w1 == pytest.approx(w1(a, b) / scale) and one.median_error == pytest.approx(abs(np.median(a) - np.median(b)) / scale)
    assert n == len(got)
    views = {r.view: r for r in distance.evaluation_views(frame, scales, 3).collect()}
    assert set(views) == set(distance.VIEWS) and views["pooled"].n_patients == 1 and views["stratified"].n_patients == 3
    plain = distance.population_metrics(frame, scales, 3).first()
    assert views["stratified"].patient_first_w1 == pytest.approx(plain.patient_first_w1)


def test_products_by_group(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 3))
    frame = spark.createDataFrame([("g" if k % 3 else None, *map(float, r)) for k, r in enumerate(x)] + [("g", None, 1.0, 1.0)], "g string, a double, b double, c double")
    found = {}
    for r in gramian.products(frame.repartition(5), [F.col(c) for c in "abc"], F.col("g")).collect():
        found.setdefault(r.group, []).append(r)
    for name, mine in (("g", x[np.arange(500) % 3 != 0]), (None, x[np.arange(500) % 3 == 0])):
        one = np.column_stack([np.ones(len(mine)), mine])
        np.testing.assert_allclose(gramian.matrix(found[name], 4), one.T @ one, rtol=1e-10)


def test_nested_ridges_are_those_of_prefixes(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{k % 7}", float(a), float(b), float(2 * a - b + rng.normal() + k % 7 + 1e6)) for k, (a, b) in enumerate(rng.normal(size=(700, 2)))]
    frame = spark.createDataFrame(rows, "patient_id string, a double, b double, y double")
    got = curves.nested_ridges(frame, ["a", "b"], ["y"], [1, 4, 7, 99], 5, alpha=2.0)
    order = sampling.hash_order({r[0] for r in rows}, 5)
    assert sorted(got) == [1, 4, 7]
    for count, model in got.items():
        want = models.fit_ridge(frame.where(F.col("patient_id").isin(order[:count])), ["a", "b"], ["y"], alpha=2.0)
        for part in ("mean", "scale", "weights", "intercept"):
            np.testing.assert_allclose(getattr(model, part), getattr(want, part), rtol=1e-7)
    out = curves.along(got, frame).groupBy("count").agg(F.count(F.lit(1)).alias("n"), F.sum("predicted_y").alias("s")).collect()
    assert {r["count"]: r.n for r in out} == {1: 700, 4: 700, 7: 700}


def test_ridge_with_labels_and_weights(spark):
    rng = np.random.default_rng(4)
    rows = [("xyz"[k % 3], float(a), float(w), float(3 * a * (k % 3) + k % 3)) for k, (a, w) in enumerate(zip(rng.normal(size=300), rng.uniform(0.5, 2, 300), strict=True))]
    frame = spark.createDataFrame(rows, "label string, a double, w double, y double")
    model = models.fit_ridge(frame, ["a"], ["y"], alpha=1e-6, label="label", weight="w")
    assert model.predict(frame).agg(F.max(F.abs(F.col("predicted_y") - F.col("y")))).first()[0] < 1e-3


def test_confusion_rolls_up(spark):
    rng = np.random.default_rng(5)
    tree = {"T1": "T", "T2": "T", "B1": "B", "N1": "N"}
    names = [*tree, "odd"]
    rows = [(f"p{k % 2}", f"c{k}", names[rng.integers(5)], names[rng.integers(5)]) for k in range(400)]
    frame = spark.createDataFrame(rows, "patient_id string, cell_id string, label string, predicted string")
    matrix = metrics.rolled_up(metrics.confusion(frame, ["patient_id"]), ["patient_id"], tree)
    got = {(r.resolution, r.patient_id, r.label, r.predicted): r.n for r in matrix.collect()}
    want = {}
    for p, _, a, b in rows:
        want[("fine", p, a, b)] = want.get(("fine", p, a, b), 0) + 1
        if a in tree and b in tree:
            key = ("coarse", p, tree[a], tree[b])
            want[key] = want.get(key, 0) + 1
    assert got == want
    scores = frame.where("label <> 'odd'").select("patient_id", "cell_id", "label", F.explode(F.array(*(F.struct(F.lit(c).alias("class"), F.when(F.col("predicted") == c, 0.7).otherwise(0.1).alias("score")) for c in tree))).alias("x")).select("patient_id", "cell_id", "label", "x.*")
    coarse = {(r.cell_id, r["class"]): r.score for r in metrics.rolled_up_scores(scores, ["patient_id", "cell_id"], tree).collect()}
    one = next(r for r in rows if r[2] != "odd" and r[3] == "T1")
    assert coarse[one[1], "T"] == pytest.approx(0.8) and coarse[one[1], "B"] == pytest.approx(0.1)
    known = frame.where("label <> 'odd' and predicted <> 'odd'")
    per, overall, _ = metrics.resolution_metrics(known, ["patient_id"], tree, scores, ["cell_id"])
    direct = metrics.label_metrics(known.replace(tree, subset=["label", "predicted"]), ["patient_id"], ["B", "N", "T"], variant="probe")[1]
    same = {(r.patient_id): (r.accuracy, r.macro_f1) for r in overall.where("resolution = 'coarse'").collect()}
    assert same == {r.patient_id: (r.accuracy, r.macro_f1) for r in direct.collect()}
    assert per.where("auprc is not null").select("resolution").distinct().count() == 2


def test_kernel_distance_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    x, y = rng.normal(size=(150, 2)), rng.normal(size=(120, 2)) + 0.7
    rows = [("g", 0, *map(float, r)) for r in x] + [("g", 1, *map(float, r)) for r in y] + [("h", 0, 0.0, 0.0), ("g", 0, None, 1.0)]
    frame = spark.createDataFrame(rows, "g string, side int, a double, b double")
    kernel = lambda u, v: np.exp(-((u[:, None] - v[None]) ** 2).sum(-1) / (2 * 1.5**2)).mean()
    got = {r.g: r for r in joint.mmd(frame.repartition(4), "g", ["a", "b"], joint.frequencies(2, 4000, 1.5, 1)).collect()}
    assert got["g"].mmd2 == pytest.approx(kernel(x, x) + kernel(y, y) - 2 * kernel(x, y), abs=0.02)
    assert (got["g"].n0, got["g"].n1, got["h"].n1, got["h"].mmd2) == (150, 120, 0, None)


def test_correlations_and_their_errors(spark):
    rng = np.random.default_rng(7)
    x, y = rng.normal(size=(200, 2)), rng.normal(size=(200, 2))
    x, y = np.column_stack([x, x.sum(1)]), np.column_stack([y, y[:, 0] - y[:, 1]])
    rows = [("g", 0, *map(float, r)) for r in x] + [("g", 1, *map(float, r)) for r in y] + [("flat", s, 1.0, 2.0, 3.0) for s in (0, 1) for _ in range(4)]
    frame = spark.createDataFrame(rows, "g string, side int, a double, b double, c double")
    r0, r1 = np.corrcoef(x.T), np.corrcoef(y.T)
    gaps = [abs(r0[i, j] - r1[i, j]) for i, j in ((0, 1), (0, 2), (1, 2))]
    got = {r.g: r for r in joint.joint_error(frame, "g", ["a", "b", "c"]).collect()}
    assert set(got) == {"g"} and got["g"].n_pairs == 3
    assert (got["g"].mean_error, got["g"].worst_error) == pytest.approx((np.mean(gaps), max(gaps)))


def brute(x, y, k, own):
    out = {}
    for i, a in x:
        near = sorted((sum((p - q) ** 2 for p, q in zip(a, b, strict=True)), j) for j, b in y if not (own and i == j))
        out[i] = [(j, math.sqrt(d)) for d, j in near[:k]]
    return out


@pytest.mark.parametrize(("ball", "shard", "slice_"), [(2048, 8192, 8192), (20, 15, 11), (5, 3, 4)])
def test_neighbours_by_balls(spark, ball, shard, slice_):
    rng = np.random.default_rng(8)
    data = {g: [(f"{g}{k}", (float(a), float(b))) for k, (a, b) in enumerate(np.round(rng.normal(size=(n, 2)), 1))] for g, n in (("u", 150), ("v", 1), ("w", 2))}
    data["copies"] = [(f"c{k:02d}", (1.0, 1.0)) for k in range(40)]
    rows = [(g, i, *x) for g, some in data.items() for i, x in some]
    frame = spark.createDataFrame([*rows, ("u", "null", None, 1.0)], "g string, id string, a double, b double")
    sizes = {"ball": ball, "shard": shard, "slice_": slice_}
    got = {}
    for r in neighbours.nearest(frame, frame, ["g"], "id", "id", ["a", "b"], 4, own=True, **sizes).orderBy("rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, pytest.approx(r.distance)))
    want = {i: near for some in data.values() for i, near in brute(some, some, 4, True).items() if near}
    assert got == want
    odd = frame.where("hash(id) % 2 = 0")
    other = frame.where("hash(id) % 2 <> 0")
    pairs = {(r.id, r.target_id) for r in neighbours.mutual(odd, other, ["g"], "id", ["a", "b"], **sizes).collect()}
    ids = {r.id for r in odd.collect()}
    expected = set()
    for some in data.values():
        a, b = [x for x in some if x[0] in ids], [x for x in some if x[0] not in ids]
        there, back = brute(a, b, 1, False), brute(b, a, 1, False)
        expected |= {(i, near[0][0]) for i, near in there.items() if near and back[near[0][0]] and back[near[0][0]][0][0] == i}
    assert pairs == expected


def test_balls_leave_out_far_ones(spark):
    """Of clusters far apart a query asks only its own."""
    rng = np.random.default_rng(9)
    rows = [("g", k, float(rng.normal() + 1000 * (k % 8)), float(rng.normal())) for k in range(800)]
    frame = spark.createDataFrame(rows, "g string, id long, a double, b double")
    plain = neighbours.nearest(frame, frame, ["g"], "id", "id", ["a", "b"], 3, own=True).orderBy("id", "rank").collect()
    cut = neighbours.nearest(frame, frame, ["g"], "id", "id", ["a", "b"], 3, own=True, ball=40).orderBy("id", "rank").collect()
    assert plain == cut


def test_percentile_lines_by_halving(spark):
    rng = np.random.default_rng(10)
    values = rng.normal(size=2000)
    frame = spark.createDataFrame([("a", float(v)) for v in values], "marker string, value double")
    table = percentiles.knots(frame, ["marker"], n=33)
    one = table.first()
    asked = [-9.0, 9.0, *map(float, one.knots), *map(float, values[:300])]
    rows = spark.createDataFrame([(k, "a", v) for k, v in enumerate(asked)] + [(-1, "a", None), (-2, "b", 1.0), (-3, "a", float("nan"))], "k int, marker string, value double")
    got = {r.k: r.value for r in percentiles.transform(rows, table).collect()}
    assert [got[k] for k in range(len(asked))] == pytest.approx(np.interp(asked, one.knots, one.probabilities), abs=1e-12)
    assert all(math.isnan(got[k]) for k in (-1, -2, -3))
    back = {r.k: r.value for r in percentiles.inverse(percentiles.transform(rows.where("k >= 2"), table), table).collect()}
    assert [back[k] for k in range(2, len(asked))] == pytest.approx(np.clip(asked[2:], one.knots[0], one.knots[-1]), abs=1e-9)


@pytest.fixture(scope="module")
def cohort(spark):
    rng = np.random.default_rng(11)
    rows = []
    for s in range(8):
        for k in range(60):
            a, b = rng.normal(size=2)
            rows.append((f"p{s % 4}", f"s{s}", f"{s}-{k}", ["Blast", "T cell"][k % 2], float(a), float(b), float(2 * a + 0.5 * b)))
    frame = spark.createDataFrame(rows, "patient_id string, specimen_id string, cell_id string, cell_type string, CD3 double, CD4 double, SIGNAL double")
    roles = splits.hashed_folds(frame, 4, 1).where("fold = 0").select("specimen_id", "role")
    target = frame.select("patient_id", "specimen_id", F.concat(F.lit("t"), "cell_id").alias("cell_id"), "cell_type", "CD3", "SIGNAL")
    return frame.drop("SIGNAL"), target, roles, runs.CrossPanel(["CD3"], ["CD4"], ["SIGNAL"], least=5, epochs=3)


def test_saved_translation_predicts_alike(spark, cohort, tmp_path):
    source, target, roles, spec = cohort
    model = saved.Translator.fit(source, target, roles, spec)
    model.gates["SIGNAL"] = 0.5  # so that the residual counts
    want = {r.cell_id: r.predicted_SIGNAL for r in model.predict(source).collect()}
    model.save(str(tmp_path / "model"))
    model.save(str(tmp_path / "model"))  # saving again replaces
    again = saved.Translator.load(spark, str(tmp_path / "model"))
    got = {r.cell_id: r.predicted_SIGNAL for r in again.predict(source).collect()}
    assert len(got) == source.count() and got == pytest.approx(want)
    plain = model.base.predict(runs.to_percentiles(source, model.knots, spec.shared)).agg(F.sum("predicted_SIGNAL")).first()[0]
    assert sum(got.values()) != pytest.approx(plain)
    with pytest.raises(ValueError, match="no such markers"):
        again.predict(source.drop("CD4"))


def test_paired_curve(cohort):
    source, target, roles, spec = cohort
    found = runs.paired_curve(source, target, roles, spec, [0, 1, 3], k=5)
    rows = found["evaluation"].collect()
    assert {r.method for r in rows} == {*runs.SHARED_METHODS, "gated"} and {r["count"] for r in rows if r.method == "gated"} == {0, 1, 3}
    assert {r.view for r in rows} == set(distance.VIEWS)
    score = {(r.method, r["count"], r.view): r.patient_first_w1 for r in rows}
    assert score["gated", 0, "stratified"] == pytest.approx(score["ridge", None, "stratified"])
    assert score["ridge", None, "stratified"] < score["global_median", None, "stratified"]
    sets = {}
    for r in found["paired"].collect():
        sets.setdefault(r["count"], set()).add(r.specimen_id)
    assert {k: len(v) for k, v in sets.items()} == {1: 1, 3: 3} and sets[1] < sets[3]
    assert {(r["count"], r.alpha) for r in found["gates"].where("count = 0").collect()} == {(0, 0.0)}
    with pytest.raises(ValueError, match="train specimens"):
        runs.paired_curve(source, target, roles, spec, [99])


def test_bucketed_rows_join_without_an_exchange(spark, tmp_path):
    rows = spark.range(3000).select(F.lit("m").alias("modality"), F.concat(F.lit("s"), F.col("id") % 3).alias("specimen_id"), (F.col("id") / 3).cast("long").alias("row_idx"), "id")
    counts = rows.groupBy("modality", "specimen_id").agg(F.count(F.lit(1)).alias("eligible_events"))
    frozen = specimens.frozen_rows(counts, 100, [1, 2])
    load = specimens.bucketed_queries(rows, frozen, 4)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold",)}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        one = load(1)
        plan = one._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        for seed in (1, 2):
            want = {(r.specimen_id, r.row_idx) for r in frozen.where(F.col("seed") == seed).collect()}
            assert {(r.specimen_id, r.row_idx) for r in load(seed).collect()} == want and len(want) == 300
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    assert bucketed.bucketed(rows, ["id"], 2, str(tmp_path / "t")).count() == 3000


def test_seeded_folds_as_a_plan(spark):
    of = {f"s{k}": f"p{k % 11}" for k in range(40)}
    frame = spark.createDataFrame([(p, s) for s, p in of.items()], "patient_id string, specimen_id string")
    for n, seed, fraction in ((2, 1, 0.5), (5, 4207, 0.2), (11, 9, 0.05)):
        got = sorted(tuple(r) for r in splits.seeded_folds(frame, n, seed, fraction).collect())
        assert got == sorted(splits.grouped_folds(of, n, seed, fraction))


def test_map_by_aggregates(spark):
    rng = np.random.default_rng(12)
    centres = np.array([[0, 0], [8, 0], [0, 8], [8, 8]])
    x = centres[np.arange(1200) % 4] + rng.normal(size=(1200, 2)) * 0.3
    frame = spark.createDataFrame([(k, float(a), float(b), float(k % 4 * 10 + rng.normal() * 0.1)) for k, (a, b) in enumerate(x)], "k long, a double, b double, y double")
    fitted = som.fit(frame, ["a", "b"], 2, 2, seed=3)
    placed = frame.select("k", fitted.node().alias("node")).collect()
    assert all(len({r.node for r in placed if r.k % 4 == c}) == 1 for c in range(4)) and len({r.node for r in placed}) == 4
    z = (x - fitted.mean) / fitted.scale
    assert [r.node for r in sorted(placed)] == som.nodes(z, fitted.book).tolist()
    known, asked = frame.where("k % 3 > 0"), frame.where("k % 3 = 0").drop("y")
    out = som.draw(asked, known, ["a", "b"], ["y"], ["k"], rows=2, columns=2, seed=3).collect()
    assert len(out) == 400 and not any(r.abstained for r in out)
    assert all(abs(r.predicted_y - r.k % 4 * 10) < 1 for r in out)
    assert len({r.predicted_y for r in out}) > 390
    table = {r.node: r for r in som.node_table(known, fitted, ["y"]).collect()}
    for node, r in table.items():
        mine = np.array([q.y for q in known.withColumn("node", fitted.node()).where(F.col("node") == node).select("y").collect()])
        spread = min(mine.std(ddof=1), (np.quantile(mine, 0.75) - np.quantile(mine, 0.25)) / 1.34)
        assert r.width_y == pytest.approx(0.9 * spread * len(mine) ** -0.2)
    few = som.draw(asked, known.limit(20), ["a", "b"], ["y"], ["k"], rows=2, columns=2, seed=3).collect()
    assert all(r.abstained for r in few) and len({r.predicted_y for r in few}) == 1


def test_hot_node_is_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(som, "SHARE", 7)
    frame = spark.createDataFrame([(k, 1.0, float(k)) for k in range(100)], "k long, a double, y double")
    out = som.draw(frame.drop("y"), frame, ["a"], ["y"], ["k"], least=5, rows=1, columns=1)
    rows = out.collect()
    assert len(rows) == 100 and not any(r.abstained for r in rows) and all(0 <= r.predicted_y <= 99 for r in rows)


def test_pairing_conditions(spark):
    rows = [(f"p{k % 5}", f"s{k % 10}", f"c{k}") for k in range(120)] + [("few", "sf", "cf")]
    target = spark.createDataFrame(rows, "patient_id string, specimen_id string, cell_id string")
    found = sampling.pairing_conditions(target, 8, 3, derangements=3)
    assert sampling.pairing_violations(found, target, 8).collect() == []
    got = found.collect()
    assert {r.patient_id for r in got} == {f"p{k}" for k in range(5)} and {r.condition for r in got} == set(sampling.CONDITIONS)
    wrong = {(r.derangement, r.patient_id): r.reference_patient for r in got if r.condition == "patient_deranged"}
    assert len(wrong) == 15 and all(p != q for (_, p), q in wrong.items())
    assert all(len({wrong[d, f"p{k}"] for k in range(5)}) == 5 for d in range(3))
    broken = found.where("not (condition = 'patient_matched' and patient_id = 'p1')").limit(10_000)
    rules = {(r.rule, r.patient_id) for r in sampling.pairing_violations(broken, target, 8).collect()}
    assert rules == {("condition_missing", "p1")}
    strange = found.withColumn("cell_id", F.when((F.col("condition") == "identity_blind_pooled") & (F.col("patient_id") == "p2"), F.lit("none")).otherwise(F.col("cell_id")))
    rules = {r.rule for r in sampling.pairing_violations(strange, target, 8).collect()}
    assert {"cell_of_no_target", "pool_differs_between_patients"} <= rules


def test_small_groups_are_answered_where_they_are_found(spark):
    """Groups of one ball take no join and no row a neighbour; they say what balls say of larger ones."""
    rng = np.random.default_rng(12)
    rows = [(g, f"{k}", float(a), float(b), [None, "x", "y"][k % 3], int(k % 2)) for g, n in (("u", 45), ("v", 24), ("w", 2), ("z", 1)) for k, (a, b) in enumerate(np.round(rng.normal(size=(n, 2)), 1))]
    frame = spark.createDataFrame([*rows, ("u", "none", None, 1.0, "x", 1), ("w", "none", 1.0, None, "x", 1)], "g string, id string, a double, b double, label string, side int")
    pair = (frame.where("side = 0"), frame.where("side = 1"))
    asked = {
        "density": lambda **s: neighbours.density(frame, ["g"], "id", ["a", "b"], 4, **s),
        "agreement": lambda **s: neighbours.agreement(frame, ["g"], "id", ["a"], ["a", "b"], 4, "label", **s),
        "mixing": lambda **s: neighbours.mixing(frame, ["g"], "id", "label", ["a", "b"], 4, **s),
        "mutual": lambda **s: neighbours.mutual(*pair, ["g"], "id", ["a", "b"], **s),
    }
    for name, ask in asked.items():
        whole = ask()
        assert "CoGroup" not in whole._jdf.queryExecution().optimizedPlan().toString()
        got, want = ([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in t.collect()] for t in (whole, ask(ball=20, shard=15, slice_=11)))
        assert sorted(got, key=str) == sorted(want, key=str), name


def test_nodes_of_a_map_are_found_in_batches(spark):
    """The nearest node, the first of equals, null where a feature is null; not by one expression a node and row."""
    fitted = som.Map(["a", "b"], np.array([1.0, 0.0]), np.array([2.0, 1.0]), np.array([[0.0, 0.0], [1.0, 1.0], [0.0, 0.0], [-1.0, 2.0]]))
    rows = [(1.0, 0.0), (3.0, 1.0), (-1.0, 2.5), (None, 1.0), (2, None)]
    frame = spark.createDataFrame([(k, *(None if v is None else float(v) for v in r)) for k, r in enumerate(rows)], "k int, a double, b double").select("k", fitted.node().alias("node"))
    assert [r.node for r in frame.orderBy("k").collect()] == [0, 1, 3, None, None]
    assert "transform" not in frame._jdf.queryExecution().optimizedPlan().toString()
