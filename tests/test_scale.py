"""How much a step moves: exchanges of plans, and equal results of steps that were made lighter."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sparkpanel.operators import knn, metrics, percentiles, sampling
from sparkpanel.sources.cells import long


def exchanges(frame):
    """Hash exchanges of the plan before it runs."""
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def wide(spark, n=200):
    rows = [(f"p{k % 2}", f"s{k % 4}", f"c{k}", "AB"[k % 3 == 0], float(k % 17), float(k % 5)) for k in range(n)]
    return spark.createDataFrame(rows, "patient_id string, specimen_id string, cell_id string, cell_type string, m double, n double")


def test_curve_of_dealt_cells_moves_them_once(spark):
    rows, keys = wide(spark), ["patient_id", "specimen_id", "cell_type"]
    predicted = {m: (F.col(m) * 0.5, F.col(m) * 0.25) for m in ("m", "n")}
    points = metrics.sides(rows.where("n < 3"), rows.where("n >= 2"), keys, predicted)
    unit = spark.createDataFrame([("m", 1.0), ("n", 1.0)], "marker string, scale double")
    curve = metrics.residual_curve(points, [*keys, "marker"], unit, [0.0, 0.5, 1.0])
    assert exchanges(curve) == 1
    plain = metrics.residual_curve(points.coalesce(1), [*keys, "marker"], unit, [0.0, 0.5, 1.0])
    key = lambda r: (*r[:5],)
    got, want = ({key(r): r.error for r in f.collect()} for f in (curve, plain))
    assert len(got) == 4 * 2 * 2 * 3 and got == pytest.approx(want)


def test_long_keeps_the_deal(spark):
    dealt = long(wide(spark).repartition("specimen_id"), ("m", "n"))
    assert exchanges(dealt.groupBy("specimen_id", "marker", "value").count()) == 1
    assert sorted(dealt.columns) == ["cell_id", "cell_type", "marker", "patient_id", "specimen_id", "value"] and dealt.count() == 400


def test_units_come_from_one_pass(spark):
    curve = spark.createDataFrame([("a", 0.0, 3.0), ("a", 0.5, 1.0), ("a", 1.0, 1.0), ("b", 0.0, 2.0), ("b", 0.5, 4.0)], "g string, alpha double, error double")
    units = metrics.uncertainty_units(curve, ["g"], 0.6)
    assert exchanges(units) == 1
    assert {tuple(r) for r in units.collect()} == {("a", 3.0, 2.0, 2.0, 0.5, 1), ("b", 2.0, 0.0, -2.0, 0.0, 0)}


def test_reservoir_moves_large_groups_alone(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 1800, "big").when(F.col("id") < 2900, "small").alias("g"), "id")
    key = lambda f: sorted((r.g or "", r.id) for r in f.collect())
    assert exchanges(sampling.reservoir(rows, ["g"], 2000, ["id"], 1)) == 0
    got = sampling.reservoir(rows, ["g"], 1200, ["id"], 1)
    assert key(got) == key(sampling._first(rows, ["g"], 1200, ["id"], 1)) and got.count() == 1200 + 1100 + 100


def test_columns_are_placed_where_they_stand(spark):
    rows = wide(spark).withColumn("m", F.when(F.col("cell_id") != "c7", F.col("m")))
    knots = percentiles.knots(long(rows, ("m",)).where("value < 14"), ["marker"], n=9)
    placed = percentiles.transform_columns(rows, knots, ["m", "n"])
    assert exchanges(placed) == 0 and placed.columns == rows.columns
    want = {r.cell_id: r.value for r in percentiles.transform(long(rows, ("m",)), knots).collect()}
    got = {r.cell_id: (r.m, r.n) for r in placed.collect()}
    assert {c: m for c, (m, _) in got.items()} == pytest.approx(want, nan_ok=True) and all(n != n for _, n in got.values())


def test_classifiers_read_kept_training_cells(spark, tmp_path, monkeypatch):
    from sparkpanel.operators import models
    from sparkpanel.plans import probe

    seen, whole = [], models.fit_classifier
    monkeypatch.setattr(models, "fit_classifier", lambda rows, *rest: seen.append(rows) or whole(rows, *rest))
    rows = wide(spark)
    probe.probe(rows, rows, {"one": ["m"], "two": ["m", "n"]}, "cell_type", ["A", "B"])
    plans = [r._jdf.queryExecution().executedPlan().toString() for r in seen]
    assert len(plans) == 2 and all("Window" not in p and "FileScan parquet" in p for p in plans)
    assert [r.count() for r in seen] == [200, 200]


def test_strata_of_dealt_points_are_not_moved_again(spark, monkeypatch):
    from sparkpanel.operators import distance

    rows = wide(spark).withColumn("side", (F.col("n") > 2).cast("int"))
    dealt, plain = long(rows.repartition("specimen_id"), ("m", "n")), long(rows, ("m", "n"))
    unit = spark.createDataFrame([("m", 1.0), ("n", 1.0)], "marker string, scale double")
    assert exchanges(distance.strata(dealt, unit, 1)) == 1
    key = lambda f: sorted((r.specimen_id, r.cell_type, r.marker, r.w1) for r in f.collect())
    assert key(distance.strata(dealt, unit, 1)) == key(distance.strata(plain, unit, 1))
    kept, plans = distance.kept, []
    monkeypatch.setattr(distance, "kept", lambda frame, name: plans.append(exchanges(frame)) or kept(frame, name))
    distance.evaluation_views(dealt, unit, 1)
    assert len(plans) == 2 and plans[0] == 2  # pooled counts, of cells dealt before


def test_ranks_sort_once_a_side(spark):
    from sparkpanel.operators import ranks

    rows = wide(spark).where("n is not null")
    plan = ranks.spearman(rows, ["specimen_id"], "m", "n")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Sort [") == 2


def test_weights_meet_patients_after_they_are_summed(spark):
    from sparkpanel.operators import distance

    rows = long(wide(spark), ("m", "n"))
    maps = spark.createDataFrame([(0, "p0", "p1"), (0, "p1", "p0")], "derangement int, patient_id string, wrong_patient string")
    unit = spark.createDataFrame([("m", 1.0), ("n", 2.0)], "marker string, scale double")
    key = lambda f: {(r.patient_id, r.marker): (r.matched_error, r.wrong_patient_error) for r in f.collect()}
    weighed = distance.mixture_weights(wide(spark)).transform(lambda x: long(x, ("m", "n")))
    got, want = (key(distance.patient_gain(a, a, maps, unit)) for a in (weighed, rows))
    assert len(got) == 4 and all(got[k] == pytest.approx(want[k]) for k in want)
    assert "weight" in weighed.columns and exchanges(weighed) < exchanges(distance.mixture_weights(rows, extra=["marker"])) + 1
    plan = distance.patient_gain(weighed, weighed, maps, unit)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [patient_id#") >= 2  # a sum by patient below the join with pairs


def test_waves_of_many_groups(spark):
    from sparkpanel.operators import joint

    rows = spark.range(20000).select((F.col("id") % 9000).alias("g"), (F.col("id") % 2).cast("int").alias("side"), (F.col("id") % 7).cast("double").alias("m"))
    omega = np.array([[0.5], [1.5]])
    got = {(r.group, r.side): r.value for r in joint.embeddings(rows, "g", ["m"], omega).where("k = 4").collect()}
    assert len(got) == 9000
    assert got["8", 0] == pytest.approx(sum(np.sin(1.5 * (i % 7)) for i in (8, 9008, 18008)))
    out = next(joint._waves(omega, ["m"])(iter([pa.RecordBatch.from_pydict({"group": ["a", "b", "a"], "side": pa.array([0, 1, 0], pa.int32()), "m": [1.0, 2.0, 3.0]})])))
    assert out.num_rows == 2  # sums leave with their batch


def test_prior_draws_number_asked_specimens_alone(spark):
    bank = wide(spark)
    asked = spark.range(3).select(F.col("id").alias("q"))
    drawn = sampling.prior_draw(bank, asked, ["q"], 1, ["cell_id"])
    assert "LeftSemi" in drawn._jdf.queryExecution().optimizedPlan().toString() and drawn.count() == 3


def test_network_rows_are_picked_by_ranges(spark, monkeypatch):
    from sparkpanel.operators import models

    seen = {}
    monkeypatch.setattr(models.Network, "fit", lambda self, x, y, groups: seen.update(x=x[:, 0].tolist(), y=y[:, 0].tolist()) or self)
    plain = wide(spark, 3000).withColumn("m", F.col("m") + F.substring("cell_id", 2, 9).cast("double"))
    want = plain.select("m", "n", "patient_id").orderBy(F.xxhash64("m", "n", "patient_id")).limit(70).collect()
    sent, limit = [], type(plain).limit
    monkeypatch.setattr(type(plain), "limit", lambda frame, n: sent.append(frame.count()) or limit(frame, n))
    models.fit_network(plain, ["m"], ["n"], "patient_id", most=70)
    assert seen == {"x": [r.m for r in want], "y": [r.n for r in want]} and 70 <= sent[0] < 90


def test_numbered_rows_are_bucketed_where_they_stand(spark):
    from pyspark.sql import Window as W

    from sparkpanel.sources import bucketed

    dealt = wide(spark).repartition(4, "patient_id", "specimen_id")
    rows = dealt.withColumn("row_idx", F.row_number().over(W.partitionBy("patient_id", "specimen_id").orderBy("cell_id")))
    assert exchanges(rows.repartition(4, "patient_id", "specimen_id")) == 1
    assert bucketed.bucketed(rows, ["patient_id", "specimen_id"], 4).count() == 200


def test_blocks_of_the_teacher_come_as_arrow_tables(spark):
    from sparkpanel.operators import transport

    rows = wide(spark)
    found = transport.teacher(rows, rows, ["specimen_id", "cell_type"], ["cell_id"], ["m"], ["n"], most=20, least=17)
    assert "InArrow" in found._jdf.queryExecution().executedPlan().toString()
    sizes = {(r.specimen_id, r.cell_type): r["count"] for r in found.groupBy("specimen_id", "cell_type").count().collect()}
    assert sizes == {**{(f"s{k}", "A"): 20 for k in range(4)}, **{(r.specimen_id, "B"): r["count"] for r in rows.where("cell_type = 'B'").groupBy("specimen_id").count().collect() if 17 <= r["count"] < 20}}


def test_a_shard_passes_a_task_in_pieces(spark, monkeypatch):
    """A task holds its queries and their nearest so far: what it holds does not grow with the shard."""
    passed = getattr(knn, "_passed", None)
    assert passed, "a whole shard goes to a task"
    rng = np.random.default_rng(0)

    def batches(n: int):
        for side, first, size in [(0, 0, 50), *((1, a, 2000) for a in range(0, n, 2000))]:
            x = pa.FixedSizeListArray.from_arrays(rng.normal(size=size * 20), 20).cast(pa.list_(pa.float64()))
            names = ["__side", "__id", "__label", "__x", "__k0", "__y0"]
            ids = pa.array([f"q{i}" if side == 0 else None for i in range(size)], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([side] * size, pa.int32()), ids, pa.nulls(size, pa.string()), x, pa.array(range(first, first + size)), pa.array(rng.normal(size=size))], names=names)

    peaks = []
    for n in (2000, 20_000, 100_000):
        tracemalloc.start()
        assert sum(b.num_rows for b in passed(20, ["__k0", "__y0"], 5)(batches(n))) == 250
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[2] < 1.2 * peaks[1]
    bank = spark.range(40).selectExpr("id AS k", "cast(id AS double) AS x", "cast(id AS double) AS y")
    monkeypatch.setattr(knn, "MOST", 10)
    plan = knn.impute(bank, bank, ["x"], ["y"], ["k"], k=3)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and plan.count("MapInArrow") == 1  # and it is asked once


def test_neighbours_of_shards_meet_by_squared_distance(spark, monkeypatch):
    """Squares that differ in the last bit have one root: the nearer row wins, whichever shard it is in."""
    bank = spark.createDataFrame([(k, 1.0, 2.0**-26 if k < 7 else 0.0, float(k)) for k in range(8)], "k int, a double, b double, y double")
    asked = spark.createDataFrame([(0.0, 0.0)], "a double, b double")
    for most in (100_000, 1):
        monkeypatch.setattr(knn, "MOST", most)
        assert knn.impute(asked, bank, ["a", "b"], ["y"], ["k"], k=1).first().predicted_y == 7.0


def test_neighbours_over_pieces_equal_brute_force(spark, monkeypatch):
    """Ties, copies, string keys, labels, rows without a distance and null targets, in pieces of two rows."""
    rng = np.random.default_rng(5)
    rows = [(f"k{k:03d}", "abc"[k % 3] if k % 7 else None, [None, float("nan"), float("inf")][k % 3] if k % 31 == 30 else float(rng.integers(0, 6)), float(rng.integers(0, 3)), None if k % 11 == 0 else float(k)) for k in range(240)]
    frame = spark.createDataFrame(rows, "k string, label string, a double, b double, y double")
    asked, bank = rows[::4], [r for i, r in enumerate(rows) if i % 4 and r[1] != "c"]
    fine = lambda r: r[2] is not None and np.isfinite(r[2])
    known = {r[1] for r in bank if r[1]}
    want = {}
    for q in asked:
        near = sorted(((r[2] - q[2]) ** 2 + (r[3] - q[3]) ** 2, r[0], r[4]) for r in bank if fine(r) and (q[1] not in known or r[1] == q[1]))[:6] if fine(q) else []
        ys = sorted(y for _, _, y in near if y is not None)
        want[q[0]] = (ys[(len(ys) - 1) // 2] if ys else None, len(near), q[1] not in known)
    monkeypatch.setattr(knn, "PIECE", 2, raising=False)
    for most in (100, 30):
        monkeypatch.setattr(knn, "MOST", most)
        out = knn.impute(frame.where("int(substr(k, 2)) % 4 = 0"), frame.where("int(substr(k, 2)) % 4 <> 0 AND (label IS NULL OR label <> 'c')"), ["a", "b"], ["y"], ["k"], k=6, label="label")
        assert {r.k: (r.predicted_y, r.effective_k, r.used_fallback) for r in out.collect()} == want
    few = []
    for most in (100_000, 10):  # gathered, in shards
        monkeypatch.setattr(knn, "MOST", most)
        out = knn.impute(frame.where("k < 'k100'"), frame.where("y > 100 AND y < 140"), ["a", "b"], ["y"], ["k"], k=3)
        few.append(out.orderBy("k").select("predicted_y", "effective_k").collect())
    assert few[0] == few[1] and {r.effective_k for r in few[0]} == {0, 3}


def test_candidates_of_many_copies_are_compared_in_parts():
    """Where every row of a label is as near as the next, what is compared at a time stays bounded."""
    query, bank = np.zeros((400, 62)), np.ones((10_000, 62))
    tracemalloc.start()
    places, _ = knn.nearest(query, bank, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (places == np.arange(10)).all() and peak < 60 << 20
