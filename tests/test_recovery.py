"""Same-cell runs: what is drawn once, what is moved once."""

import numpy as np
from pyspark.sql import functions as F

from sparkpanel.operators import sampling
from sparkpanel.plans import runs


def cohort(spark, n=600):
    rng = np.random.default_rng(5)
    rows = [("O", f"p{k % 6}", f"s{k % 12}", f"c{k}", "AB"[k % 2], *map(float, rng.normal(size=3).round(2))) for k in range(n)]
    return spark.createDataFrame(rows, "modality string, patient_id string, specimen_id string, cell_id string, cell_type string, a double, b double, c double")


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_shuffled_rows_are_moved_once(spark):
    rows = cohort(spark).select("specimen_id", "cell_id", "a", "b", "c")
    mixed = sampling.shuffled_within(rows, ["specimen_id"], ["a", "b"], ["cell_id"], 7)
    assert exchanges(mixed) == 1 and mixed.columns == ["specimen_id", "cell_id", "c", "a", "b"]
    true, got = rows.collect(), mixed.collect()
    of = lambda found, s: [r for r in found if r.specimen_id == s]
    for s in {r.specimen_id for r in true}:
        want = sorted(of(true, s), key=lambda r: r.cell_id)
        drawn = [r[0] for r in rows.where(F.col("specimen_id") == s).orderBy(sampling.priority(["cell_id"], 7), "cell_id").select("cell_id").collect()]
        values = {r.cell_id: (r.a, r.b) for r in want}
        assert {r.cell_id: (r.a, r.b, r.c) for r in of(got, s)} == {w.cell_id: (*values[d], w.c) for w, d in zip(want, drawn, strict=True)}


def test_a_bank_moves_little_of_a_large_group(spark, monkeypatch):
    rows = spark.range(60_000).select(F.concat(F.lit("p"), F.when(F.col("id") < 59_950, 0).otherwise(1)).alias("patient_id"), F.col("id").cast("string").alias("cell_id"), (F.col("id") % 2).alias("fold"))
    seen, real = {}, sampling.kept
    monkeypatch.setattr(sampling, "kept", lambda frame, name: seen.setdefault(name, real(frame, name)))
    bank = {(r.fold, r.patient_id, r.cell_id) for r in sampling.balanced_bank(rows, "patient_id", 100, ["cell_id"], 3, within=["fold"]).collect()}
    want = set()
    for fold in (0, 1):
        of = rows.where(F.col("fold") == fold)
        some = [r for p in ("p0", "p1") for r in of.where(F.col("patient_id") == p).orderBy(sampling.priority(["cell_id"], 3), "cell_id").limit(50).collect()]
        trim = spark.createDataFrame(some, of.schema).orderBy(sampling.priority(["cell_id"], "3-trim"), "cell_id").limit(100).collect()
        want |= {(r.fold, r.patient_id, r.cell_id) for r in trim}
    assert bank == want and seen["bank"].count() < 1_000


def test_a_bank_of_rows_of_one_priority_is_whole(spark):
    rows = spark.range(20_000).select(F.lit("p").alias("patient_id"), F.lit("same").alias("cell_id"))
    assert sampling.balanced_bank(rows, "patient_id", 10, ["cell_id"], 1).count() == 10


def test_a_sweep_fits_scales_and_bank_once(spark, monkeypatch):
    drawn, scale, bank = [], runs.robust_scale, sampling.balanced_bank
    monkeypatch.setattr(runs, "robust_scale", lambda *a: drawn.append("scales") or scale(*a))
    monkeypatch.setattr(sampling, "balanced_bank", lambda *a, **b: drawn.append("bank") or bank(*a, **b))
    rows, spec = cohort(spark), runs.SameCell([], [], n_splits=3, bank=60, k=5)
    out = runs.sweep(rows, ["a", "b", "c"], ["a"], ["a", "b"], ["b"], spec)
    assert drawn == ["scales", "bank"] and exchanges(out) == 2
    got = {r.patient: r.skill for r in out.where("panel = 'upper'").collect()}
    one = runs.SameCell(["a", "b"], ["c"], n_splits=3, bank=60, k=5)
    want = {r.patient_id: r.skill for r in runs.scored(*runs.predictions(rows, one), one).groupBy("patient_id").agg(F.avg("skill").alias("skill")).collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-12 for p in want)


def test_a_replay_predicts_once(spark):
    spec = runs.SameCell(["a", "b"], ["c"], n_splits=3, bank=60, k=5, classes=["A", "B"])
    rows = cohort(spark)
    _, overall = runs.biology(rows, spec, 0)
    assert "ArrowEvalPython" not in overall._jdf.queryExecution().executedPlan().toString()  # neighbours are not asked again
    _, want = runs.biology_of(rows, runs.predictions(rows, spec, 0)[0], spec)
    key = lambda f: sorted((r.representation, r.patient_id, r.accuracy, r.macro_f1, r.macro_auprc) for r in f.collect())
    assert key(overall) == key(want) and len(key(want)) == 6
