"""Rows of CSV files and their places, over files that Spark splits."""

import csv
import random

import pytest

from sparkpanel.sources import numbered, specimens


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000b")
    spark.conf.set("spark.sql.files.openCostInBytes", "100b")
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def write(path, head, data, bom=False, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write("﻿" if bom else "")
        out = csv.writer(f, lineterminator=end)
        out.writerow(head)
        out.writerows(data)


def table(n, seed):
    rng = random.Random(seed)
    return [[f"c{k}", f'say "{k}", then {rng.random()}' * rng.randint(1, 3), str(rng.random())] for k in range(n)]


def test_places_over_many_splits(spark, tmp_path, small_splits):
    data = {s: table(n, n) for s, n in (("a", 700), ("b b%", 1), ("c", 0), ("d", 90))}
    for s, rows in data.items():
        write(tmp_path / f"{s}.csv", ["id", "text, said", "x"], rows)
    assert spark.read.csv(str(tmp_path)).rdd.getNumPartitions() > 10
    got = numbered.rows(spark, str(tmp_path)).collect()
    assert sorted((r.specimen_id, r.row_idx, *r[2:]) for r in got) == sorted((s, k, *row) for s, rows in data.items() for k, row in enumerate(rows))
    assert {r.specimen_id: r.n for r in numbered.counts(spark, str(tmp_path)).collect()} == {s: len(rows) for s, rows in data.items() if rows}


def test_columns_in_the_order_asked_for(spark, tmp_path):
    write(tmp_path / "a.csv", ["x", "y`z", "w"], [["1", "2", "3"], ["4", "", "6"]], bom=True, end="\r\n")
    assert numbered.header(spark, str(tmp_path)) == ["x", "y`z", "w"]
    got = numbered.rows(spark, str(tmp_path), ["w", "y`z"]).orderBy("row_idx").collect()
    assert [tuple(r) for r in got] == [("a", 0, "3", "2"), ("a", 1, "6", None)]
    with pytest.raises(ValueError, match="no such columns"):
        numbered.rows(spark, str(tmp_path), ["q"])


def test_fields_with_line_ends(spark, tmp_path, small_splits):
    rows = [[f"c{k}", f"first\nsecond {k}"] for k in range(300)]
    write(tmp_path / "a.csv", ["id", "text"], rows)
    got = numbered.rows(spark, str(tmp_path), many_lines=True).orderBy("row_idx").collect()
    assert [(r.row_idx, r.id, r.text) for r in got] == [(k, *row) for k, row in enumerate(rows)]


def test_unlike_headers_short_rows_and_blank_lines(spark, tmp_path):
    (tmp_path / "ok").mkdir()
    (tmp_path / "ok" / "a.csv").write_text("x,y\n1,2\n\n3\n5,6,7\n")
    got = numbered.rows(spark, str(tmp_path / "ok")).orderBy("row_idx").collect()
    assert [tuple(r)[1:] for r in got] == [(0, "1", "2"), (1, "3", None), (2, "5", "6")]
    (tmp_path / "ok" / "b.csv").write_text("y,x\n1,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        numbered.rows(spark, str(tmp_path / "ok")).collect()


def test_scan_aligns_quoted_labels(spark, tmp_path, small_splits):
    root = tmp_path / "cytof"
    write(root / "cells" / "R1_1.csv", ["CD3", "note"], [[str(k / 2), 'a, "b"'] for k in range(900)])
    write(root / "labels" / "R1_1.csv", ["label"], [["Blast" if k % 2 else 'T cell, "x"'] for k in range(900)])
    got = specimens.scan(spark, str(tmp_path), "cytof", ["CD3"], drop_unmapped=False).orderBy("row_idx").collect()
    assert [(r.row_idx, r.CD3, r.fine_cell_type) for r in got] == [(k, k / 2, "Blast" if k % 2 else 'T cell, "x"') for k in range(900)]
    assert specimens.row_mismatches(spark, str(tmp_path), "cytof").count() == 0


def test_known_headers_are_not_looked_for(spark, tmp_path, monkeypatch):
    for s in ("a", "b"):
        (tmp_path / f"{s}.csv").write_text("x,y\n1,2\n3,4\n")
    jobs = []
    tracker, group = spark.sparkContext.statusTracker(), "known-header"
    spark.sparkContext.setJobGroup(group, group)
    try:
        numbered.counts(spark, str(tmp_path))
        jobs = list(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext._jsc.clearJobGroup()
    assert jobs == []
    assert sorted(tuple(r) for r in numbered.counts(spark, str(tmp_path)).collect()) == [("a", 2), ("b", 2)]
    rows = numbered.rows(spark, str(tmp_path), ["y"], header=["x", "y"])
    assert sorted(tuple(r) for r in rows.collect()) == [("a", 0, "2"), ("a", 1, "4"), ("b", 0, "2"), ("b", 1, "4")]
    with pytest.raises(Exception, match="(?i)header"):
        numbered.rows(spark, str(tmp_path), ["z"], header=["x", "z"]).collect()


def test_files_of_one_split_meet_no_join(spark, tmp_path):
    for k in range(3):
        write(tmp_path / "cells" / f"s {k}.csv", ["a", "b", "c"], table(5 + k, k))
    found = numbered.rows(spark, str(tmp_path / "cells"), ["a"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.specimen_id, r.row_idx, r.a) for r in found.collect()) == [(f"s {k}", i, f"c{i}") for k in range(3) for i in range(5 + k)]


def test_rows_of_a_split_are_counted_over_batches():
    import pyarrow as pa

    batch = lambda files, starts: pa.RecordBatch.from_arrays([pa.array(files), pa.array(starts, pa.int64())], names=["file", "start"])
    given = [batch(["/x/p.csv"] * 2, [0, 0]), batch(["/x/p.csv"] * 3, [0, 9, 9]), batch([], []), batch(["/x/p.csv", "/x/q%2B.csv"], [9, 0])]
    given[2] = pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64())], names=["file", "start"])
    out = [(r["specimen_id"], r["start"], r["at"]) for b in numbered._counted(numbered.NAMED, iter(given)) for r in b.to_pylist()]
    assert out == [("p", 0, 0), ("p", 0, 1), ("p", 0, 2), ("p", 9, 0), ("p", 9, 1), ("p", 9, 2), ("q+", 0, 0)]


def test_tasks_write_a_file_a_specimen(spark, tmp_path):
    from pyspark.sql import functions as F

    values = ['say "no", then', "plain", "", "b,c"]
    rows = spark.range(50_000).select(F.concat(F.lit("s"), F.when(F.col("id") < 40_000, 0).otherwise(F.col("id") % 7)).alias("specimen_id"), F.col("id"), F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("id") % 4 + 1).cast("int")).alias("label"), (F.col("id") / 8).alias("m"))
    specimens.write_files(rows.repartition("specimen_id").sortWithinPartitions("specimen_id", "id"), str(tmp_path / "out"), {"cells": ["id", "m"], "labels": ["label"]})
    assert {p.name for kind in ("cells", "labels") for p in (tmp_path / "out" / kind).iterdir()} == {f"s{k}.csv" for k in range(7)}
    cells, labels = (numbered.rows(spark, str(tmp_path / "out" / kind)) for kind in ("cells", "labels"))
    both = cells.join(labels, ["specimen_id", "row_idx"])
    assert both.count() == 50_000 and both.where(F.col("m").cast("double") * 8 != F.col("id").cast("long")).isEmpty()
    want = F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("id").cast("long") % 4 + 1).cast("int"))
    assert both.where(F.coalesce("label", F.lit("")) != want).isEmpty()
