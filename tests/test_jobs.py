"""The jobs: growing input, runs that fail in between, repeated runs, planted faults, command lines."""

import json
import logging
import os
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from jobs import corpus_manifest, registry, specimen_bank
from sparkpanel.operators import sampling
from sparkpanel.sources.cells import MEASURED, cells_of

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select(*sorted(frame.columns)).collect()), key=str)


def matches(spark, name):
    found = registry.queries()[name](spark, SF)
    con = duckdb.connect()
    for table in ("lineitem", "supplier", "documents", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    result = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    expected = [tuple(r[names.index(c)] for c in sorted(names)) for r in result.fetchall()]
    assert sorted(names) == sorted(found.columns)
    assert rows_of(found) == sorted(expected, key=str)
    return found


def test_bank_query_matches_sql(spark):
    assert matches(spark, "job1_specimen_bank").count() > 100


def test_manifest_query_matches_sql(spark):
    assert {r.part for r in matches(spark, "job2_corpus_manifest").select("part").distinct().collect()} == {"manifest", "audit"}


@pytest.fixture
def growing(spark, tmp_path):
    """A folder that parts of lineitem are copied to, and what a run over it needs."""
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").select(*[c.split()[0] for c in MEASURED.split(", ")])
    parts = [lines.where(F.pmod(F.xxhash64("l_orderkey"), F.lit(3)) == k) for k in range(3)]
    cells = str(tmp_path / "cells")

    def add(k):
        parts[k].coalesce(2).write.mode("append").parquet(cells)
        return parts[k].count()

    paths = {"cells": cells, "owners": f"{SF}/supplier.parquet", "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}
    return add, paths


def whole(spark, cells, size, seed):
    """The bank by the library's operator over everything at once."""
    rows = cells_of(spark.read.schema(MEASURED).parquet(cells), spark.read.parquet(f"{SF}/supplier.parquet"))
    return sampling.balanced_bank(rows.dropDuplicates(), "patient_id", size, specimen_bank.KEY, seed, within=["modality"]), rows


@pytest.mark.parametrize("size", [7, 150, 100_000])
def test_growing_input(spark, growing, caplog, size):
    add, paths = growing
    for k in range(3):
        n = add(k)
        with caplog.at_level(logging.INFO):
            told = specimen_bank.run(spark, **paths, size=size, seed="3", files_per_batch=1)
        assert told["read"] == n, "only the new files are read"
        bank, rows = whole(spark, paths["cells"], size, "3")
        assert rows_of(spark.read.parquet(f"{paths['output']}/bank").select(bank.columns)) == rows_of(bank)
        counts = rows.groupBy(*specimen_bank.LABELS).count().withColumnRenamed("count", "n")
        assert rows_of(spark.read.parquet(f"{paths['output']}/support").select(counts.columns)) == rows_of(counts)
        assert f"read {n} new rows" in caplog.text and f"bank: {told['bank']} rows" in caplog.text
    before = rows_of(specimen_bank.result(spark, paths["output"]))
    told = specimen_bank.run(spark, **paths, size=size, seed="3")
    assert told["read"] == 0 and rows_of(specimen_bank.result(spark, paths["output"])) == before


def test_failure_between_state_and_publishing(spark, growing, monkeypatch):
    """A run that dies after a batch's state, or before publishing, is mended by the next run without counting twice."""
    add, paths = growing
    add(0)
    specimen_bank.run(spark, **paths, size=50)
    add(1)
    take = specimen_bank.take

    def dies(*args):
        take(*args)
        raise RuntimeError("lost")

    monkeypatch.setattr(specimen_bank, "take", dies)
    with pytest.raises(Exception, match="lost"):
        specimen_bank.run(spark, **paths, size=50)
    monkeypatch.setattr(specimen_bank, "take", take)
    monkeypatch.setattr(specimen_bank, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        specimen_bank.run(spark, **paths, size=50)
    monkeypatch.undo()
    specimen_bank.run(spark, **paths, size=50)
    bank, rows = whole(spark, paths["cells"], 50, "17")
    assert rows_of(spark.read.parquet(f"{paths['output']}/bank").select(bank.columns)) == rows_of(bank)
    assert spark.read.parquet(f"{paths['output']}/support").agg(F.sum("n")).first()[0] == rows.count()


def test_cells_delivered_twice(spark, growing):
    add, paths = growing
    n = add(0)
    specimen_bank.run(spark, **paths, size=50)
    first = rows_of(spark.read.parquet(f"{paths['output']}/bank"))
    add(0)
    specimen_bank.run(spark, **paths, size=50)
    assert rows_of(spark.read.parquet(f"{paths['output']}/bank")) == first
    assert spark.read.parquet(f"{paths['output']}/support").agg(F.sum("n")).first()[0] == 2 * n


def test_no_files_at_all(spark, tmp_path):
    (tmp_path / "cells").mkdir()
    paths = {"cells": str(tmp_path / "cells"), "owners": f"{SF}/supplier.parquet", "output": str(tmp_path / "out"), "checkpoint": str(tmp_path / "mark")}
    assert specimen_bank.run(spark, **paths) == {"batch": -1, "read": 0, "bank": 0, "support": 0}


def corpus(spark, path, rows, labels):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.mode("overwrite").parquet(f"{path}/documents")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{path}/labels")
    return f"{path}/documents", f"{path}/labels"


def test_statuses_and_leaks(spark, tmp_path):
    sources = [f"s{k}" for k in range(12)]
    rows = [(k, f"text of {k}", "en", sources[k % 12]) for k in range(60)]
    rows += [(100 + k, "shared by all", "de", s) for k, s in enumerate(sources)] + [(200, "shared by all", "de", "s0")]
    rows += [(300, None, None, None), (301, " \n\t", "en", "s1"), (None, "no id", "en", "s2"), (302, "", "en", "s3"), (303, "twice", "en", "s4"), (303, "other", "en", "s5")]
    labels = [(0, 1, 0), (1, 0, 1), (2, 1, 0), (2, 0, 0), (3, 1, 0), (3, 1, 0), (9999, 1, 1), (None, 1, 1), (300, 1, 0)]
    documents, known = corpus(spark, tmp_path, rows, labels)
    out = str(tmp_path / "out")
    told = corpus_manifest.run(spark, documents, known, out, folds=4, seed="1")
    found = spark.read.parquet(f"{out}/manifest").collect()
    assert told == {"manifest": len(rows), "used": sum(r.status in ("labelled", "unlabelled") for r in found), "labels": len(labels), "audit": spark.read.parquet(f"{out}/audit").count()}
    assert len(found) == len(rows)
    fold = {}
    for r in found:
        assert fold.setdefault(r.source, r.fold) == r.fold, "a source is in one fold"
    used = [r for r in found if r.status in ("labelled", "unlabelled")]
    assert len({r.digest for r in used}) == len(used), "no text is used twice"
    status = {(r.doc_id, r.source): r.status for r in found}
    assert (status[0, "s0"], status[2, "s2"], status[3, "s3"], status[4, "s4"]) == ("labelled", "conflict", "labelled", "unlabelled")
    assert (status[300, ""], status[301, "s1"], status[302, "s3"], status[None, "s2"]) == ("no_text", "no_text", "no_text", "unnamed")
    for k, s in enumerate(sources):
        assert status[100 + k, s] == ("unlabelled" if k == 0 else "copy" if fold[s] == fold["s0"] else "leaks")
    assert status[200, "s0"] == "copy" and "leaks" in status.values()
    sums = {(r.source, r.lang): r for r in spark.read.parquet(f"{out}/audit").collect()}
    assert sum(r.documents for r in sums.values()) == len(rows) and sums["s1", "en"].toxic == 1 and sums["s0", "en"].good == 1


def test_repeated_runs_and_changes(spark, tmp_path):
    rows = [(k, f"text {k % 9} of {k % 4}", "en", f"s{k % 6}") for k in range(80)]
    documents, known = corpus(spark, tmp_path, rows, [(k, k % 2, 0) for k in range(40)])
    out = str(tmp_path / "out")
    corpus_manifest.run(spark, documents, known, out)
    first = rows_of(corpus_manifest.result(spark, out))
    corpus_manifest.run(spark, documents, known, out)
    assert rows_of(corpus_manifest.result(spark, out)) == first
    bundles = lambda: {r.source: r.bundle for r in spark.read.parquet(f"{out}/audit").collect()}
    before = bundles()
    changed = [(k, t + "!" if k == 5 else t, lang, s) for k, t, lang, s in rows]
    documents, known = corpus(spark, tmp_path, changed, [])
    corpus_manifest.run(spark, documents, known, out, folds=2)
    after = bundles()
    assert {s for s in after if after[s] != before[s]} == {"s5"}
    assert {r.fold for r in spark.read.parquet(f"{out}/manifest").select("fold").distinct().collect()} == {0, 1}, "no partition of the earlier run is left"


def test_empty_tables(spark, tmp_path):
    documents, known = corpus(spark, tmp_path, [], [])
    told = corpus_manifest.run(spark, documents, known, str(tmp_path / "out"))
    assert told == {"manifest": 0, "used": 0, "labels": 0, "audit": 0}


def test_settings_are_restored(spark):
    before = spark.conf.getAll if not callable(spark.conf.getAll) else spark.conf.getAll()
    registry.job2_corpus_manifest(spark, SF)
    assert (spark.conf.getAll if not callable(spark.conf.getAll) else spark.conf.getAll()) == before
    assert not spark.streams.active


@pytest.mark.parametrize(("name", "paths"), [("specimen_bank", {"cells": f"{SF}/lineitem.parquet", "owners": f"{SF}/supplier.parquet"}), ("corpus_manifest", {"documents": f"{SF}/documents.parquet", "labels": f"{SF}/labels.parquet"})])
def test_command_line(spark, tmp_path, name, paths):
    config = tmp_path / "config.json"
    config.write_text(json.dumps(json.loads(open(f"{ROOT}/jobs/{name}.json").read()) | {"seed": "8"}))
    paths = paths | {"output": str(tmp_path / "out")} | ({"checkpoint": str(tmp_path / "mark")} if name == "specimen_bank" else {})
    call = [sys.executable, "-m", f"jobs.{name}", str(config), *(x for k, v in paths.items() for x in (f"--{k}", v))]
    for _ in range(2):
        done = subprocess.run(call, cwd=ROOT, env=os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}, capture_output=True, text=True, timeout=300, check=False)
        assert done.returncode == 0, done.stderr[-2000:]
        assert f"jobs.{name}" in done.stderr and "wrote" in done.stderr
    assert spark.read.parquet(f"{tmp_path}/out/{'bank' if name == 'specimen_bank' else 'manifest'}").count() > 0


def test_jobs_import_nothing_of_the_text_operators():
    for name in os.listdir(f"{ROOT}/jobs"):
        if name.endswith(".py"):
            source = open(f"{ROOT}/jobs/{name}").read()
            assert "sparkpanel.llm" not in source and "corpus_pipeline" not in source
