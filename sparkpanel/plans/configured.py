"""Runs from a configuration file, and summaries over the documents that runs leave.

A configuration has experiment (name, runner, fold, seed), data (tables: a folder of the driver's tables, or root and
modalities of specimen files), options of its runner, and output.root. A run writes one result.json; a summary reads every
result.json below a folder, and raises where a run is missing or did not end well.
"""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import time
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import coarse_label
from ..operators import audit, bootstrap, models, som, splits, summaries
from ..sources import specimens
from ..sources.cells import MARKERS, cells
from ..sources.config import load, write_json, write_splits
from . import runs, saved, translation

KEYS = runs.KEYS


def hardware(spark: SparkSession) -> dict:
    """What a run had: Spark's version, master, cores at once and memory settings."""
    context = spark.sparkContext
    conf = context.getConf()
    return {"spark": context.version, "master": context.master, "parallelism": context.defaultParallelism, "executor_memory": conf.get("spark.executor.memory", ""), "driver_memory": conf.get("spark.driver.memory", "")}


def git_commit(path: str | Path) -> str | None:
    """The commit that a folder stands at; None outside of a repository."""
    try:
        done = subprocess.run(["git", "-C", str(path), "rev-parse", "HEAD"], capture_output=True, text=True, check=True)
    except (OSError, subprocess.CalledProcessError):
        return None
    return done.stdout.strip()


def repository_root(path: str | Path) -> Path:
    """The nearest folder above a file that holds a repository or project file, else the file's own folder."""
    start = Path(path).resolve().parent
    marks = (".git", "pyproject.toml")
    return next((p for p in (start, *start.parents) if any((p / m).exists() for m in marks)), start)


def absolute(config: dict, path: str | Path) -> dict:
    """config with its folders taken relative to the file's repository."""
    root = repository_root(path)
    out = json.loads(json.dumps(config))
    for section, key in (("data", "tables"), ("data", "root"), ("output", "root")):
        place = out.get(section, {}).get(key)
        if place and "://" not in place and not os.path.isabs(place):
            out[section][key] = str(root / place)
    return out


def read_cells(spark: SparkSession, config: dict) -> DataFrame:
    """patient_id, specimen_id, modality, cell_id, cell_type and markers."""
    data = config["data"]
    if "tables" in data:
        return cells(spark, data["tables"])
    out = None
    for modality in data["modalities"]:
        part = specimens.scan(spark, data["root"], modality, data["markers"])
        part = part.withColumn("cell_id", F.col("row_idx").cast("string"))
        if most := data.get("max_cells_per_specimen"):
            part = specimens.sampled(part, int(most), data.get("sample_seed", 4207))
        part = part.select("patient_id", "specimen_id", "modality", "cell_id", "cell_type", *(F.col(m).cast("double").alias(m) for m in data["markers"]))
        out = part if out is None else out.unionByName(part)
    return out


def _rows(frame: DataFrame) -> list[dict]:
    """Rows of a table of scores: a row a marker, patient, specimen or panel."""
    return [json.loads(r[0]) for r in frame.select(F.to_json(F.struct(*frame.columns), {"ignoreNullFields": "false"})).collect()]


def _spec(config: dict) -> runs.SameCell:
    o = config["options"]
    return runs.SameCell(o["observed"], o["hidden"], o.get("n_splits", 5), config["experiment"]["seed"], bank=o.get("bank", 50_000), k=o.get("k", 50), classes=o.get("classes", []))


def _same_cell(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Every method of the grid on the same test cells: fit medians, neighbours, and a network. With options.classes, what a
    classifier of cell types makes of true and of hybrid cells besides."""
    rows, spec, fold = read_cells(spark, config), _spec(config), config["experiment"]["fold"]
    predicted, scales = runs.predictions(rows, spec, fold)
    methods = {"knn": predicted, "median": predicted.withColumns({f"predicted_{m}": F.col(f"null_{m}") for m in spec.hidden})}
    if "mlp" in config["options"].get("methods", ["median", "knn", "mlp"]):
        held = splits.hashed_folds(rows, spec.n_splits, spec.seed).where((F.col("fold") == fold) & (F.col("role") != "test")).select("specimen_id").distinct()
        net = models.fit_network(rows.join(F.broadcast(held), "specimen_id", "leftsemi"), spec.observed, spec.hidden, "patient_id", **config["options"].get("mlp", {}), seed=spec.seed)
        methods["mlp"] = models.predict_network(predicted.drop(*(f"predicted_{m}" for m in spec.hidden)), net, spec.observed, spec.hidden)
    wanted = config["options"].get("methods", list(methods))
    scored = {name: runs.scored(methods[name], scales, spec).withColumn("representation", F.lit(name)) for name in wanted}
    out = None
    for one in scored.values():
        out = one if out is None else out.unionByName(one)
    panel = F.lit(config["options"].get("panel", "panel"))
    tables = {"markers": out.withColumn("panel", panel)}
    if spec.classes:
        per, overall = runs.biology_of(rows, predicted, spec, ["modality"])
        tables |= {"biology": overall.withColumn("panel", panel), "biology_per_class": per.withColumn("panel", panel)}
    return tables


def _sweep(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    o = config["options"]
    spec = runs.SameCell([], [], o.get("n_splits", 5), config["experiment"]["seed"], bank=o.get("bank", 50_000), k=o.get("k", 50))
    return {"panels": runs.sweep(read_cells(spark, config), o["markers"], o["base"], o["upper"], o["added"], spec)}


def _sides(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame, DataFrame, runs.CrossPanel]:
    o, rows = config["options"], read_cells(spark, config)
    spec = runs.CrossPanel(o["shared"], o["source_only"], o["target_only"], tuple(o.get("alphas", (0.0, 0.25, 0.5, 0.75, 1.0))), config["experiment"]["seed"], least=o.get("least", 32), epochs=o.get("epochs", 30))
    base = ["patient_id", "specimen_id", "cell_id", "cell_type", *spec.shared]
    source = rows.where(F.col("modality") == o["source"]).select(*base, *spec.source_only)
    target = rows.where(F.col("modality") == o["target"]).select(*base, *spec.target_only)
    roles = splits.hashed_folds(rows, o.get("n_splits", 5), config["experiment"]["seed"]).where(F.col("fold") == config["experiment"]["fold"]).select("specimen_id", "role")
    return source, target, roles, spec


def _cross_panel(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """A split's gate and scores; with options.paired_counts its methods and views at each number of paired specimens."""
    counts = config["options"].get("paired_counts")
    return runs.cross_panel(*_sides(spark, config)) if counts is None else runs.paired_curve(*_sides(spark, config), list(counts), config["options"].get("k", 50))


def _translation(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Fits a whole translation and saves it below the output folder, for `predict`."""
    model = saved.Translator.fit(*_sides(spark, config))
    model.save(f"{config['output']['root']}/{config['experiment']['name']}/fold_{config['experiment']['fold']}/seed_{config['experiment']['seed']}/model")
    return {"gates": spark.createDataFrame(list(model.gates.items()), "marker string, alpha double")}


def predict(spark: SparkSession, path: str | Path, model: str, out: str) -> int:
    """Predictions of a saved translation for the source cells of a configuration, as Parquet by patient; the rows written."""
    config = absolute(load(path), path)
    rows = read_cells(spark, config).where(F.col("modality") == config["options"]["source"])
    saved.Translator.load(spark, model).predict(rows).write.mode("overwrite").partitionBy("patient_id").parquet(out)
    return spark.read.parquet(out).count()


def _probe(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    per, overall = translation.probe_fold(*_sides(spark, config), config["options"]["classes"], config["options"].get("paired_patients", "all"))
    return {"per_class": per, "overall": overall}


def _literature(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Draws from a self-organising map over reference cells, scored like the other methods."""
    rows, spec, fold = read_cells(spark, config), _spec(config), config["experiment"]["fold"]
    predicted, scales = runs.predictions(rows, spec, fold)
    held = splits.hashed_folds(rows, spec.n_splits, spec.seed).where((F.col("fold") == fold) & (F.col("role") != "test")).select("specimen_id").distinct()
    drawn = som.draw(predicted.drop(*(f"predicted_{m}" for m in spec.hidden)), rows.join(F.broadcast(held), "specimen_id", "leftsemi"), spec.observed, spec.hidden, ["modality", *KEYS])
    coverage = drawn.groupBy("modality", "specimen_id").agg(F.avg((~F.col("abstained")).cast("double")).alias("coverage"))
    scored = runs.scored(drawn.where("not abstained"), scales, spec)
    return {"markers": scored.withColumns({"representation": F.lit("som"), "method": F.lit("som"), "panel": F.lit(config["options"].get("panel", "panel"))}), "coverage": coverage}


def _cache(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """Frozen rows of a seed, written as a cache."""
    data, seed = config["data"], config["experiment"]["seed"]
    every = None
    for modality in data["modalities"]:
        part = specimens.scan(spark, data["root"], modality, data["markers"])
        every = part if every is None else every.unionByName(part)
    counts = every.groupBy("modality", "specimen_id").agg((F.max("row_idx") + 1).alias("eligible_events"))
    frozen = specimens.frozen_rows(counts, int(data.get("max_cells_per_specimen", 50_000)), [seed])
    specimens.write_cache(every, frozen, f"{config['output']['root']}/cache", seed)
    return {"rows": frozen.groupBy("modality", "specimen_id").agg(F.count(F.lit(1)).alias("rows"))}


def audit_tables(rows: DataFrame, least: int, low: int, n_splits: int, seed: int) -> dict[str, DataFrame]:
    """The tables of an audit: specimens, modalities, labels, folds, and broken rules of folds."""
    events = rows.groupBy("modality", "specimen_id").agg(F.count(F.lit(1)).alias("events"))
    pairing = audit.inventory(events, least, low)
    folds = splits.hashed_folds(rows, n_splits, seed)
    labels = audit.label_profile(rows.withColumn("coarse", F.coalesce(coarse_label(F.col("cell_type")), F.col("cell_type"))), "coarse", "cell_type")
    return {"specimens": pairing, "modalities": audit.modality_rollup(events, pairing), "labels": labels, "splits": folds, "violations": splits.violations(folds, n_splits)}


def read_annotations(spark: SparkSession, sources: dict[str, str], endpoints: list[str]) -> DataFrame:
    """source, specimen_id, endpoint, value of annotation tables, by name of the source: CSV files with specimen_id and a
    column an endpoint; an endpoint that a source lacks has no rows of it."""
    out = None
    for name, path in sources.items():
        table = spark.read.option("header", True).csv(path)
        held = [e for e in endpoints if e in table.columns]
        part = table.select(F.trim("specimen_id").alias("specimen_id"), *held).unpivot(["specimen_id"], held, "endpoint", "value")
        part = part.select(F.lit(name).alias("source"), "specimen_id", "endpoint", F.trim("value").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


def endpoint_tables(annotations: DataFrame, specimens_: DataFrame, folds: DataFrame, options: dict) -> dict[str, DataFrame]:
    """endpoint_records, endpoint_support (with eligibility) and endpoint_conflicts: values that sources or specimens of a
    patient disagree about, and specimens that a source names twice."""
    positive, negative = options.get("positive", "1"), options.get("negative", "0")
    found = audit.reconcile(annotations, specimens_, options["names"])
    status = audit.patient_status(found)
    support = audit.endpoint_support(status, folds, positive, negative)
    eligible = audit.endpoint_eligibility(support, status, positive, negative, options.get("least_total", 10), options.get("least_test", 1))
    text = lambda c: F.col(c).cast("string").alias(c)
    no = lambda c: F.lit(None).cast("string").alias(c)
    clashes = found.where(F.col("value") == audit.CONFLICT).select(F.lit("sources_disagree").alias("conflict"), text("patient_id"), text("specimen_id"), text("endpoint"))
    patients = status.where(F.col("status") == audit.CONFLICT).select(F.lit("patient_disagrees").alias("conflict"), text("patient_id"), no("specimen_id"), text("endpoint"))
    wide = annotations.groupBy("source", "specimen_id", "endpoint").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = wide.select(F.concat(F.lit("named_twice_by_"), "source").alias("conflict"), no("patient_id"), text("specimen_id"), text("endpoint"))
    return {"endpoint_records": audit.endpoint_records(found, status), "endpoint_support": support.join(eligible, "endpoint", "left"), "endpoint_conflicts": clashes.unionByName(patients).unionByName(twice)}


def _audit(spark: SparkSession, config: dict) -> dict[str, DataFrame]:
    """All tables of an audit, each written as CSV beside the document, with the nested split manifest, a summary of what
    blocks a frozen protocol, and a digest of every file of the bundle.

    options: source and target (modalities: marker roles and banks), bank_cap, seeds; endpoints (sources, names, positive,
    negative, least_total, least_test).
    """
    o, out, seed = config.get("options", {}), config["output"]["root"], config["experiment"]["seed"]
    rows = read_cells(spark, config)
    n_splits = o.get("n_splits", 5)
    tables = audit_tables(rows, o.get("least_events", 1), o.get("low_events", 100), n_splits, seed)
    if "source" in o:
        sides = [o["source"], o["target"]]
        columns = [c for c in rows.columns if c not in ("patient_id", "specimen_id", "modality", "cell_id", "cell_type")]
        panels = spark.createDataFrame([(m, c, k) for m in sides for k, c in enumerate(o.get("channels", {}).get(m, columns))], "modality string, original_channel string, ordinal int")
        events = rows.groupBy("modality", "specimen_id").agg(F.count(F.lit(1)).alias("eligible_events"))
        tables["markers"] = audit.marker_roles(panels, *sides)
        tables["marker_duplicates"] = audit.duplicate_markers(panels)
        tables["banks"] = audit.reference_banks(tables["splits"], events, [tuple(sides), tuple(sides[::-1])], o.get("seeds", [seed]), o.get("bank_cap", 50_000))
    if "endpoints" in o:
        people = rows.select("specimen_id", "patient_id").distinct()
        tables |= endpoint_tables(read_annotations(spark, o["endpoints"]["sources"], o["endpoints"]["names"]), people, tables["splits"], o["endpoints"])
    for name, frame in tables.items():
        specimens.write_csv(frame.withColumns({c: F.array_join(c, "|") for c, kind in frame.dtypes if kind.startswith("array")}), f"{out}/audit/{name}")
    write_splits([tuple(r) for r in tables["splits"].select("fold", "role", "patient_id", "specimen_id").collect()], f"{out}/audit/split_manifest.json")  # a row a fold and specimen
    sizes = {name: spark.read.option("header", True).csv(f"{out}/audit/{name}").count() for name in tables}
    blockers = [name for name in ("violations", "marker_duplicates", "endpoint_conflicts") if sizes.get(name)]
    write_json({"tables": sizes, "unresolved_blockers": blockers}, f"{out}/audit/audit_summary.json")
    files = specimens.file_digests(spark, f"{out}/audit").where("path like '%.csv' or path like '%.json'")
    summary = spark.createDataFrame(list(sizes.items()), "name string, rows long")
    return {"modalities": tables["modalities"], "tables": summary, "bundle": audit.bundle_digest(files.withColumn("path", F.regexp_extract("path", "audit/(.*)$", 1)))}


RUNNERS: dict[str, Callable[[SparkSession, dict], dict[str, DataFrame]]] = {
    "same_cell": _same_cell, "addback_sweep": _sweep, "cross_panel": _cross_panel, "translation": _translation, "cell_type_probe": _probe, "literature": _literature, "cache": _cache, "audit": _audit,
}


def run(spark: SparkSession, path: str | Path, **over: int) -> dict:
    """Runs a configuration file (over: fold, seed) and writes <output>/<name>/fold_<f>/seed_<s>/result.json."""
    config = absolute(load(path), path)
    experiment = config["experiment"] = {"fold": 0, "seed": 4207, **config["experiment"], **{k: v for k, v in over.items() if v is not None}}
    if experiment["runner"] not in RUNNERS:
        raise ValueError(f"runner is one of {sorted(RUNNERS)}")
    began = time.time()
    tables = {name: _rows(frame) for name, frame in RUNNERS[experiment["runner"]](spark, config).items()}
    document = {"status": "ok", **experiment, "elapsed_seconds": round(time.time() - began, 3), "config_sha256": hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest(), "hardware": hardware(spark), "git_commit": git_commit(Path(path).resolve().parent), "results": tables}
    target = Path(config["output"]["root"]) / experiment["name"] / f"fold_{experiment['fold']}" / f"seed_{experiment['seed']}" / "result.json"
    write_json(document, target)
    return {k: v for k, v in document.items() if k != "results"} | {"result_path": str(target)}


def documents(spark: SparkSession, root: str, folds: int | None = None, seeds: int | None = None) -> DataFrame:
    """Every result.json below a folder. Raises on none, on one that is not ok, on repeats, and on too few of a grid."""
    found = spark.read.option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").json(root)
    if found.isEmpty():
        raise ValueError(f"no runs below {root}")
    if not found.where("status <> 'ok'").isEmpty():
        raise ValueError("a run did not end well")
    key = ["name", "runner", "fold", "seed"]
    if not summaries.duplicate_keys(found, key).isEmpty():
        raise ValueError("a run is there twice")
    short = found.groupBy("name", "runner").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") != (folds or 0) * (seeds or 1))
    if folds and not short.isEmpty():
        raise ValueError(f"{folds} folds by {seeds or 1} seeds are needed")
    return found


def results(found: DataFrame, table: str) -> DataFrame:
    """The rows of a table of results, with name, fold and seed."""
    rows = found.select("name", "fold", "seed", F.explode(f"results.{table}").alias("x"))
    return rows.select("name", F.col("fold").alias("run_fold"), "seed", "x.*")


def summarize(spark: SparkSession, kind: str, root: str, folds: int | None = None, seeds: int | None = None, replicates: int = bootstrap.REPLICATES) -> dict[str, DataFrame]:
    """Tables of a kind of summary: runs, same_cell, addback_sweep, paired_curve, literature, cell_type_probe."""
    found = documents(spark, root, folds, seeds)
    if kind == "runs":
        return {"runs": found.groupBy("name", "runner").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("elapsed_seconds").alias("elapsed_seconds_mean"))}
    if kind == "same_cell":
        per = summaries.patient_means(results(found, "markers").withColumnRenamed("patient_id", "patient"), ["modality", "panel", "representation", "marker", "patient"], ["skill", "spearman", "normalized_mae"])
        out = {"markers": bootstrap.summarize(per, ["modality", "panel", "representation", "marker"], ["skill", "spearman", "normalized_mae"], replicates=replicates)}
        return out | biology_summary(found, replicates) if "biology" in found.select("results.*").columns else out
    if kind == "addback_sweep":
        rows = results(found, "panels")
        rows = rows if "added_marker" in rows.columns else rows.withColumn("added_marker", F.lit(None).cast("string"))
        return {"effects": summaries.paired_effects(summaries.patient_means(rows, ["modality", "panel", "panel_kind", "added_marker", "marker", "patient"], ["skill"]), ["marker"], ["skill"], "base", "upper", replicates)}
    if kind == "paired_curve":
        return paired_curve_summary(found)
    if kind == "literature":
        rows = results(found, "markers").withColumnRenamed("patient_id", "patient")
        key = ["modality", "panel", "run_fold", "seed"]
        own = rows.where("representation = 'som'").withColumn("method", F.lit("som"))
        union = summaries.literature_union(rows.where("representation <> 'som'").drop("method"), own.select(*[c for c in own.columns]), key) if not own.isEmpty() else None
        if union is None:
            raise ValueError("no literature run")
        return {"methods": bootstrap.summarize(summaries.patient_means(union, ["modality", "panel", "method", "patient"], ["skill"]), ["modality", "panel", "method"], ["skill"], replicates=replicates)}
    if kind == "cell_type_probe":
        rows = results(found, "overall").withColumnRenamed("run_fold", "fold")
        return {"overall": translation.probe.summarize(rows, "source_h", "macro_f1", folds or rows.select("fold").distinct().count(), replicates)}
    raise ValueError(f"no such summary: {kind}")


BIOLOGY = ["accuracy", "balanced_accuracy", "macro_f1", "macro_auprc"]


def biology_summary(found: DataFrame, replicates: int) -> dict[str, DataFrame]:
    """biology: patient-first means of each representation with intervals; retention: how much of what true cells have over
    cells with medians the predictions keep."""
    rows = results(found, "biology").withColumnRenamed("patient_id", "patient")
    per = summaries.patient_means(rows, ["modality", "panel", "representation", "patient"], BIOLOGY)
    return {"biology": bootstrap.summarize(per, ["modality", "panel", "representation"], BIOLOGY, replicates=replicates), "retention": summaries.retention(per, ["knn"], BIOLOGY)}


def paired_curve_summary(found: DataFrame) -> dict[str, DataFrame]:
    """Over runs with paired counts, on their stratified view: the score by count, its trend, the least count that beats
    each method without pairs, and whether the paired specimens of every run are nested. Counts are numbers of specimens.
    """
    rows = results(found, "evaluation").where("view = 'stratified'").withColumn("score", F.col("patient_first_w1"))
    curve = rows.where("method = 'gated'").withColumn("count", F.col("count").cast("int"))
    runs_of = curve.groupBy("name", "run_fold", "seed").agg(F.sort_array(F.collect_set("count")).alias("counts"))
    if runs_of.select("counts").distinct().count() != 1:
        raise ValueError("runs have no or unlike paired counts")
    baselines = rows.where("method <> 'gated'").select(F.col("method").alias("baseline"), F.col("score").alias("value"))
    subsets = results(found, "paired").select("name", "run_fold", "seed", F.col("count").cast("int").alias("count"), "specimen_id")
    return {
        "curve": summaries.run_means(curve, ["name", "count"], ["score"]),
        "trend": summaries.curve_trend(curve, ["name"]),
        "first_below": summaries.first_below(curve, baselines),
        "nested": summaries.nested(subsets, ["name", "run_fold", "seed"]),
    }


def write_markers(markers: list[str], path: str | Path) -> None:
    """One marker a line."""
    Path(path).write_text("".join(f"{m}\n" for m in markers), encoding="utf-8")


__all__ = ["MARKERS", "RUNNERS", "absolute", "audit_tables", "documents", "git_commit", "hardware", "predict", "read_cells", "repository_root", "results", "run", "summarize", "write_markers"]
