"""Manifest validation over manifests that Spark derives from the tables, with faults planted by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import manifests, splits
from ..sources.cells import CELLS_SQL, cells, read
from .registry import query

FOLDS = 5


def _texts(frame: DataFrame, kind: str, **columns) -> DataFrame:
    """A manifest's columns, all strings, the ones not given blank."""
    return frame.select(*(F.coalesce(columns[c].cast("string"), F.lit("")).alias(c) if c in columns else F.lit("").alias(c) for c in manifests.COLUMNS[kind]))


def planted_bundle(spark, sf_dir: str) -> dict[str, DataFrame]:
    """Six manifests of the cell table's specimens. Faults go by the specimen's number s, the patient's p, the condition's n:

    data: s % 11 = 3 has an upper-case digest of its cells, 5 a visit that is no number, 7 is excluded in one modality
    without a reason, 9 is of another patient in one modality. splits: s % 13 = 4 is twice in fold 1. endpoints: p % 5 = 2
    has no known eligibility; nations without a specimen have endpoints as well. stress: n % 4 = 1 has a seed that is no
    number, 2 a digest that is none, 3 no level, and n % 10 = 0 stands twice.
    """
    rows = cells(spark, sf_dir)
    s, one = F.substring("specimen_id", 2, 20).cast("long"), F.col("modality") == "F"
    events = rows.groupBy("modality", "specimen_id", "patient_id").agg(F.count(F.lit(1)).alias("events"))
    source = F.concat(F.lit("cells/"), "modality", F.lit("/"), "specimen_id")
    digest = F.sha2(source, 256)
    text = F.lit("x")
    data = _texts(
        events, "data", dataset=F.lit("D"), pair=F.lit("OF"), modality=F.col("modality"), specimen_id=F.col("specimen_id"), patient_id=F.when((s % 11 == 9) & one, "x").otherwise(F.col("patient_id")),
        visit_id=text, collection_id=text, collection_date=F.lit("2024-01-31"), visit_order=F.when(s % 11 == 5, "one").otherwise("1"), source_path=source, source_sha256=digest, cells_path=source,
        cells_sha256=F.when(s % 11 == 3, F.upper(digest)).otherwise(digest), labels_path=text, labels_sha256=digest, metadata_source_id=text, metadata_sha256=digest, header_sha256=digest, total_events=F.col("events"),
        eligible_events=F.col("events"), event_selection_rule_id=text, preprocessing_id=text, upstream_label_selection=F.lit("false"), runtime_label_selection=F.lit("false"), claim_scope=text, pair_status=text,
        excluded=F.when((s % 11 == 7) & one, "true").otherwise("false"),
    )
    folds = splits.hashed_folds(rows, FOLDS, 31)
    again = folds.where((F.substring("specimen_id", 2, 20).cast("long") % 13 == 4) & (F.col("fold") == 1))
    split = _texts(folds.unionByName(again), "splits", dataset=F.lit("D"), pair=F.lit("OF"), evaluation_fold=F.col("fold"), role=F.col("role"), patient_id=F.col("patient_id"), specimen_id=F.col("specimen_id"))
    sides = rows.select("modality").distinct().crossJoin(F.broadcast(spark.createDataFrame([(d, m, k) for d in ("a_to_b", "b_to_a") for k, m in enumerate(("quantity", "discount"))], "direction string, marker string, k int")))
    markers = _texts(
        sides, "markers", dataset=F.lit("D"), direction=F.col("direction"), modality=F.col("modality"), canonical_marker=F.col("marker"), original_channel=F.col("marker"), role=F.lit("H"), analysis_role=F.lit("H"),
        channel_type=F.lit("biological"), marker_order=F.col("k"), panel_order=F.col("k"), analysis_order=F.col("k"), transformation=text, transformation_confidence=text, alias_rule=text, alias_evidence=text,
    )
    p = F.col("n_nationkey")
    endpoints = _texts(read(spark, sf_dir, "nation"), "endpoints", dataset=F.lit("D"), endpoint=F.lit("response"), patient_id=F.concat(F.lit("n"), p), visit_id=text, value=text, provenance=text, eligibility=F.when(p % 5 == 2, "maybe").otherwise("primary"))
    n = F.col("p_partkey")
    conditions = read(spark, sf_dir, "part").withColumn("twice", F.explode(F.when(n % 10 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    stress = _texts(
        conditions, "stress", condition_id=n, dataset=F.lit("D"), factor=text, level=F.when(n % 4 == 3, " ").otherwise("low"), seed=F.when(n % 4 == 1, "7.5").otherwise("7"), content_file=F.concat(F.lit("c"), n),
        content_sha256=F.when(n % 4 == 2, "none").otherwise(F.sha2(n.cast("string"), 256)),
    )
    return {"data": data, "splits": split, "markers": markers, "endpoints": endpoints, "banks": _texts(data.limit(0), "banks"), "stress": stress}


@query(f"""WITH {CELLS_SQL}, specimens AS (SELECT DISTINCT modality, specimen_id, patient_id, CAST(substr(specimen_id, 2) AS BIGINT) AS s FROM cells),
both_ AS (SELECT specimen_id, any_value(s) AS s, any_value(patient_id) AS patient_id, count(*) AS n, count(*) FILTER (modality = 'F') AS f FROM specimens GROUP BY specimen_id),
people AS (SELECT DISTINCT patient_id FROM specimens WHERE NOT (s % 11 = 9 AND modality = 'F') AND NOT (s % 11 = 7 AND modality = 'F')),
alone AS (SELECT count(*) AS x FROM both_ WHERE s % 11 = 9 AND f = 1), found AS (
SELECT 'data' AS "table", 'cells_sha256_is_no_digest' AS rule, (SELECT count(*) FROM specimens WHERE s % 11 = 3) AS n
UNION ALL SELECT 'data', 'source_differs_from_cells', (SELECT count(*) FROM specimens WHERE s % 11 = 3)
UNION ALL SELECT 'data', 'visit_order_is_no_integer', (SELECT count(*) FROM specimens WHERE s % 11 = 5)
UNION ALL SELECT 'data', 'exclusion_and_reason_disagree', (SELECT count(*) FROM specimens WHERE s % 11 = 7 AND modality = 'F')
UNION ALL SELECT 'data', 'exclusion_differs_between_modalities', (SELECT count(*) FROM both_ WHERE s % 11 = 7 AND f = 1 AND n = 2)
UNION ALL SELECT 'data', 'specimen_of_two_patients', (SELECT count(*) FROM both_ WHERE s % 11 = 9 AND f = 1 AND n = 2)
UNION ALL SELECT 'splits', 'row_repeated', (SELECT count(*) FROM both_ WHERE s % 13 = 4)
UNION ALL SELECT 'splits', 'patient_missing', (SELECT CASE WHEN x > 0 THEN 1 ELSE 0 END FROM alone)
UNION ALL SELECT 'endpoints', 'eligibility_unknown', (SELECT count(*) FROM nation WHERE n_nationkey % 5 = 2)
UNION ALL SELECT 'endpoints', 'patient_unknown', (SELECT count(*) FROM nation WHERE 'n' || n_nationkey NOT IN (SELECT patient_id FROM people))
UNION ALL SELECT 'stress', 'seed_is_no_integer', (SELECT sum(CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END)::BIGINT FROM part WHERE p_partkey % 4 = 1)
UNION ALL SELECT 'stress', 'content_is_no_digest', (SELECT sum(CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END)::BIGINT FROM part WHERE p_partkey % 4 = 2)
UNION ALL SELECT 'stress', 'level_is_blank', (SELECT sum(CASE WHEN p_partkey % 10 = 0 THEN 2 ELSE 1 END)::BIGINT FROM part WHERE p_partkey % 4 = 3)
UNION ALL SELECT 'stress', 'condition_repeated', (SELECT count(*) FROM part WHERE p_partkey % 10 = 0))
SELECT "table", rule, n FROM found WHERE n > 0""")
def manifest_faults(spark, sf_dir):
    """How often each rule is broken by manifests with planted faults; no other rule is."""
    bundle = planted_bundle(spark, sf_dir)
    found = manifests.violations(bundle, FOLDS).unionByName(manifests.stress_violations(bundle["stress"], bundle["data"]))
    return found.groupBy("table", "rule").agg(F.count(F.lit(1)).alias("n"))
