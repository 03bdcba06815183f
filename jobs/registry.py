"""The jobs as queries: each runs twice into a new folder and returns what stands there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import corpus_manifest, specimen_bank
from sparkpanel.sources.cells import CELLS_SQL
from sparkpanel.sources.shared import new_folder

SIZE, BANK_SEED, FOLDS, FOLD_SEED = 2000, "17", 5, "23"


def job1_specimen_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    for _ in range(2):
        specimen_bank.run(spark, f"{sf_dir}/lineitem.parquet", f"{sf_dir}/supplier.parquet", f"{folder}/out", f"{folder}/checkpoint", SIZE, BANK_SEED)
    return specimen_bank.result(spark, f"{folder}/out")


def job2_corpus_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job2")
    for _ in range(2):
        corpus_manifest.run(spark, f"{sf_dir}/documents.parquet", f"{sf_dir}/labels.parquet", folder, FOLDS, FOLD_SEED)
    return corpus_manifest.result(spark, folder)


QUERIES = {"job1_specimen_bank": job1_specimen_bank, "job2_corpus_manifest": job2_corpus_manifest}
ORACLE_SQL = {
    "job1_specimen_bank": f"""WITH {CELLS_SQL}, once AS (
  SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY modality, specimen_id, cell_id ORDER BY cell_type, quantity, extendedprice, discount, tax) = 1
), quota AS (
  SELECT modality, CASE WHEN count(*) <= {SIZE} THEN count(*) ELSE CAST(ceil({SIZE} / count(DISTINCT patient_id)) AS BIGINT) END AS q FROM once GROUP BY modality
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY modality, patient_id ORDER BY md5(specimen_id || '~' || cell_id || '~{BANK_SEED}'), specimen_id, cell_id) AS k FROM once
), kept AS (
  SELECT numbered.* FROM numbered JOIN quota USING (modality) WHERE k <= q
), bank AS (
  SELECT * FROM kept QUALIFY row_number() OVER (PARTITION BY modality ORDER BY md5(specimen_id || '~' || cell_id || '~{BANK_SEED}-trim'), specimen_id, cell_id) <= {SIZE}
)
SELECT b.modality, b.patient_id, b.specimen_id, b.cell_id, b.cell_type, b.quantity, b.extendedprice, b.discount, b.tax, s.n AS specimen_cells, l.n AS label_cells FROM bank b
JOIN (SELECT modality, specimen_id, count(*) AS n FROM cells GROUP BY ALL) s ON b.modality = s.modality AND b.specimen_id = s.specimen_id
JOIN (SELECT modality, specimen_id, cell_type, count(*) AS n FROM cells GROUP BY ALL) l ON b.modality = l.modality AND b.specimen_id = l.specimen_id AND b.cell_type = l.cell_type""",
    "job2_corpus_manifest": rf"""WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, sha256(text) AS digest, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars,
    text IS NULL OR regexp_full_match(text, '[ \t\n\x0B\f\r]*') AS blank FROM documents
), places AS (
  SELECT source, CAST((row_number() OVER (ORDER BY md5(source || '~{FOLD_SEED}'), source) - 1) % {FOLDS} AS INTEGER) AS fold FROM (SELECT DISTINCT source FROM docs)
), placed AS (
  SELECT d.*, p.fold FROM docs d JOIN places p ON d.source = p.source
), copies AS (
  SELECT digest, min(doc_id) AS copy_of FROM placed WHERE doc_id IS NOT NULL AND digest IS NOT NULL GROUP BY digest HAVING count(*) > 1
), homes AS (
  SELECT c.digest, c.copy_of, min(p.fold) AS home FROM copies c JOIN placed p ON p.digest = c.digest AND p.doc_id = c.copy_of GROUP BY ALL
), known AS (
  SELECT doc_id, min(quality) AS quality, min(toxic) AS toxic, min(quality) <> max(quality) OR min(toxic) <> max(toxic) AS conflict FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), judged AS (
  SELECT p.fold, p.doc_id, p.source, p.lang, p.digest, p.n_chars, h.copy_of,
    CASE WHEN p.doc_id IS NULL THEN 'unnamed' WHEN p.blank THEN 'no_text' WHEN h.copy_of <> p.doc_id AND h.home <> p.fold THEN 'leaks' WHEN h.copy_of <> p.doc_id THEN 'copy'
      WHEN k.conflict THEN 'conflict' WHEN k.doc_id IS NOT NULL THEN 'labelled' ELSE 'unlabelled' END AS status, k.quality, k.toxic
  FROM placed p LEFT JOIN homes h ON p.digest = h.digest LEFT JOIN known k ON p.doc_id = k.doc_id
)
SELECT 'manifest' AS part, fold, doc_id, source, lang, digest, n_chars, copy_of, status, quality, CAST(toxic AS BIGINT) AS toxic,
  NULL::BIGINT AS documents, NULL::BIGINT AS used, NULL::BIGINT AS labelled, NULL::BIGINT AS good, NULL::VARCHAR AS bundle FROM judged
UNION ALL
SELECT 'audit', fold, NULL, source, lang, NULL, CAST(sum(n_chars) AS BIGINT), NULL, NULL, NULL, count(*) FILTER (WHERE status = 'labelled' AND toxic = 1),
  count(*), count(*) FILTER (WHERE status IN ('labelled', 'unlabelled')), count(*) FILTER (WHERE status = 'labelled'), count(*) FILTER (WHERE status = 'labelled' AND quality = 1),
  CAST(coalesce(sum(CAST('0x' || substr(digest, 1, 15) AS BIGINT)), 0) AS VARCHAR) FROM judged GROUP BY fold, source, lang""",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
