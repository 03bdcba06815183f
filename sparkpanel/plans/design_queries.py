"""Queries of sampling, splits, neighbours, names, audits and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names
from ..operators import audit, knn, models, sampling, splits, summaries
from ..sources.cells import CELLS_SQL, cells, read
from .registry import query
from .statistics_queries import rounded

KEYS = ["specimen_id", "cell_id"]


@query(f"""WITH {CELLS_SQL} SELECT modality, specimen_id, cell_id, quantity FROM cells
QUALIFY row_number() OVER (PARTITION BY modality, specimen_id ORDER BY md5(specimen_id || '~' || cell_id || '~4207'), specimen_id, cell_id) <= 20""")
def reservoir_topk(spark, sf_dir):
    rows = sampling.reservoir(cells(spark, sf_dir), ["modality", "specimen_id"], 20, KEYS, 4207)
    return rows.select("modality", "specimen_id", "cell_id", "quantity")


@query(f"""WITH {CELLS_SQL}, t AS (SELECT * FROM cells WHERE modality = 'O'), quota AS (SELECT CASE WHEN count(*) <= 500 THEN count(*) ELSE CAST(ceil(500 / count(DISTINCT patient_id)) AS BIGINT) END AS q FROM t),
numbered AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY md5(specimen_id || '~' || cell_id || '~11'), specimen_id, cell_id) AS k FROM t),
kept AS (SELECT * FROM numbered WHERE k <= (SELECT q FROM quota))
SELECT patient_id, specimen_id, cell_id FROM kept ORDER BY md5(specimen_id || '~' || cell_id || '~11-trim'), specimen_id, cell_id LIMIT 500""")
def balanced_bank(spark, sf_dir):
    return sampling.balanced_bank(cells(spark, sf_dir).where("modality = 'O'"), "patient_id", 500, KEYS, 11).select("patient_id", "specimen_id", "cell_id")


@query(f"""WITH {CELLS_SQL}, t AS (SELECT * FROM cells WHERE modality = 'F'), quota AS (SELECT cell_type, CASE WHEN count(*) <= 150 THEN count(*) ELSE CAST(ceil(150 / count(DISTINCT patient_id)) AS BIGINT) END AS q FROM t GROUP BY cell_type),
numbered AS (SELECT *, row_number() OVER (PARTITION BY cell_type, patient_id ORDER BY md5(specimen_id || '~' || cell_id || '~12'), specimen_id, cell_id) AS k FROM t),
kept AS (SELECT numbered.* FROM numbered JOIN quota USING (cell_type) WHERE k <= q)
SELECT cell_type, patient_id, specimen_id, cell_id FROM kept QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY md5(specimen_id || '~' || cell_id || '~12-trim'), specimen_id, cell_id) <= 150""")
def class_balanced_rows(spark, sf_dir):
    return sampling.class_balanced(cells(spark, sf_dir).where("modality = 'F'"), "cell_type", "patient_id", 150, KEYS, 12).select("cell_type", "patient_id", "specimen_id", "cell_id")


@query(f"""WITH {CELLS_SQL}, a AS (SELECT *, row_number() OVER (PARTITION BY specimen_id, cell_type ORDER BY md5(specimen_id || '~' || cell_id || '~13'), specimen_id, cell_id) AS k FROM cells)
SELECT cell_type, specimen_id, cell_id FROM a WHERE k <= 10 QUALIFY row_number() OVER (PARTITION BY cell_type ORDER BY md5(specimen_id || '~' || cell_id || '~13-total'), specimen_id, cell_id) <= 200""")
def probe_training_rows(spark, sf_dir):
    return sampling.probe_rows(cells(spark, sf_dir), "specimen_id", "cell_type", 10, 200, KEYS, 13).select("cell_type", "specimen_id", "cell_id")


@query(f"""WITH {CELLS_SQL}, a AS (SELECT specimen_id, cell_id, quantity, row_number() OVER (PARTITION BY specimen_id ORDER BY specimen_id, cell_id) AS k FROM cells),
b AS (SELECT specimen_id, extendedprice, row_number() OVER (PARTITION BY specimen_id ORDER BY md5(specimen_id || '~' || cell_id || '~14'), specimen_id, cell_id) AS k FROM cells)
SELECT specimen_id, cell_id, quantity, extendedprice FROM a JOIN b USING (specimen_id, k)""")
def shuffled_control(spark, sf_dir):
    rows = cells(spark, sf_dir).select("specimen_id", "cell_id", "quantity", "extendedprice")
    return sampling.shuffled_within(rows, ["specimen_id"], ["extendedprice"], KEYS, 14)


@query(f"""WITH {CELLS_SQL}, bank AS (SELECT * FROM cells WHERE modality = 'F'), p AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT patient_id FROM bank)),
s AS (SELECT patient_id, specimen_id, row_number() OVER (PARTITION BY patient_id ORDER BY specimen_id) - 1 AS i, count(*) OVER (PARTITION BY patient_id) AS n FROM (SELECT DISTINCT patient_id, specimen_id FROM bank)),
c AS (SELECT specimen_id, cell_id, extendedprice, row_number() OVER (PARTITION BY specimen_id ORDER BY specimen_id, cell_id) - 1 AS i, count(*) OVER (PARTITION BY specimen_id) AS n FROM bank),
q AS (SELECT cell_id AS query_id, CAST('0x' || substr(md5(cell_id || '~9-patient'), 1, 8) AS BIGINT) % 2147483648 AS u, CAST('0x' || substr(md5(cell_id || '~9-specimen'), 1, 8) AS BIGINT) % 2147483648 AS v, CAST('0x' || substr(md5(cell_id || '~9-cell'), 1, 8) AS BIGINT) % 2147483648 AS w
  FROM cells WHERE modality = 'O')
SELECT query_id, s.specimen_id, c.cell_id, c.extendedprice FROM q JOIN p ON p.i = u % p.n JOIN s ON s.patient_id = p.patient_id AND s.i = v % s.n JOIN c ON c.specimen_id = s.specimen_id AND c.i = w % c.n""")
def target_prior_draw(spark, sf_dir):
    rows = cells(spark, sf_dir)
    asked = rows.where("modality = 'O'").select(F.col("cell_id").alias("query_id"))
    drawn = sampling.prior_draw(rows.where("modality = 'F'").select("patient_id", "specimen_id", "cell_id", "extendedprice"), asked, ["query_id"], 9, KEYS)
    return drawn.select("query_id", "specimen_id", "cell_id", "extendedprice")


@query("""SELECT n_name AS token, 0 + CAST('0x' || substr(h, 7, 2) || substr(h, 5, 2) || substr(h, 3, 2) || substr(h, 1, 2) AS BIGINT) AS seed FROM (SELECT n_name, sha256('4207|' || n_name) AS h FROM nation)""")
def stable_seeds(spark, sf_dir):
    return read(spark, sf_dir, "nation").select(F.col("n_name").alias("token"), sampling.stable_seed_column(F.lit("4207"), "n_name").alias("seed"))


FOLDS_SQL = """people AS (SELECT patient_id, (row_number() OVER (ORDER BY md5(patient_id || '~5'), patient_id) - 1) % 5 AS place FROM (SELECT DISTINCT patient_id FROM cells)),
folds AS (SELECT CAST(f AS INTEGER) AS fold, CASE WHEN place = f THEN 'test' WHEN place = (f + 1) % 5 THEN 'validation' ELSE 'train' END AS role, patient_id FROM people CROSS JOIN (SELECT unnest(range(5)) AS f)),
splits AS (SELECT fold, role, f.patient_id, specimen_id FROM folds f JOIN (SELECT DISTINCT patient_id, specimen_id FROM cells) s ON s.patient_id = f.patient_id)"""


def _splits(spark, sf_dir) -> DataFrame:
    return splits.hashed_folds(cells(spark, sf_dir), 5, 5)


@query(f"WITH {CELLS_SQL}, {FOLDS_SQL} SELECT fold, role, patient_id, specimen_id FROM splits")
def patient_grouped_folds(spark, sf_dir):
    return _splits(spark, sf_dir)


@query(f"""WITH {CELLS_SQL}, {FOLDS_SQL}, broken AS (SELECT fold, role, patient_id, specimen_id FROM splits UNION ALL SELECT fold, 'train', patient_id, specimen_id FROM splits WHERE role = 'test' AND patient_id = 'n3')
SELECT 'patient_in_two_roles' AS rule, fold, patient_id FROM broken GROUP BY fold, patient_id HAVING count(DISTINCT role) > 1
UNION ALL SELECT 'specimen_in_two_roles', fold, specimen_id FROM broken GROUP BY fold, specimen_id HAVING count(DISTINCT role) > 1""")
def leakage_violations(spark, sf_dir):
    rows = _splits(spark, sf_dir)
    leak = rows.where("role = 'test' AND patient_id = 'n3'").withColumn("role", F.lit("train"))
    return splits.violations(rows.unionByName(leak), 5)


@query(f"""WITH {CELLS_SQL}, pairs AS (SELECT DISTINCT patient_id, specimen_id FROM cells), p AS (SELECT DISTINCT patient_id FROM pairs),
ranked AS (SELECT patient_id, row_number() OVER (ORDER BY md5(patient_id || '~4207'), patient_id) - 1 AS k, count(*) OVER () AS n FROM p),
placed AS (SELECT patient_id, fold, (k * 5) // n AS tested FROM ranked, (SELECT unnest(range(5)) AS fold)),
others AS (SELECT fold, patient_id, row_number() OVER (PARTITION BY fold ORDER BY md5(patient_id || '~' || (4207 + fold + 1)), patient_id) AS k, count(*) OVER (PARTITION BY fold) AS n FROM placed WHERE tested <> fold),
held AS (SELECT fold, patient_id FROM others WHERE k <= least(greatest(1, round_even(n * 0.2, 0)), n - 1))
SELECT CAST(fold AS INTEGER) AS fold, CASE WHEN tested = fold THEN 'test' WHEN (fold, patient_id) IN (SELECT (fold, patient_id) FROM held) THEN 'validation' ELSE 'train' END AS role, patient_id, specimen_id
FROM placed JOIN pairs USING (patient_id)""", name="patient_grouped_folds_seeded")
def patient_grouped_folds_seeded(spark, sf_dir):
    return splits.seeded_folds(cells(spark, sf_dir), 5, 4207, 0.2)


# ---- neighbours -------------------------------------------------------------------------------------------------
PANEL = [f"e{k}" for k in range(64)]
PANEL_SQL = "panel AS (SELECT vec_id, label, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS e{k}" for k in range(64)) + " FROM embeddings)"


def _panel(spark, sf_dir) -> DataFrame:
    """62 observed and two hidden markers of a cell; label is its type."""
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", *(F.element_at("embedding", k + 1).cast("double").alias(f"e{k}") for k in range(64)))


D_SQL = " + ".join(f"(q.e{k} - b.e{k}) * (q.e{k} - b.e{k})" for k in range(62))
NEAR_SQL = f"""near AS (SELECT q.vec_id, b.vec_id AS bank_id, b.e62, b.e63, sqrt({D_SQL}) AS d, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D_SQL}, b.vec_id) AS k
  FROM panel q JOIN panel b ON b.vec_id % 4 <> 0 AND q.vec_id % 4 = 0)"""


@query(f"""WITH {PANEL_SQL}, {NEAR_SQL} SELECT vec_id, round(quantile_disc(e62, 0.5), 6) AS predicted_e62, round(quantile_disc(e63, 0.5), 6) AS predicted_e63 FROM near WHERE k <= 10 GROUP BY vec_id""")
def knn_median_lower(spark, sf_dir):
    rows = _panel(spark, sf_dir)
    out = knn.impute(rows.where("vec_id % 4 = 0"), rows.where("vec_id % 4 <> 0"), PANEL[:62], PANEL[62:], ["vec_id"], k=10)
    return rounded(out.select("vec_id", "predicted_e62", "predicted_e63"), "predicted_e62", "predicted_e63")


@query(f"""WITH {PANEL_SQL}, {NEAR_SQL}, m AS (SELECT vec_id, median(e62) AS p62, median(e63) AS p63, avg(d) AS d, count(*) AS n FROM near WHERE k <= 11 GROUP BY vec_id)
SELECT vec_id, round(any_value(p62), 6) AS predicted_e62, round(any_value(p63), 6) AS predicted_e63, round(median(abs(e62 - p62)), 6) AS mad_e62, round(median(abs(e63 - p63)), 6) AS mad_e63, round(any_value(m.d), 6) AS mean_distance, any_value(n) AS effective_k
FROM near JOIN m USING (vec_id) WHERE k <= 11 GROUP BY vec_id""")
def knn_median_diagnostics(spark, sf_dir):
    rows = _panel(spark, sf_dir)
    out = knn.impute(rows.where("vec_id % 4 = 0"), rows.where("vec_id % 4 <> 0"), PANEL[:62], PANEL[62:], ["vec_id"], k=11, rule="mean")
    out = out.select("vec_id", "predicted_e62", "predicted_e63", "mad_e62", "mad_e63", "mean_distance", "effective_k")
    return rounded(out, "predicted_e62", "predicted_e63", "mad_e62", "mad_e63", "mean_distance")


@query(f"""WITH {PANEL_SQL}, seen AS (SELECT DISTINCT label FROM panel WHERE vec_id % 4 <> 0 AND label <> 0), near AS (SELECT q.vec_id, b.e62, q.label NOT IN (SELECT label FROM seen) AS used_fallback, row_number() OVER (PARTITION BY q.vec_id ORDER BY {D_SQL}, b.vec_id) AS k
  FROM panel q JOIN panel b ON b.vec_id % 4 <> 0 AND b.label <> 0 AND q.vec_id % 4 = 0 AND (b.label = q.label OR q.label NOT IN (SELECT label FROM seen)))
SELECT vec_id, round(median(e62), 6) AS predicted_e62, any_value(used_fallback) AS used_fallback, count(*) AS effective_k FROM near WHERE k <= 10 GROUP BY vec_id""")
def knn_label_conditioned(spark, sf_dir):
    rows = _panel(spark, sf_dir)
    out = knn.impute(rows.where("vec_id % 4 = 0"), rows.where("vec_id % 4 <> 0 AND label <> 0"), PANEL[:62], ["e62"], ["vec_id"], k=10, rule="mean", label="label")
    return rounded(out.select("vec_id", "predicted_e62", "used_fallback", "effective_k"), "predicted_e62")


@query(f"""WITH {CELLS_SQL}, fit AS (SELECT quantity AS x, extendedprice AS y FROM cells WHERE modality = 'O'), s AS (SELECT avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM fit),
b AS (SELECT sum((x - mx) / sx * (y - my)) / (any_value(n) + 10.0) AS beta FROM fit, s)
SELECT specimen_id, count(*) AS n_cells, round(avg(my + beta * (quantity - mx) / sx), 4) AS mean_prediction, round(avg(abs(my + beta * (quantity - mx) / sx - extendedprice)), 4) AS mae FROM cells, s, b WHERE modality = 'F' GROUP BY specimen_id""")
def ridge_predict(spark, sf_dir):
    rows = cells(spark, sf_dir)
    model = models.fit_ridge(rows.where("modality = 'O'"), ["quantity"], ["extendedprice"], alpha=10.0)
    out = model.predict(rows.where("modality = 'F'")).groupBy("specimen_id").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("predicted_extendedprice").alias("mean_prediction"), F.avg(F.abs(F.col("predicted_extendedprice") - F.col("extendedprice"))).alias("mae"))
    return rounded(out, "mean_prediction", "mae", digits=4)


# ---- names ------------------------------------------------------------------------------------------------------
CHANNELS = [("spectral_flow", c) for c in ("CD3", " cd 4", "PD1", "FSC-A", "SSC-A", "CCR7", "CD57", "HLA-DR")] + [("cytof", c) for c in ("CD3", "CD279", "CD197", "CD16", "HLA-DR", "CD 4", "AF-A")]
N_CHANNELS = len(CHANNELS)
CHANNEL_SQL = (
    "measured AS (SELECT p_partkey, p_partkey % " + str(N_CHANNELS) + " AS ordinal, [" + ", ".join(f"'{m}'" for m, _ in CHANNELS) + "][p_partkey % " + str(N_CHANNELS) + " + 1] AS modality, ["
    + ", ".join(f"'{c}'" for _, c in CHANNELS) + "][p_partkey % " + str(N_CHANNELS) + """ + 1] AS original_channel FROM part),
tokens AS (SELECT *, replace(upper(trim(original_channel)), ' ', '') AS token FROM measured),
every AS (SELECT *, CASE WHEN token IN ('PD-1', 'PD1', 'CD279') THEN 'PD-1' WHEN token IN ('CCR7', 'CD197') THEN 'CCR7' ELSE token END AS canonical_marker, token IN ('FSC-A', 'SSC-A', 'SSC-B-A', 'AF-A') AS technical FROM tokens),
named AS (SELECT DISTINCT modality, original_channel, ordinal, canonical_marker, technical FROM every)"""
)


def _channels(spark, sf_dir) -> DataFrame:
    """A part is a measured channel: its modality and name go by its key."""
    pick = lambda k: F.element_at(F.array(*(F.lit(c[k]) for c in CHANNELS)), (F.col("p_partkey") % N_CHANNELS + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", pick(0).alias("modality"), pick(1).alias("original_channel"), (F.col("p_partkey") % N_CHANNELS).cast("int").alias("ordinal"))


@query(f"""WITH {CHANNEL_SQL}, roles AS (SELECT d.direction, n.modality, n.original_channel, n.canonical_marker, n.ordinal, CASE WHEN technical THEN 'technical' WHEN EXISTS (SELECT 1 FROM named o WHERE o.canonical_marker = n.canonical_marker AND o.modality <> n.modality AND NOT o.technical) THEN 'H'
  WHEN n.modality = d.source THEN 'source_only' ELSE 'Y' END AS role, (SELECT min(o.ordinal) FROM named o WHERE o.canonical_marker = n.canonical_marker AND o.modality = d.source) AS lead
  FROM named n CROSS JOIN (SELECT unnest(['spectral_flow_to_cytof', 'cytof_to_spectral_flow']) AS direction, unnest(['spectral_flow', 'cytof']) AS source) d)
SELECT direction, modality, original_channel, canonical_marker, role, CAST(row_number() OVER (PARTITION BY direction, modality, role ORDER BY CASE WHEN role = 'H' THEN lead ELSE ordinal END) - 1 AS INTEGER) AS ordinal FROM roles""")
def panel_pair_contract(spark, sf_dir):
    return audit.marker_roles(_channels(spark, sf_dir).drop("p_partkey").distinct(), "spectral_flow", "cytof")


@query(f"WITH {CHANNEL_SQL} SELECT p_partkey, modality, original_channel, canonical_marker FROM every WHERE NOT technical")
def technical_filter(spark, sf_dir):
    rows = _channels(spark, sf_dir).withColumn("canonical_marker", names.canonical(F.col("original_channel")))
    return rows.where(~names.is_technical(F.col("original_channel"))).select("p_partkey", "modality", "original_channel", "canonical_marker")


@query(f"""WITH {CHANNEL_SQL} SELECT modality, original_channel, CASE WHEN modality = 'cytof' THEN 'upstream_asinh_x_over_5' WHEN original_channel IN ('SSC-A', 'FSC-A', 'SSC-B-A') THEN 'upstream_linear_divide_600000'
  WHEN original_channel = 'AF-A' THEN 'upstream_processed_autofluorescence' ELSE 'upstream_asinh_approximately_x_over_6000' END AS transformation, count(*) AS n FROM every GROUP BY ALL""")
def marker_transformations(spark, sf_dir):
    rows = _channels(spark, sf_dir)
    return rows.groupBy("modality", "original_channel", names.transformation(F.col("modality"), F.col("original_channel")).alias("transformation")).agg(F.count(F.lit(1)).alias("n"))


LABELS = ["Blast cells", " monocyte", "T cell CD4", "t cell dn", "B cell", "NK cell bright", "Debris", "doublet", ""]
FINE_SQL = "(SELECT p_partkey, [" + ", ".join(f"'{x}'" for x in LABELS) + "][p_partkey % 9 + 1] AS fine_label FROM part)"


@query(f"""SELECT coarse, fine_label, count(*) AS n FROM (SELECT fine_label, CASE WHEN l LIKE 'blast%' THEN 'Blast' WHEN l LIKE 'monocyte%' THEN 'Monocyte' WHEN l LIKE 't cell%' THEN 'T cell' WHEN l LIKE 'b cell%' THEN 'B cell' WHEN l LIKE 'nk cell%' THEN 'NK cell' END AS coarse
FROM (SELECT fine_label, lower(trim(fine_label)) AS l FROM {FINE_SQL})) GROUP BY ALL""")
def coarse_labels(spark, sf_dir):
    fine = F.element_at(F.array(*(F.lit(x) for x in LABELS)), (F.col("p_partkey") % 9 + 1).cast("int"))
    rows = read(spark, sf_dir, "part").select(fine.alias("fine_label"))
    return rows.groupBy(names.coarse_label(F.col("fine_label")).alias("coarse"), "fine_label").agg(F.count(F.lit(1)).alias("n"))


SPECIMEN_SQL = "(SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'R' || s_suppkey || '_' || s_nationkey WHEN 1 THEN 'r' || s_suppkey WHEN 2 THEN 'sample' || s_nationkey || '_visit' || s_suppkey ELSE 'R' || s_suppkey || 'x_1' END AS specimen_id FROM supplier)"


@query(f"""SELECT specimen_id, CASE WHEN regexp_matches(specimen_id, '^[Rr][0-9]+(_.*)?$') THEN upper(regexp_extract(specimen_id, '^([Rr][0-9]+)', 1)) ELSE split_part(specimen_id, '_', 1) END AS patient_id FROM {SPECIMEN_SQL}""")
def patient_from_specimen(spark, sf_dir):
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    kind = F.col("s_suppkey") % 4
    name = F.when(kind == 0, F.concat(F.lit("R"), key, F.lit("_"), nation)).when(kind == 1, F.concat(F.lit("r"), key)).when(kind == 2, F.concat(F.lit("sample"), nation, F.lit("_visit"), key)).otherwise(F.concat(F.lit("R"), key, F.lit("x_1")))
    rows = read(spark, sf_dir, "supplier").select(name.alias("specimen_id"))
    return rows.select("specimen_id", names.patient_of(F.col("specimen_id")).alias("patient_id"))


# ---- audits -----------------------------------------------------------------------------------------------------
NOTES_SQL = """notes AS (SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'first' ELSE 'second' END AS source, 'c' || o_custkey || '_' || (o_orderkey % 3) AS specimen_id, 'c' || o_custkey AS patient_id, o_orderpriority AS endpoint,
  CASE o_orderstatus WHEN 'F' THEN 'Mutant' WHEN 'O' THEN 'Wildtype' ELSE '' END AS value FROM orders),
ends AS (SELECT DISTINCT endpoint FROM notes), people AS (SELECT DISTINCT specimen_id, patient_id FROM notes), sources AS (SELECT specimen_id, count(DISTINCT source) AS k FROM notes GROUP BY specimen_id),
said AS (SELECT specimen_id, endpoint, count(DISTINCT value) AS n, min(value) AS v FROM notes WHERE value <> '' GROUP BY ALL),
reconciled AS (SELECT p.specimen_id, p.patient_id, e.endpoint, CASE WHEN n > 1 THEN 'conflict' WHEN n IS NULL THEN 'unknown' WHEN k = 1 THEN 'unknown' ELSE v END AS value, k AS n_sources FROM people p CROSS JOIN ends e LEFT JOIN said USING (specimen_id, endpoint) JOIN sources USING (specimen_id)),
status AS (SELECT patient_id, endpoint, CASE WHEN max((value = 'conflict')::INT) = 1 OR count(DISTINCT value) FILTER (value NOT IN ('unknown', 'conflict')) > 1 THEN 'conflict' ELSE coalesce(max(value) FILTER (value NOT IN ('unknown', 'conflict')), 'unknown') END AS status FROM reconciled GROUP BY ALL)"""


def _notes(spark, sf_dir) -> tuple[DataFrame, DataFrame, list[str]]:
    orders = read(spark, sf_dir, "orders")
    customer = F.concat(F.lit("c"), "o_custkey")
    rows = orders.select(
        F.when(F.col("o_orderkey") % 2 == 0, "first").otherwise("second").alias("source"),
        F.concat(customer, F.lit("_"), F.col("o_orderkey") % 3).alias("specimen_id"),
        customer.alias("patient_id"),
        F.col("o_orderpriority").alias("endpoint"),
        F.when(F.col("o_orderstatus") == "F", "Mutant").when(F.col("o_orderstatus") == "O", "Wildtype").otherwise("").alias("value"),
    )
    ends = [r[0] for r in rows.select("endpoint").distinct().orderBy("endpoint").collect()]
    return rows.drop("patient_id"), rows.select("specimen_id", "patient_id").distinct(), ends


@query(f"""WITH {NOTES_SQL} SELECT r.specimen_id, r.patient_id, r.endpoint, value, CASE WHEN status = 'conflict' OR value IN ('conflict', 'unknown') THEN 'not_evaluable' ELSE 'secondary' END AS eligibility,
CASE WHEN status = 'conflict' OR value = 'conflict' THEN 'longitudinal_or_annotation_source_conflict' WHEN value = 'unknown' THEN CASE WHEN n_sources = 1 THEN 'single_source_annotation_unverified' ELSE 'missing_annotation' END ELSE '' END AS reason FROM reconciled r JOIN status s ON s.patient_id = r.patient_id AND s.endpoint = r.endpoint""")
def endpoint_reconciliation(spark, sf_dir):
    reconciled = audit.reconcile(*_notes(spark, sf_dir))
    return audit.endpoint_records(reconciled, audit.patient_status(reconciled))


SUPPORT_SQL = """roles AS (SELECT f AS fold, CASE WHEN place = f THEN 'test' WHEN place = (f + 1) % 4 THEN 'validation' ELSE 'train' END AS role, patient_id FROM (SELECT patient_id, (row_number() OVER (ORDER BY md5(patient_id || '~6'), patient_id) - 1) % 4 AS place FROM (SELECT DISTINCT patient_id FROM people)) CROSS JOIN (SELECT unnest(range(4)) AS f)),
support AS (SELECT endpoint, CAST(fold AS INTEGER) AS fold, role, count(*) FILTER (status = 'Mutant') AS positive_patients, count(*) FILTER (status = 'Wildtype') AS negative_patients, count(*) FILTER (status = 'unknown') AS unknown_patients, count(*) FILTER (status = 'conflict') AS conflict_patients, count(*) AS patients FROM roles JOIN status USING (patient_id) GROUP BY ALL)"""


def _support(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    notes, people, ends = _notes(spark, sf_dir)
    status = audit.patient_status(audit.reconcile(notes, people, ends))
    return audit.endpoint_support(status, splits.hashed_folds(people, 4, 6), "Mutant", "Wildtype"), status


@query(f"WITH {NOTES_SQL}, {SUPPORT_SQL} SELECT * FROM support")
def endpoint_support(spark, sf_dir):
    return _support(spark, sf_dir)[0]


@query(f"""WITH {NOTES_SQL}, {SUPPORT_SQL}, t AS (SELECT endpoint, min(positive_patients) AS p, min(negative_patients) AS n FROM support WHERE role = 'test' GROUP BY endpoint), w AS (SELECT endpoint, count(*) FILTER (status = 'Mutant') AS tp, count(*) FILTER (status = 'Wildtype') AS tn FROM status GROUP BY endpoint)
SELECT endpoint, CASE WHEN p = 0 OR n = 0 THEN 'descriptive_only_not_foldwise_evaluable' WHEN least(tp, tn) >= 10 AND least(p, n) >= 3 THEN 'support_qualified_secondary' ELSE 'secondary_only_sparse_support' END AS eligibility FROM t JOIN w USING (endpoint)""")
def endpoint_eligibility(spark, sf_dir):
    support, status = _support(spark, sf_dir)
    return audit.endpoint_eligibility(support, status, "Mutant", "Wildtype", 10, 3)


@query("""SELECT 'u' || user_id AS patient_id, event_id AS visit_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id) AS INTEGER) AS visit_order FROM events""")
def visit_order(spark, sf_dir):
    rows = read(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("patient_id"), F.col("event_id").alias("visit_id"), F.to_date("ts").alias("collection_date"))
    return audit.visit_order(rows).select("patient_id", "visit_id", "visit_order")


EVENTS_SQL = "tally AS (SELECT modality, specimen_id, count(*) AS events FROM cells WHERE NOT (modality = 'F' AND specimen_id IN ('s1', 's2')) GROUP BY ALL)"


def _tally(spark, sf_dir) -> DataFrame:
    rows = cells(spark, sf_dir).where("NOT (modality = 'F' AND specimen_id IN ('s1', 's2'))")
    return rows.groupBy("modality", "specimen_id").agg(F.count(F.lit(1)).alias("events"))


@query(f"""WITH {CELLS_SQL}, {FOLDS_SQL}, {EVENTS_SQL}, members AS (SELECT s.fold, g.fit_stage, d.direction, d.bank_role, d.modality, sd.seed, s.patient_id, s.specimen_id, least(t.events, 200) AS event_count FROM splits s
  JOIN (SELECT unnest(['inner_fit', 'outer_refit', 'outer_refit']) AS fit_stage, unnest(['train', 'train', 'validation']) AS role) g ON g.role = s.role
  CROSS JOIN (SELECT unnest(['O_to_F', 'O_to_F', 'O_to_F', 'O_to_F', 'F_to_O', 'F_to_O', 'F_to_O', 'F_to_O']) AS direction, unnest(['target_predictor_bank', 'null_prior_bank', 'calibration_bank', 'calibration_bank', 'target_predictor_bank', 'null_prior_bank', 'calibration_bank', 'calibration_bank']) AS bank_role, unnest(['F', 'F', 'O', 'F', 'O', 'O', 'F', 'O']) AS modality) d
  CROSS JOIN (SELECT unnest([1, 2]) AS seed) sd JOIN tally t ON t.modality = d.modality AND t.specimen_id = s.specimen_id),
p AS (SELECT fold, fit_stage, direction, bank_role, modality, seed, count(DISTINCT patient_id) AS np FROM members GROUP BY ALL), q AS (SELECT fold, fit_stage, direction, bank_role, modality, seed, patient_id, count(*) AS ns FROM members GROUP BY ALL)
SELECT fold, fit_stage, direction, bank_role, modality, seed, patient_id, specimen_id, event_count, round(1.0::DOUBLE / np, 9) AS patient_weight, round(1.0::DOUBLE / np / ns, 9) AS specimen_weight, round(1.0::DOUBLE / np / ns / event_count, 9) AS event_weight
FROM members JOIN p USING (fold, fit_stage, direction, bank_role, modality, seed) JOIN q USING (fold, fit_stage, direction, bank_role, modality, seed, patient_id)""")
def bank_weights(spark, sf_dir):
    events = _tally(spark, sf_dir).withColumnRenamed("events", "eligible_events")
    banks = audit.reference_banks(_splits(spark, sf_dir), events, [("O", "F"), ("F", "O")], [1, 2], 200)
    return rounded(banks, "patient_weight", "specimen_weight", "event_weight", digits=9)


INVENTORY_SQL = "inv AS (SELECT specimen_id, CASE WHEN count(*) > 1 THEN 'exact_pair' ELSE min(modality) || '_only' END AS pairing, min(events) AS events, CASE WHEN min(events) < 50 THEN 'ineligible' WHEN min(events) < 300 THEN 'low_event' ELSE 'ok' END AS flag FROM tally GROUP BY specimen_id)"


@query(f"WITH {CELLS_SQL}, {EVENTS_SQL}, {INVENTORY_SQL} SELECT * FROM inv")
def inventory_flags(spark, sf_dir):
    return audit.inventory(_tally(spark, sf_dir), 50, 300)


@query(f"""WITH {CELLS_SQL}, {EVENTS_SQL}, {INVENTORY_SQL} SELECT modality, count(*) AS specimens, CAST(sum(t.events) AS BIGINT) AS events, count(*) FILTER (pairing = 'exact_pair') AS paired_specimens, CAST(sum(CASE WHEN pairing = 'exact_pair' THEN t.events ELSE 0 END) AS BIGINT) AS paired_events FROM tally t JOIN inv USING (specimen_id) GROUP BY modality""")
def modality_rollup(spark, sf_dir):
    tally = _tally(spark, sf_dir)
    return audit.modality_rollup(tally, audit.inventory(tally, 50, 300))


@query(f"""WITH {CELLS_SQL} SELECT specimen_id, count(*) AS rows, count(*) FILTER (cell_type = 'N') AS unmapped_rows, array_to_string(list_sort(list_distinct(list(cell_type))), ',') AS fine_labels FROM cells GROUP BY specimen_id""")
def label_profile(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("coarse", F.when(F.col("cell_type") != "N", F.col("cell_type")))
    return audit.label_profile(rows, "coarse", "cell_type").withColumn("fine_labels", F.array_join("fine_labels", ","))


@query("""SELECT sha256(string_agg(sha256(n_name) || '  ' || 'nation/' || n_nationkey, chr(10) ORDER BY sha256(n_name) || '  ' || 'nation/' || n_nationkey) || chr(10)) AS digest, count(*) AS files FROM nation""")
def source_bundle_digest(spark, sf_dir):
    files = read(spark, sf_dir, "nation").select(F.sha2("n_name", 256).alias("sha256"), F.concat(F.lit("nation/"), "n_nationkey").alias("path"))
    return audit.bundle_digest(files)


@query("""SELECT 'first' AS source, specimen_id, CASE WHEN k = 1 THEN 'exact_duplicate' ELSE 'unlike_duplicate' END AS kind FROM (SELECT 'c' || o_custkey AS specimen_id, count(*) AS n, count(DISTINCT o_orderstatus) AS k FROM orders GROUP BY ALL) WHERE n > 1""")
def annotation_duplicates(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.lit("first").alias("source"), F.concat(F.lit("c"), "o_custkey").alias("specimen_id"), "o_orderstatus")
    return audit.annotation_duplicates(rows)


# ---- summaries --------------------------------------------------------------------------------------------------
PANELS_SQL = """panels AS (SELECT l_linestatus AS modality, p AS panel, CASE p WHEN 'base' THEN 'base' WHEN 'upper' THEN 'upper' ELSE 'addback' END AS panel_kind, CASE WHEN p LIKE 'add%' THEN substr(p, 4) END AS added_marker, 'n' || s_nationkey AS patient,
  avg(CASE p WHEN 'base' THEN l_discount WHEN 'upper' THEN l_tax * 2 WHEN 'addX' THEN (l_discount + l_tax) / 2 ELSE l_tax END) AS skill FROM lineitem JOIN supplier ON l_suppkey = s_suppkey CROSS JOIN (SELECT unnest(['base', 'upper', 'addX', 'addY']) AS p)
  WHERE NOT (p = 'addY' AND s_nationkey % 5 = 0) GROUP BY ALL)"""


def _panels(spark, sf_dir) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("panel", F.explode(F.array(*(F.lit(p) for p in ("base", "upper", "addX", "addY")))))
    value = F.when(F.col("panel") == "base", F.col("l_discount")).when(F.col("panel") == "upper", F.col("l_tax") * 2).when(F.col("panel") == "addX", (F.col("l_discount") + F.col("l_tax")) / 2).otherwise(F.col("l_tax"))
    kept = rows.where(~((F.col("panel") == "addY") & (F.col("s_nationkey") % 5 == 0)))
    kind = F.when(F.col("panel").isin("base", "upper"), F.col("panel")).otherwise("addback")
    added = F.when(F.startswith("panel", F.lit("add")), F.substr("panel", F.lit(4)))
    return kept.groupBy(F.col("l_linestatus").alias("modality"), "panel", kind.alias("panel_kind"), added.alias("added_marker"), F.concat(F.lit("n"), "s_nationkey").alias("patient")).agg(F.avg(value).alias("skill"))


@query(f"""WITH {PANELS_SQL}, j AS (SELECT p.modality, p.panel, p.panel_kind, p.added_marker, p.patient, p.skill AS x, b.skill AS b, u.skill AS u FROM panels p JOIN panels b ON b.panel = 'base' AND b.modality = p.modality AND b.patient = p.patient JOIN panels u ON u.panel = 'upper' AND u.modality = p.modality AND u.patient = p.patient WHERE p.panel <> 'base')
SELECT modality, panel, panel_kind, added_marker, 'skill' AS metric, count(DISTINCT patient) AS n_patients, round(avg(b), 6) AS base_mean, round(avg(x), 6) AS panel_mean, round(avg(u), 6) AS upper_mean, round(avg(x - b), 6) AS delta_mean,
  round(CASE WHEN abs(avg(u) - avg(b)) > 1e-12 THEN avg(x - b) / (avg(u) - avg(b)) END, 4) AS gap_rescue_fraction FROM j GROUP BY ALL""")
def addback_effect(spark, sf_dir):
    out = summaries.paired_effects(_panels(spark, sf_dir), [], ["skill"], "base", "upper", replicates=None)
    return rounded(rounded(out, "base_mean", "panel_mean", "upper_mean", "delta_mean"), "gap_rescue_fraction", digits=4)


@query(name="bootstrap_ci")
def bootstrap_ci(spark, sf_dir):
    return summaries.paired_effects(_panels(spark, sf_dir), [], ["skill"], "base", "upper")


REPS = ["full_true", "full_hybrid_median", "full_hybrid_knn", "hidden_true", "hidden_median", "hidden_knn"]
REPS_SQL = """reps AS (SELECT l_linestatus AS modality, 'panel1' AS panel, 'n' || s_nationkey AS patient, r AS representation, avg(CASE r WHEN 'full_true' THEN 1 - l_tax WHEN 'full_hybrid_median' THEN 1 - l_discount * 4 WHEN 'full_hybrid_knn' THEN 1 - l_discount * 2 WHEN 'hidden_true' THEN 0.9 WHEN 'hidden_median' THEN 0.5 ELSE 0.5 + l_tax END) AS macro_f1
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey CROSS JOIN (SELECT unnest([""" + ", ".join(f"'{r}'" for r in REPS) + """]) AS r) WHERE NOT (r = 'hidden_knn' AND s_nationkey % 4 = 0) GROUP BY ALL)"""


@query(f"""WITH {REPS_SQL}, t AS (SELECT modality, panel, patient, p.probe, max(CASE WHEN representation = p.probe || '_true' THEN macro_f1 END) AS t, max(CASE WHEN representation = p.stem || 'median' THEN macro_f1 END) AS n, max(CASE WHEN representation = p.stem || 'knn' THEN macro_f1 END) AS m
  FROM reps CROSS JOIN (SELECT unnest(['full', 'hidden']) AS probe, unnest(['full_hybrid_', 'hidden_']) AS stem) p GROUP BY ALL)
SELECT modality, panel, probe, 'knn' AS method, 'macro_f1' AS metric, count(*) AS n_patients, round(avg(t), 6) AS true_mean, round(avg(n), 6) AS null_mean, round(avg(m), 6) AS method_mean, round(CASE WHEN abs(avg(t) - avg(n)) > 1e-12 THEN (avg(m) - avg(n)) / (avg(t) - avg(n)) END, 6) AS retention
FROM t WHERE t IS NOT NULL AND n IS NOT NULL AND m IS NOT NULL GROUP BY ALL""")
def retention(spark, sf_dir):
    r = F.col("representation")
    rows = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("representation", F.explode(F.array(*(F.lit(x) for x in REPS)))).where(~((r == "hidden_knn") & (F.col("s_nationkey") % 4 == 0)))
    value = F.when(r == "full_true", 1 - F.col("l_tax")).when(r == "full_hybrid_median", 1 - F.col("l_discount") * 4).when(r == "full_hybrid_knn", 1 - F.col("l_discount") * 2).when(r == "hidden_true", 0.9).when(r == "hidden_median", 0.5).otherwise(0.5 + F.col("l_tax"))
    per = rows.groupBy(F.col("l_linestatus").alias("modality"), F.lit("panel1").alias("panel"), F.concat(F.lit("n"), "s_nationkey").alias("patient"), "representation").agg(F.avg(value.cast("double")).alias("macro_f1"))
    return rounded(summaries.retention(per, ["knn"], ["macro_f1"]), "true_mean", "null_mean", "method_mean", "retention")


RUNS_SQL = "runs AS (SELECT o_orderkey % 5 AS fold, o_orderkey % 3 AS seed, substr(o_orderpriority, 1, 1) AS method, avg(o_totalprice) / 1000 AS score FROM orders GROUP BY ALL)"


def _runs(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy((F.col("o_orderkey") % 5).alias("fold"), (F.col("o_orderkey") % 3).alias("seed"), F.substring("o_orderpriority", 1, 1).alias("method")).agg((F.avg("o_totalprice") / 1000).alias("score"))


@query(f"WITH {RUNS_SQL} SELECT method, count(*) AS n_runs, round(avg(score), 6) AS score_mean, round(coalesce(stddev_samp(score), 0), 6) AS score_std FROM runs GROUP BY method")
def run_summary_mean_std(spark, sf_dir):
    return rounded(summaries.run_means(_runs(spark, sf_dir), ["method"], ["score"]), "score_mean", "score_std")


@query(f"""WITH {RUNS_SQL} SELECT o.method AS against, count(*) FILTER (r.score < o.score) AS wins, count(*) AS n_runs, avg(r.score) < avg(o.score) AS beats_mean FROM runs r JOIN runs o USING (fold, seed) WHERE r.method = '1' AND o.method IN ('2', '3') GROUP BY o.method""")
def run_wins(spark, sf_dir):
    return summaries.wins(_runs(spark, sf_dir), ["fold", "seed"], "1", ["2", "3"], "score")


DOSE_SQL = "dose AS (SELECT l_returnflag AS method, l_linenumber - 1 AS count, avg(l_extendedprice) / 1000 AS score FROM lineitem GROUP BY ALL)"


def _dose(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("method"), (F.col("l_linenumber") - 1).alias("count")).agg((F.avg("l_extendedprice") / 1000).alias("score"))


@query(f"""WITH {DOSE_SQL}, g AS (SELECT method, count, first_value(score) OVER (PARTITION BY method ORDER BY count) - score AS y, CAST(count AS DOUBLE) AS x, CASE WHEN count > 0 THEN log2(count) END AS lx, score - lag(score) OVER (PARTITION BY method ORDER BY count) AS d FROM dose)
SELECT method, round(regr_slope(y, x), 6) AS raw_slope, round(regr_intercept(y, x), 6) AS raw_intercept, round(coalesce(regr_r2(y, x), 1), 6) AS raw_r_squared, round(regr_slope(y, lx) FILTER (lx IS NOT NULL), 6) AS doubling_slope, round(regr_intercept(y, lx) FILTER (lx IS NOT NULL), 6) AS doubling_intercept,
  round(coalesce(regr_r2(y, lx) FILTER (lx IS NOT NULL), 1), 6) AS doubling_r_squared, count(d) AS steps, count(*) FILTER (d <= 0) AS falling FROM g GROUP BY method""")
def paired_curve_trend(spark, sf_dir):
    out = summaries.curve_trend(_dose(spark, sf_dir), ["method"])
    return rounded(out, *(c for c, t in out.dtypes if t == "double"))


@query(f"""WITH {DOSE_SQL}, c AS (SELECT count, avg(score) AS s FROM dose GROUP BY count), b AS (SELECT unnest(['low', 'high']) AS baseline, unnest([0.0::DOUBLE, 1000000.0]) AS v) SELECT baseline, min(count) FILTER (s < v) AS first_count FROM b CROSS JOIN c GROUP BY baseline""")
def first_count_below(spark, sf_dir):
    base = spark.createDataFrame([("low", 0.0), ("high", 1e6)], "baseline string, value double")
    return summaries.first_below(_dose(spark, sf_dir), base)


@query("""WITH sets AS (SELECT o_orderkey % 2 AS run, c AS count, 'c' || o_custkey AS specimen_id FROM orders CROSS JOIN (SELECT unnest([1, 2, 4]) AS c) WHERE o_custkey % 4 < c AND NOT (o_orderkey % 2 = 1 AND c = 4 AND o_custkey % 40 = 1)),
g AS (SELECT run, count, list(DISTINCT specimen_id) AS s FROM sets GROUP BY ALL), n AS (SELECT run, s, lead(s) OVER (PARTITION BY run ORDER BY count) AS nx FROM g)
SELECT run, bool_and(nx IS NULL OR list_has_all(nx, s)) AS nested FROM n GROUP BY run""")
def nested_subsets(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").withColumn("count", F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))))
    rows = rows.where((F.col("o_custkey") % 4 < F.col("count")) & ~((F.col("o_orderkey") % 2 == 1) & (F.col("count") == 4) & (F.col("o_custkey") % 40 == 1)))
    return summaries.nested(rows.select((F.col("o_orderkey") % 2).alias("run"), "count", F.concat(F.lit("c"), "o_custkey").alias("specimen_id")), ["run"])


@query(f"""WITH {RUNS_SQL}, base AS (SELECT CAST(fold AS BIGINT) AS fold, CAST(seed AS BIGINT) AS seed, rep AS representation, score FROM runs CROSS JOIN (SELECT unnest(['median', 'knn', 'mlp', 'knn_shuffled_h']) AS rep) WHERE method = '1'),
lit AS (SELECT fold, seed, rep AS representation, 'som_draw' AS method, score FROM runs CROSS JOIN (SELECT unnest(['som_draw', 'median']) AS rep) WHERE method = '2' AND fold < 3)
SELECT fold, seed, representation, CASE representation WHEN 'median' THEN 'global_target_median' WHEN 'knn' THEN 'knn50' ELSE 'simple_mlp' END AS method, 'inductive' AS information_access, round(score, 6) AS score FROM base b WHERE representation IN ('median', 'knn', 'mlp') AND EXISTS (SELECT 1 FROM lit l WHERE l.fold = b.fold AND l.seed = b.seed)
UNION ALL SELECT fold, seed, representation, method, 'transductive_query_H', round(score, 6) FROM lit WHERE representation = method""")
def literature_union(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    base = runs.where("method = '1'").drop("method").withColumn("representation", F.explode(F.array(*(F.lit(x) for x in ("median", "knn", "mlp", "knn_shuffled_h")))))
    lit = runs.where("method = '2' AND fold < 3").withColumn("method", F.lit("som_draw")).withColumn("representation", F.explode(F.array(F.lit("som_draw"), F.lit("median"))))
    out = summaries.literature_union(base, lit.select("fold", "seed", "representation", "method", "score"), ["fold", "seed"])
    return rounded(out, "score")


@query(f"""WITH {CELLS_SQL}, p AS (SELECT patient_id, modality, avg(tax) AS tax, avg(discount) AS discount FROM (SELECT patient_id, specimen_id, modality, avg(tax) AS tax, avg(discount) AS discount FROM cells GROUP BY ALL) GROUP BY ALL)
SELECT modality, count(DISTINCT patient_id) AS n_patients, round(avg(tax), 6) AS tax_mean, round(median(tax), 6) AS tax_median, round(avg(discount), 6) AS discount_mean, round(median(discount), 6) AS discount_median FROM p GROUP BY modality""")
def patient_first_summary(spark, sf_dir):
    from ..operators.bootstrap import summarize

    rows = cells(spark, sf_dir)
    per = summaries.patient_means(summaries.patient_means(rows, ["patient_id", "specimen_id", "modality"], ["tax", "discount"]), ["patient_id", "modality"], ["tax", "discount"])
    return rounded(summarize(per, ["modality"], ["tax", "discount"], patient="patient_id", replicates=None), "tax_mean", "tax_median", "discount_mean", "discount_median")
