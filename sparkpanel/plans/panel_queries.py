"""Queries of nested fits, label hierarchies and joint structure."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import curves, joint, metrics, sampling
from ..sources.cells import CELLS_SQL, MARKERS, cells
from ..sources.shared import kept
from .registry import query
from .statistics_queries import rounded

COUNTS = (1, 3, 6)


@query(f"""WITH {CELLS_SQL}, fit AS (SELECT patient_id, quantity AS x, extendedprice AS y FROM cells WHERE modality = 'O'),
ordered AS (SELECT patient_id, row_number() OVER (ORDER BY md5(patient_id || '~29'), patient_id) AS place FROM (SELECT DISTINCT patient_id FROM fit)),
counts AS (SELECT c FROM (SELECT unnest([{", ".join(map(str, COUNTS))}]) AS c) WHERE c <= (SELECT max(place) FROM ordered)),
rows AS (SELECT c, x, y FROM counts JOIN ordered ON place <= c JOIN fit USING (patient_id)),
s AS (SELECT c, avg(x) AS mx, stddev_pop(x) AS sx, avg(y) AS my, count(*) AS n FROM rows GROUP BY c),
b AS (SELECT c, any_value(mx) AS mx, any_value(sx) AS sx, any_value(my) AS my, sum((x - mx) / sx * (y - my)) / (any_value(n) + 10.0) AS beta FROM rows JOIN s USING (c) GROUP BY c)
SELECT CAST(c AS INTEGER) AS count, patient_id, count(*) AS n_cells, round(avg(my + beta * (quantity - mx) / sx), 4) AS mean_prediction, round(avg(abs(my + beta * (quantity - mx) / sx - extendedprice)), 4) AS mae
FROM cells, b WHERE modality = 'F' GROUP BY c, patient_id""")
def paired_count_ridge(spark, sf_dir):
    """The ridge on the first 1, 3 and 6 patients, from one set of sums by patient, scored on every cell of the other modality."""
    rows = cells(spark, sf_dir)
    models = curves.nested_ridges(rows.where("modality = 'O'"), ["quantity"], ["extendedprice"], list(COUNTS), "29", alpha=10.0)
    out = curves.along(models, rows.where("modality = 'F'")).groupBy("count", "patient_id")
    out = out.agg(F.count(F.lit(1)).alias("n_cells"), F.avg("predicted_extendedprice").alias("mean_prediction"), F.avg(F.abs(F.col("predicted_extendedprice") - F.col("extendedprice"))).alias("mae"))
    return rounded(out, "mean_prediction", "mae", digits=4)


HIERARCHY = {f"{c}{b}": c for c in "ANR" for b in ("+", "-")}
FINE_SQL = """fine AS (SELECT patient_id, specimen_id, cell_id, cell_type || CASE WHEN quantity > 25 THEN '+' ELSE '-' END AS label,
  CASE WHEN discount < 0.04 THEN 'A' WHEN tax < 0.04 THEN 'N' ELSE 'R' END || CASE WHEN extendedprice > 40000 THEN '+' ELSE '-' END AS predicted FROM cells),
both_ AS (SELECT 'fine' AS resolution, patient_id, label, predicted FROM fine UNION ALL SELECT 'coarse', patient_id, substr(label, 1, 1), substr(predicted, 1, 1) FROM fine)"""


def _fine(spark, sf_dir):
    """Cells with a fine label and a fine guess; a coarse label has two fine ones."""
    rows = cells(spark, sf_dir)
    half = lambda x: F.when(x, "+").otherwise("-")
    guess = F.when(F.col("discount") < 0.04, "A").when(F.col("tax") < 0.04, "N").otherwise("R")
    return rows.select("patient_id", "specimen_id", "cell_id", F.concat("cell_type", half(F.col("quantity") > 25)).alias("label"), F.concat(guess, half(F.col("extendedprice") > 40000)).alias("predicted"), "quantity", "discount", "tax")


@query(f"WITH {CELLS_SQL}, {FINE_SQL} SELECT resolution, patient_id, label, predicted, count(*) AS n FROM both_ GROUP BY ALL")
def confusion_rollup(spark, sf_dir):
    """Fine confusion counts and the coarse ones that they add up to."""
    return metrics.rolled_up(metrics.confusion(_fine(spark, sf_dir), ["patient_id"]), ["patient_id"], HIERARCHY)


@query(f"""WITH {CELLS_SQL}, {FINE_SQL}, classes AS (SELECT 'fine' AS resolution, unnest([{", ".join(f"'{c}'" for c in HIERARCHY)}]) AS class UNION ALL SELECT 'coarse', unnest(['A', 'N', 'R'])),
per AS (SELECT resolution, patient_id, class, count(*) AS total, count(*) FILTER (label = class) AS s, count(*) FILTER (predicted = class) AS p, count(*) FILTER (label = class AND predicted = class) AS h FROM both_ JOIN classes USING (resolution) GROUP BY ALL),
rates AS (SELECT *, CASE WHEN s > 0 THEN h / s ELSE 0 END AS r, CASE WHEN p > 0 THEN h / p ELSE 0 END AS q FROM per)
SELECT resolution, patient_id, round(sum(h) / max(total), 6) AS accuracy, round(avg(CASE WHEN s > 0 THEN r END), 6) AS balanced_accuracy, round(avg(CASE WHEN r + q > 0 THEN 2 * r * q / (r + q) ELSE 0 END), 6) AS macro_f1 FROM rates GROUP BY resolution, patient_id""")
def resolution_metrics(spark, sf_dir):
    """Fine and coarse metrics of a patient from one confusion table."""
    _, overall, _ = metrics.resolution_metrics(_fine(spark, sf_dir), ["patient_id"], HIERARCHY)
    return rounded(overall.select("resolution", "patient_id", "accuracy", "balanced_accuracy", "macro_f1"), "accuracy", "balanced_accuracy", "macro_f1")


OMEGA = np.array([[0.05, 0.0, 8.0], [0.1, -6.0, 0.0], [-0.03, 4.0, 12.0], [0.2, 9.0, -5.0]])
WAVES_SQL = ", ".join(f"avg({f}({a} * quantity + {b} * discount + {c} * tax)) FILTER (modality = '{m}') AS {f}{k}{m}" for k, (a, b, c) in enumerate(OMEGA.tolist()) for f in ("cos", "sin") for m in "OF")
GAPS_SQL = " + ".join(f"pow({f}{k}O - {f}{k}F, 2)" for k in range(len(OMEGA)) for f in ("cos", "sin"))


@query(f"""WITH {CELLS_SQL}, e AS (SELECT specimen_id, count(*) FILTER (modality = 'O') AS n0, count(*) FILTER (modality = 'F') AS n1, {WAVES_SQL} FROM cells GROUP BY specimen_id)
SELECT specimen_id, n0, n1, round(({GAPS_SQL}) / {len(OMEGA)}.0, 8) AS mmd2 FROM e""")
def kernel_mean_distance(spark, sf_dir):
    """The kernel distance of a specimen's two modalities, for given frequencies."""
    points = cells(spark, sf_dir).withColumn("side", (F.col("modality") == "F").cast("int"))
    return rounded(joint.mmd(points, "specimen_id", ["quantity", "discount", "tax"], OMEGA), "mmd2", digits=8)


PAIRS = [(a, b) for i, a in enumerate(MARKERS) for b in MARKERS[i + 1 :]]
CORR_SQL = " UNION ALL ".join(f"SELECT patient_id, '{a}{b}' AS pair, corr({a}, {b}) FILTER (modality = 'O') AS r0, corr({a}, {b}) FILTER (modality = 'F') AS r1 FROM cells GROUP BY patient_id" for a, b in PAIRS)


@query(f"""WITH {CELLS_SQL}, r AS ({CORR_SQL}), g AS (SELECT patient_id, abs(r0 - r1) AS gap FROM r WHERE r0 IS NOT NULL AND r1 IS NOT NULL AND isfinite(r0) AND isfinite(r1))
SELECT patient_id, count(*) AS n_pairs, round(avg(gap), 6) AS mean_error, round(max(gap), 6) AS worst_error FROM g GROUP BY patient_id""")
def joint_structure_error(spark, sf_dir):
    """How far the correlations of a patient's markers in one modality lie from those in the other."""
    points = cells(spark, sf_dir).withColumn("side", (F.col("modality") == "F").cast("int"))
    return rounded(joint.joint_error(points, "patient_id", list(MARKERS)), "mean_error", "worst_error")


BUDGET = 12
_U = lambda what: f"CAST('0x' || substr(md5(asked || '~' || draw || '~41-prior-{what}'), 1, 8) AS BIGINT) % 2147483648"
PAIRING_SQL = f"""all_ AS (SELECT patient_id, specimen_id, cell_id FROM cells WHERE modality = 'F'), enough AS (SELECT patient_id FROM all_ GROUP BY patient_id HAVING count(*) >= {BUDGET}),
t AS (SELECT * FROM all_ WHERE patient_id IN (SELECT patient_id FROM enough)), own AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY md5(specimen_id || '~' || cell_id || '~41'), specimen_id, cell_id) <= {BUDGET}),
ring AS (SELECT patient_id, row_number() OVER (ORDER BY md5(patient_id || '~41'), patient_id) - 1 AS k, count(*) OVER () AS n FROM enough),
maps AS (SELECT d, a.patient_id, b.patient_id AS wrong FROM ring a, (SELECT unnest([1, 2]) AS d), ring b WHERE b.k = (a.k + d) % a.n AND a.patient_id <> b.patient_id),
quota AS (SELECT CASE WHEN count(*) <= {BUDGET} THEN count(*) ELSE CAST(ceil({BUDGET} / count(DISTINCT patient_id)) AS BIGINT) END AS q FROM t),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY md5(specimen_id || '~' || cell_id || '~41-pool'), specimen_id, cell_id) AS k FROM t) WHERE k <= (SELECT q FROM quota) ORDER BY md5(specimen_id || '~' || cell_id || '~41-pool-trim'), specimen_id, cell_id LIMIT {BUDGET}),
pp AS (SELECT patient_id, row_number() OVER (ORDER BY patient_id) - 1 AS i, count(*) OVER () AS n FROM enough),
ss AS (SELECT patient_id, specimen_id, row_number() OVER (PARTITION BY patient_id ORDER BY specimen_id) - 1 AS i, count(*) OVER (PARTITION BY patient_id) AS n FROM (SELECT DISTINCT patient_id, specimen_id FROM t)),
cc AS (SELECT specimen_id, cell_id, row_number() OVER (PARTITION BY specimen_id ORDER BY specimen_id, cell_id) - 1 AS i, count(*) OVER (PARTITION BY specimen_id) AS n FROM t),
q AS (SELECT asked, draw, {_U("patient")} AS u, {_U("specimen")} AS v, {_U("cell")} AS w FROM (SELECT patient_id AS asked, unnest(range({BUDGET})) AS draw FROM enough))"""


@query(f"""WITH {CELLS_SQL}, {PAIRING_SQL} SELECT 'patient_matched' AS condition, NULL::INTEGER AS derangement, patient_id, patient_id AS reference_patient, specimen_id, cell_id FROM own
UNION ALL SELECT 'patient_deranged', d - 1, m.patient_id, wrong, specimen_id, cell_id FROM maps m JOIN own o ON o.patient_id = m.wrong
UNION ALL SELECT 'identity_blind_pooled', NULL, e.patient_id, p.patient_id, specimen_id, cell_id FROM pool p, enough e
UNION ALL SELECT 'target_prior', NULL, asked, pp.patient_id, ss.specimen_id, cc.cell_id FROM q JOIN pp ON pp.i = u % pp.n JOIN ss ON ss.patient_id = pp.patient_id AND ss.i = v % ss.n JOIN cc ON cc.specimen_id = ss.specimen_id AND cc.i = w % cc.n""")
def pairing_conditions(spark, sf_dir):
    """Each patient's reference cells under the four pairing conditions, as many in each."""
    return sampling.pairing_conditions(cells(spark, sf_dir).where("modality = 'F'"), BUDGET, "41")


@query(f"""WITH {CELLS_SQL}, {PAIRING_SQL} SELECT 'matched_to_another_patient' AS rule, 'patient_matched' AS condition, a.patient_id FROM (SELECT DISTINCT patient_id FROM own) a WHERE a.patient_id = (SELECT min(patient_id) FROM enough)
UNION ALL SELECT 'deranged_to_itself', 'patient_deranged', patient_id FROM enough WHERE patient_id = (SELECT max(patient_id) FROM enough) AND (SELECT count(*) FROM enough) > 1""")
def pairing_violations(spark, sf_dir):
    """Of conditions in which two faults are planted, those two and nothing else."""
    target = cells(spark, sf_dir).where("modality = 'F'")
    rows = kept(sampling.pairing_conditions(target, BUDGET, "41"), "pairings")
    ends = rows.agg(F.min("patient_id").alias("low"), F.max("patient_id").alias("high"))
    own = rows.where("condition = 'patient_matched'").select(F.col("patient_id").alias("__p"), F.col("specimen_id").alias("__s"), F.col("cell_id").alias("__c"), F.row_number().over(W.partitionBy("patient_id").orderBy("cell_id")).alias("__k"))
    marked = rows.crossJoin(F.broadcast(ends)).withColumn("__k", F.row_number().over(W.partitionBy("condition", "derangement", "patient_id").orderBy("cell_id")))
    # the least patient's matched cells become the greatest's, and the greatest's deranged ones its own
    swap = ((F.col("condition") == "patient_matched") & (F.col("patient_id") == F.col("low"))) | ((F.col("condition") == "patient_deranged") & (F.col("patient_id") == F.col("high")))
    other = F.when(swap, F.col("high"))
    planted = marked.withColumn("__o", other).join(own.withColumnRenamed("__k", "__j"), (F.col("__o") == F.col("__p")) & (F.col("__k") == F.col("__j")), "left")
    planted = planted.select("condition", "derangement", "patient_id", F.coalesce("__o", "reference_patient").alias("reference_patient"), F.coalesce("__s", "specimen_id").alias("specimen_id"), F.coalesce("__c", "cell_id").alias("cell_id"))
    return sampling.pairing_violations(kept(planted, "planted"), target, BUDGET)
