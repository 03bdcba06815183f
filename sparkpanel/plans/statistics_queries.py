"""Queries of the statistics core: scales, medians, percentiles, distances, ranks, metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scales as S
from ..operators import distance, metrics, percentiles, ranks
from ..operators.sampling import derangement_by_hash
from ..sources.cells import CELLS_SQL, LONG_SQL, MARKERS, cells, long
from ..sources.shared import kept
from .registry import query


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(c, digits) for c in columns})


@query(f"""WITH {LONG_SQL}
SELECT modality, marker, round(greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 0.1 * stddev_pop(value), 0.001), 6) AS scale
FROM long GROUP BY modality, marker""")
def marker_scale_iqr(spark, sf_dir):
    return rounded(S.iqr_scale(long(cells(spark, sf_dir)), ["modality", "marker"]), "scale")


ROBUST_SQL = """middle AS (
  SELECT {keys}, median(value) AS location, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM long {where} GROUP BY {keys}
), robust AS (
  SELECT {keys}, location, CASE WHEN iqr > 1e-6 THEN iqr WHEN 1.4826 * mad > 1e-6 THEN 1.4826 * mad ELSE 1.0 END AS scale FROM (
    SELECT {keys}, any_value(location) AS location, any_value(iqr) AS iqr, median(abs(value - location)) AS mad
    FROM long JOIN middle USING ({keys}) {where} GROUP BY {keys})
)"""


@query(f"""WITH {LONG_SQL}, {ROBUST_SQL.format(keys="modality, cell_type, marker", where="")}
SELECT modality, cell_type, marker, round(location, 6) AS location, round(scale, 6) AS scale FROM robust""")
def marker_scale_robust(spark, sf_dir):
    return rounded(S.robust_scale(long(cells(spark, sf_dir)), ["modality", "cell_type", "marker"]), "location", "scale")


@query(f"""WITH {LONG_SQL}
SELECT modality, marker, round(avg(value), 6) AS location, round(CASE WHEN stddev_pop(value) < 1e-6 THEN 1.0 ELSE stddev_pop(value) END, 6) AS scale
FROM long GROUP BY modality, marker""")
def marker_scale_standard(spark, sf_dir):
    return rounded(S.standard_scale(long(cells(spark, sf_dir)), ["modality", "marker"]), "location", "scale")


@query(f"""WITH {LONG_SQL}
SELECT modality, marker, round(median(value), 6) AS median FROM long GROUP BY modality, marker""")
def fit_median(spark, sf_dir):
    from ..operators.models import medians

    return rounded(medians(long(cells(spark, sf_dir)), ["modality", "marker"]), "median")


@query(f"""WITH {LONG_SQL}, fit AS (SELECT * FROM long WHERE modality = 'O' AND cell_type <> 'R'),
per AS (SELECT cell_type, marker, median(value) AS m FROM fit GROUP BY cell_type, marker),
every AS (SELECT marker, median(value) AS g FROM fit GROUP BY marker)
SELECT l.cell_type, l.marker, round(coalesce(per.m, every.g), 6) AS prediction, per.m IS NULL AS used_fallback, count(*) AS n_cells
FROM long l LEFT JOIN per USING (cell_type, marker) JOIN every USING (marker) WHERE l.modality = 'F'
GROUP BY l.cell_type, l.marker, per.m, every.g""")
def cell_type_median_fallback(spark, sf_dir):
    from ..operators.models import label_medians, predict_medians

    rows = long(cells(spark, sf_dir))
    fit = rows.where("modality = 'O' AND cell_type <> 'R'")
    predicted = predict_medians(rows.where("modality = 'F'"), *label_medians(fit))
    return rounded(predicted.groupBy("cell_type", "marker", "prediction", "used_fallback").agg(F.count(F.lit(1)).alias("n_cells")), "prediction")


KNOTS_SQL = """grid AS (SELECT unnest(range(17)) / 16.0::DOUBLE AS p), quantiles AS (
  SELECT marker, k, q[k + 1] AS knot, k / 16.0::DOUBLE AS p FROM (
    SELECT marker, quantile_cont(value, [0.0, 0.0625, 0.125, 0.1875, 0.25, 0.3125, 0.375, 0.4375, 0.5, 0.5625, 0.625, 0.6875, 0.75, 0.8125, 0.875, 0.9375, 1.0]) AS q
    FROM long WHERE modality = 'O' GROUP BY marker), unnest(range(17)) AS t(k)
), knots AS (SELECT marker, knot, avg(p) AS p FROM quantiles GROUP BY marker, knot)"""


@query(f"""WITH {LONG_SQL}, {KNOTS_SQL}
SELECT marker, round(knot, 6) AS knot, round(p, 6) AS probability FROM knots""")
def percentile_knots(spark, sf_dir):
    table = percentiles.knots(long(cells(spark, sf_dir)).where("modality = 'O'"), ["marker"], n=17)
    pairs = table.select("marker", F.explode(F.arrays_zip("knots", "probabilities")).alias("x"))
    return rounded(pairs.select("marker", F.col("x.knots").alias("knot"), F.col("x.probabilities").alias("probability")), "knot", "probability")


@query(f"""WITH {LONG_SQL}, {KNOTS_SQL}, ordered AS (
  SELECT marker, knot, p, lead(knot) OVER w AS knot2, lead(p) OVER w AS p2, min(knot) OVER (PARTITION BY marker) AS low, max(knot) OVER (PARTITION BY marker) AS high,
    min(p) OVER (PARTITION BY marker) AS plow, max(p) OVER (PARTITION BY marker) AS phigh FROM knots WINDOW w AS (PARTITION BY marker ORDER BY knot)
), ends AS (SELECT DISTINCT marker, low, high, plow, phigh FROM ordered), target AS (SELECT * FROM long WHERE modality = 'F'), placed AS (
  SELECT t.specimen_id, t.cell_id, t.marker, CASE WHEN t.value <= e.low THEN e.plow WHEN t.value >= e.high THEN e.phigh ELSE (
    o.p + (t.value - o.knot) / (o.knot2 - o.knot) * (o.p2 - o.p)) END AS u
  FROM target t JOIN ends e USING (marker) LEFT JOIN ordered o ON o.marker = t.marker AND t.value >= o.knot AND t.value < o.knot2
)
SELECT specimen_id, marker, count(*) AS n_cells, round(avg(u), 6) AS mean_percentile, round(min(u), 6) AS least, round(max(u), 6) AS most FROM placed GROUP BY specimen_id, marker""")
def percentile_transform(spark, sf_dir):
    rows = long(cells(spark, sf_dir))
    table = percentiles.knots(rows.where("modality = 'O'"), ["marker"], n=17)
    placed = percentiles.transform(rows.where("modality = 'F'"), table)
    out = placed.groupBy("specimen_id", "marker").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("value").alias("mean_percentile"), F.min("value").alias("least"), F.max("value").alias("most"))
    return rounded(out, "mean_percentile", "least", "most")


def _sides(rows: DataFrame) -> DataFrame:
    """Both modalities of a specimen as the two sides of a distance."""
    return rows.withColumn("side", F.when(F.col("modality") == "O", 0).otherwise(1))


W1_SQL = """masses AS (
  SELECT {g}, value, sum(CASE WHEN side = 0 THEN w ELSE 0 END) AS a, sum(CASE WHEN side = 1 THEN w ELSE 0 END) AS b FROM points GROUP BY {g}, value
), area AS (
  SELECT {g}, abs(sum(a) OVER o / sum(a) OVER e - sum(b) OVER o / sum(b) OVER e) * (lead(value) OVER (PARTITION BY {g} ORDER BY value) - value) AS d
  FROM masses WINDOW o AS (PARTITION BY {g} ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY {g})
), w1 AS (SELECT {g}, coalesce(sum(d), 0) AS distance FROM area GROUP BY {g})"""


@query(f"""WITH {LONG_SQL}, points AS (SELECT *, CASE WHEN modality = 'O' THEN 0 ELSE 1 END AS side, 1.0::DOUBLE AS w FROM long), {W1_SQL.format(g="specimen_id, marker")}
SELECT specimen_id, marker, round(distance, 6) AS distance FROM w1""")
def wasserstein_by_marker(spark, sf_dir):
    return rounded(distance.wasserstein(_sides(long(cells(spark, sf_dir))), ["specimen_id", "marker"]), "distance")


MIX_SQL = """sizes AS (SELECT modality, marker, patient_id, specimen_id, count(*) AS n FROM long GROUP BY ALL),
counted AS (SELECT *, count(*) OVER (PARTITION BY modality, marker, patient_id) AS k FROM sizes),
weighted AS (SELECT l.*, 1.0::DOUBLE / (c.k * c.n) AS w FROM long l JOIN counted c USING (modality, marker, patient_id, specimen_id))"""


def _weighed(rows: DataFrame) -> DataFrame:
    """Cells with their weights, which are the same for every marker: they are found before cells become a row a marker."""
    return distance.mixture_weights(rows.select("modality", "patient_id", "specimen_id", *MARKERS), extra=["modality"])


@query(f"""WITH {LONG_SQL}, {MIX_SQL}, points AS (SELECT patient_id, marker, value, w, CASE WHEN modality = 'O' THEN 0 ELSE 1 END AS side FROM weighted), {W1_SQL.format(g="patient_id, marker")}
SELECT patient_id, marker, round(distance, 6) AS distance FROM w1""")
def weighted_patient_wasserstein(spark, sf_dir):
    rows = long(_weighed(cells(spark, sf_dir)))
    return rounded(distance.wasserstein(_sides(rows), ["patient_id", "marker"], weight="weight"), "distance")


SCALE_SQL = "scales AS (SELECT marker, greatest(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 0.1 * stddev_pop(value), 0.001) AS scale FROM long WHERE modality = 'F' GROUP BY marker)"
DERANGE_SQL = """ranked AS (SELECT patient_id, row_number() OVER (ORDER BY md5(patient_id || '~7'), patient_id) - 1 AS k, count(*) OVER () AS n FROM (SELECT DISTINCT patient_id FROM cells)),
maps AS (SELECT s.d AS derangement, a.patient_id, b.patient_id AS other FROM ranked a CROSS JOIN (SELECT unnest([1, 3]) AS d) s JOIN ranked b ON b.k = (a.k + s.d) % a.n)"""


def _maps(spark, sf_dir):
    patients = kept(cells(spark, sf_dir).select("patient_id").distinct(), "patients")
    return derangement_by_hash(patients, 7, 1).withColumn("derangement", F.lit(1)).unionByName(derangement_by_hash(patients, 7, 3).withColumn("derangement", F.lit(3)))


def _dealt(rows: DataFrame) -> DataFrame:
    """Points of both sides, a row a marker; whole cells are dealt by specimen before."""
    return long(_sides(rows).select("patient_id", "specimen_id", "cell_type", "side", *MARKERS).repartition("specimen_id"))


def _target_scales(rows: DataFrame) -> DataFrame:
    return S.iqr_scale(kept(rows.where("modality = 'F'").select("marker", "value"), "targets"), ["marker"])  # read once a round


@query(f"""WITH {LONG_SQL}, {MIX_SQL}, {SCALE_SQL}, {DERANGE_SQL}, pairs AS (SELECT derangement, patient_id, other FROM maps UNION ALL SELECT -1, patient_id, patient_id FROM ranked),
points AS (SELECT p.derangement, p.patient_id, w.marker, w.value, w.w, 0 AS side FROM weighted w JOIN pairs p ON w.patient_id = p.patient_id WHERE w.modality = 'O'
  UNION ALL SELECT p.derangement, p.patient_id, w.marker, w.value, w.w, 1 FROM weighted w JOIN pairs p ON w.patient_id = p.other WHERE w.modality = 'F'),
{W1_SQL.format(g="derangement, patient_id, marker")}, errors AS (SELECT derangement, patient_id, marker, distance / scale AS e FROM w1 JOIN scales USING (marker))
SELECT patient_id, marker, round(avg(e) FILTER (derangement < 0), 6) AS matched_error, round(avg(e) FILTER (derangement >= 0), 6) AS wrong_patient_error,
  round(avg(e) FILTER (derangement >= 0) - avg(e) FILTER (derangement < 0), 6) AS gain FROM errors GROUP BY patient_id, marker""")
def matched_vs_wrong_patient_gain(spark, sf_dir):
    rows = cells(spark, sf_dir)
    weighed = long(_weighed(rows))
    gain = distance.patient_gain(weighed.where("modality = 'O'"), weighed.where("modality = 'F'"), _maps(spark, sf_dir), _target_scales(long(rows)))
    return rounded(gain, "matched_error", "wrong_patient_error", "gain")


STRATA_SQL = f"""{SCALE_SQL}, points AS (SELECT *, CASE WHEN modality = 'O' THEN 0 ELSE 1 END AS side, 1.0::DOUBLE AS w FROM long),
{W1_SQL.format(g="patient_id, specimen_id, cell_type, marker")}, per AS (
  SELECT patient_id, specimen_id, cell_type, marker, median(value) FILTER (side = 0) AS pm, median(value) FILTER (side = 1) AS tm FROM points
  GROUP BY ALL HAVING count(*) FILTER (side = 0) >= 5 AND count(*) FILTER (side = 1) >= 5
), strata AS (SELECT patient_id, specimen_id, cell_type, marker, pm, tm, distance / scale AS w1, abs(pm - tm) / scale AS me FROM per JOIN w1 USING (patient_id, specimen_id, cell_type, marker) JOIN scales USING (marker))"""


@query(f"""WITH {LONG_SQL}, {STRATA_SQL}, a AS (SELECT patient_id, specimen_id, cell_type, avg(w1) AS w1, avg(me) AS me FROM strata GROUP BY ALL),
b AS (SELECT patient_id, specimen_id, avg(w1) AS w1, avg(me) AS me FROM a GROUP BY ALL), c AS (SELECT patient_id, avg(w1) AS w1, avg(me) AS me FROM b GROUP BY ALL),
r AS (SELECT marker, rank() OVER (PARTITION BY marker ORDER BY pm) + (count(*) OVER (PARTITION BY marker, pm) - 1) / 2 AS x, rank() OVER (PARTITION BY marker ORDER BY tm) + (count(*) OVER (PARTITION BY marker, tm) - 1) / 2 AS y, pm, tm FROM strata),
rho AS (SELECT marker, CASE WHEN min(pm) < max(pm) AND min(tm) < max(tm) THEN corr(x, y) END AS rho FROM r GROUP BY marker)
SELECT round(avg(w1), 6) AS patient_first_w1, round(avg(me), 6) AS patient_first_median_error, (SELECT round(avg(rho), 6) FROM rho) AS macro_marker_median_spearman,
  (SELECT count(DISTINCT specimen_id) FROM strata) AS n_specimens, (SELECT count(DISTINCT patient_id) FROM strata) AS n_patients, (SELECT count(DISTINCT specimen_id || cell_type) FROM strata) AS n_strata FROM c""")
def population_metrics_patient_first(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return rounded(distance.population_metrics(_dealt(rows), _target_scales(long(rows))), "patient_first_w1", "patient_first_median_error", "macro_marker_median_spearman")


POINTS_SQL = f"""{SCALE_SQL}, sided AS (SELECT *, CASE WHEN modality = 'O' THEN 0 ELSE 1 END AS side, 1.0::DOUBLE AS w FROM long), points AS (
  SELECT 'stratified' AS view, patient_id, specimen_id, cell_type, marker, value, side, w FROM sided UNION ALL SELECT 'unstratified', patient_id, specimen_id, 'All', marker, value, side, w FROM sided
  UNION ALL SELECT 'pooled', 'pooled', 'pooled', cell_type, marker, value, side, w FROM sided UNION ALL SELECT 'pooled_unstratified', 'pooled', 'pooled', 'All', marker, value, side, w FROM sided)"""


@query(f"""WITH {LONG_SQL}, {POINTS_SQL}, {W1_SQL.format(g="view, patient_id, specimen_id, cell_type, marker")}, per AS (
  SELECT view, patient_id, specimen_id, cell_type, marker, median(value) FILTER (side = 0) AS pm, median(value) FILTER (side = 1) AS tm FROM points
  GROUP BY ALL HAVING count(*) FILTER (side = 0) >= 5 AND count(*) FILTER (side = 1) >= 5
), strata AS (SELECT view, patient_id, specimen_id, cell_type, marker, pm, tm, distance / scale AS w1, abs(pm - tm) / scale AS me FROM per JOIN w1 USING (view, patient_id, specimen_id, cell_type, marker) JOIN scales USING (marker)),
a AS (SELECT view, patient_id, specimen_id, cell_type, avg(w1) AS w1, avg(me) AS me FROM strata GROUP BY ALL), b AS (SELECT view, patient_id, specimen_id, avg(w1) AS w1, avg(me) AS me, count(*) AS n FROM a GROUP BY ALL),
c AS (SELECT view, patient_id, avg(w1) AS w1, avg(me) AS me, count(*) AS s, sum(n) AS n FROM b GROUP BY ALL),
r AS (SELECT view, marker, rank() OVER (PARTITION BY view, marker ORDER BY pm) + (count(*) OVER (PARTITION BY view, marker, pm) - 1) / 2 AS x, rank() OVER (PARTITION BY view, marker ORDER BY tm) + (count(*) OVER (PARTITION BY view, marker, tm) - 1) / 2 AS y, pm, tm FROM strata),
rho AS (SELECT view, avg(rho) AS rho FROM (SELECT view, marker, CASE WHEN min(pm) < max(pm) AND min(tm) < max(tm) THEN corr(x, y) END AS rho FROM r GROUP BY view, marker) GROUP BY view)
SELECT view, round(avg(w1), 6) AS patient_first_w1, round(avg(me), 6) AS patient_first_median_error, round(any_value(rho), 6) + 0.0 AS macro_marker_median_spearman, CAST(sum(s) AS BIGINT) AS n_specimens, count(*) AS n_patients, CAST(sum(n) AS BIGINT) AS n_strata
FROM c JOIN rho USING (view) GROUP BY view""")
def evaluation_views(spark, sf_dir):
    """Population metrics by specimen and label, without labels, pooled, and both, from one count of the cells."""
    rows = cells(spark, sf_dir)
    out = rounded(distance.evaluation_views(_dealt(rows), _target_scales(long(rows)), plain=long(_sides(rows))), "patient_first_w1", "patient_first_median_error", "macro_marker_median_spearman")
    return out.withColumn("macro_marker_median_spearman", F.col("macro_marker_median_spearman") + 0.0)  # of few strata it may be zero, of either sign


SPEARMAN_SQL = """r AS (SELECT {g}, {a}, {b}, rank() OVER (PARTITION BY {g} ORDER BY {a}) + (count(*) OVER (PARTITION BY {g}, {a}) - 1) / 2 AS x,
  rank() OVER (PARTITION BY {g} ORDER BY {b}) + (count(*) OVER (PARTITION BY {g}, {b}) - 1) / 2 AS y FROM {t}),
rho AS (SELECT {g}, CASE WHEN min({a}) < max({a}) AND min({b}) < max({b}) THEN corr(x, y) END AS spearman FROM r GROUP BY {g})"""


@query(f"""WITH {CELLS_SQL}, {SPEARMAN_SQL.format(g="modality, specimen_id", a="quantity", b="extendedprice", t="cells")}
SELECT modality, specimen_id, round(spearman, 6) AS spearman FROM rho""")
def spearman_by_specimen(spark, sf_dir):
    return rounded(ranks.spearman(cells(spark, sf_dir), ["modality", "specimen_id"], "quantity", "extendedprice"), "spearman")


@query(f"""WITH {CELLS_SQL}, r AS (SELECT patient_id, CASE WHEN cell_type = 'R' THEN 1 ELSE 0 END AS y, rank() OVER w + (count(*) OVER (PARTITION BY patient_id, discount) - 1) / 2 AS k FROM cells WINDOW w AS (PARTITION BY patient_id ORDER BY discount))
SELECT patient_id, round(CASE WHEN sum(y) BETWEEN 1 AND count(*) - 1 THEN (sum(k * y) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))) END, 6) AS auc FROM r GROUP BY patient_id""")
def auc_rank_sum(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("outcome", (F.col("cell_type") == "R").cast("int"))
    return rounded(ranks.auc(rows, ["patient_id"], "discount", "outcome"), "auc")


@query(f"""WITH {CELLS_SQL}, s AS (SELECT patient_id, quantity, sum(CASE WHEN cell_type = 'A' THEN 1.0::DOUBLE ELSE 0 END) AS tp, count(*) AS n FROM cells GROUP BY patient_id, quantity),
t AS (SELECT patient_id, tp, sum(tp) OVER w / sum(n) OVER w AS p, sum(tp) OVER (PARTITION BY patient_id) AS every FROM s WINDOW w AS (PARTITION BY patient_id ORDER BY quantity DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT patient_id, round(CASE WHEN max(every) > 0 THEN sum(tp / every * p) END, 6) AS auprc FROM t GROUP BY patient_id""")
def average_precision(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("outcome", (F.col("cell_type") == "A").cast("int"))
    return rounded(ranks.average_precision(rows, ["patient_id"], "quantity", "outcome"), "auprc")


@query(f"""WITH {CELLS_SQL}, q AS (SELECT *, ntile(5) OVER (PARTITION BY specimen_id ORDER BY quantity, cell_id) AS quintile FROM cells)
SELECT specimen_id, CAST(quintile AS INTEGER) AS quintile, count(*) AS n, round(avg(quantity), 6) AS signal_mean, round(avg(tax), 6) AS tax_mean, round(avg(discount), 6) AS discount_mean FROM q GROUP BY specimen_id, quintile""")
def quintile_profile(spark, sf_dir):
    return rounded(ranks.quintiles(cells(spark, sf_dir), ["specimen_id"], "quantity", ["tax", "discount"], ["cell_id"]), "signal_mean", "tax_mean", "discount_mean")


NULL_SQL = """pairs AS (SELECT c.modality, c.specimen_id, c.patient_id, 'extendedprice' AS marker, c.extendedprice AS truth, 1000.0::DOUBLE * c.quantity + 5000 * c.discount AS prediction, m.m AS null_prediction
  FROM cells c, (SELECT median(extendedprice) AS m FROM cells WHERE modality = 'O') m WHERE c.modality = 'F'
  UNION ALL SELECT c.modality, c.specimen_id, c.patient_id, 'quantity', c.quantity, c.extendedprice / 1000, m.m FROM cells c, (SELECT median(quantity) AS m FROM cells WHERE modality = 'O') m WHERE c.modality = 'F')"""


def _pairs(spark, sf_dir) -> DataFrame:
    """Truth, a rule's prediction and the fit median, for two markers."""
    rows = cells(spark, sf_dir)
    fit = F.broadcast(rows.where("modality = 'O'").agg(S.quantile("extendedprice", 0.5).alias("me"), S.quantile("quantity", 0.5).alias("mq")))  # one row
    both = F.explode(
        F.array(
            F.struct(F.lit("extendedprice").alias("marker"), F.col("extendedprice").alias("truth"), (1000.0 * F.col("quantity") + 5000 * F.col("discount")).alias("prediction"), F.col("me").alias("null_prediction")),
            F.struct(F.lit("quantity").alias("marker"), F.col("quantity").alias("truth"), (F.col("extendedprice") / 1000).alias("prediction"), F.col("mq").alias("null_prediction")),
        )
    )
    return rows.where("modality = 'F'").crossJoin(fit).select("modality", "specimen_id", "patient_id", both.alias("x")).select("modality", "specimen_id", "patient_id", "x.*")


@query(f"""WITH {LONG_SQL}, {ROBUST_SQL.format(keys="marker", where="WHERE modality = 'O'")}, {NULL_SQL}, {SPEARMAN_SQL.format(g="specimen_id, marker", a="truth", b="prediction", t="pairs")},
per AS (SELECT specimen_id, marker, count(*) AS n, avg(abs(prediction - truth)) AS mae, avg(abs(null_prediction - truth)) AS nmae,
  quantile_cont(truth, [0.25, 0.5, 0.75, 0.9]) AS t, quantile_cont(prediction, [0.25, 0.5, 0.75, 0.9]) AS p FROM pairs GROUP BY specimen_id, marker)
SELECT specimen_id, marker, n AS n_cells, round(mae, 8) AS mae, round(mae / scale, 8) AS normalized_mae, round(nmae, 8) AS null_mae, round(CASE WHEN nmae > 0 THEN 1 - mae / nmae END, 8) AS skill, round(spearman, 8) AS spearman,
  round(t[3] - t[1], 8) AS observed_iqr, round(p[3] - p[1], 8) AS predicted_iqr, round(CASE WHEN t[3] - t[1] > 0 THEN (p[3] - p[1]) / (t[3] - t[1]) END, 8) AS range_retention,
  round(abs(p[2] - t[2]) / scale, 8) AS normalized_median_error, round(abs(p[4] - t[4]) / scale, 8) AS normalized_q90_error FROM per JOIN rho USING (specimen_id, marker) JOIN robust USING (marker)""")
def marker_metrics_null_skill(spark, sf_dir):
    scales = S.robust_scale(long(cells(spark, sf_dir)).where("modality = 'O'"), ["marker"]).select("marker", "scale")
    out = metrics.marker_metrics(_pairs(spark, sf_dir), ["specimen_id", "marker"], scales)
    return rounded(out, *(c for c, t in out.dtypes if t == "double"), digits=8)


PRED_SQL = "labelled AS (SELECT patient_id, specimen_id, cell_id, cell_type AS label, CASE WHEN discount < 0.04 THEN 'A' WHEN quantity < 26 THEN 'N' ELSE 'R' END AS predicted, discount, quantity, tax FROM cells WHERE modality = 'F' OR cell_type <> 'N')"


def labelled(spark, sf_dir) -> DataFrame:
    rows = cells(spark, sf_dir).where("modality = 'F' OR cell_type <> 'N'")
    predicted = F.when(F.col("discount") < 0.04, "A").when(F.col("quantity") < 26, "N").otherwise("R")
    return rows.select("patient_id", "specimen_id", "cell_id", F.col("cell_type").alias("label"), predicted.alias("predicted"), "discount", "quantity", "tax")


@query(f"WITH {CELLS_SQL}, {PRED_SQL} SELECT patient_id, label, predicted, count(*) AS n FROM labelled GROUP BY ALL")
def confusion_long(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir), ["patient_id"])


CLASS_SQL = """classes AS (SELECT unnest(['A', 'N', 'R', 'Z']) AS class), groups AS (SELECT {g}, count(*) AS total FROM labelled GROUP BY {g}), counts AS (
  SELECT {g}, class, total, (SELECT count(*) FROM labelled l WHERE l.{g} = groups.{g} AND l.label = class) AS support,
    (SELECT count(*) FROM labelled l WHERE l.{g} = groups.{g} AND l.predicted = class) AS predicted_support,
    (SELECT count(*) FROM labelled l WHERE l.{g} = groups.{g} AND l.label = class AND l.predicted = class) AS hits FROM groups CROSS JOIN classes
), scores AS (SELECT {g}, class, label = class AS y, CASE class WHEN 'A' THEN 1 - discount WHEN 'N' THEN 1 - quantity / 50 WHEN 'R' THEN tax ELSE 0 END AS score FROM labelled CROSS JOIN classes),
steps AS (SELECT {g}, class, score, sum(CASE WHEN y THEN 1.0::DOUBLE ELSE 0 END) AS tp, count(*) AS n FROM scores GROUP BY ALL),
runs AS (SELECT {g}, class, tp, sum(tp) OVER w / sum(n) OVER w AS p, sum(tp) OVER (PARTITION BY {g}, class) AS every FROM steps WINDOW w AS (PARTITION BY {g}, class ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
ap AS (SELECT {g}, class, CASE WHEN max(every) > 0 THEN sum(tp / every * p) END AS auprc FROM runs GROUP BY ALL), rates AS (
  SELECT c.*, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r, CASE WHEN predicted_support > 0 THEN hits / predicted_support ELSE 0 END AS q, auprc FROM counts c JOIN ap USING ({g}, class)
), per AS (SELECT *, CASE WHEN r + q > 0 THEN 2.0 * q * r / (q + r) ELSE 0 END AS f1 FROM rates)"""
CLASSES = ["A", "N", "R", "Z"]


def _class_scores(rows: DataFrame, group: str) -> DataFrame:
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("class"), s.cast("double").alias("score")) for c, s in (("A", 1 - F.col("discount")), ("N", 1 - F.col("quantity") / 50), ("R", F.col("tax")), ("Z", F.lit(0.0))))))
    return rows.select(group, "label", each.alias("x")).select(group, "label", "x.*")


@query(f"""WITH {CELLS_SQL}, {PRED_SQL}, {CLASS_SQL.format(g="patient_id")}
SELECT patient_id, class, support, predicted_support, hits, total, round(CASE WHEN support > 0 THEN r END, 6) AS recall, round(CASE WHEN predicted_support > 0 THEN q END, 6) AS precision, round(f1, 6) AS f1, round(CASE WHEN support > 0 THEN auprc END, 6) AS auprc,
  round(support / total, 6) AS observed_prevalence, round(predicted_support / total, 6) AS predicted_prevalence, round(predicted_support / total - support / total, 6) AS prevalence_error FROM per""")
def biology_metrics_per_class(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    per, _ = metrics.label_metrics(rows, ["patient_id"], CLASSES, _class_scores(rows, "patient_id"))
    return rounded(per, *(c for c, t in per.dtypes if t == "double"))


@query(f"""WITH {CELLS_SQL}, {PRED_SQL}, {CLASS_SQL.format(g="patient_id")}
SELECT patient_id, round(sum(hits) / max(total), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN r END), 6) AS balanced_accuracy, round(avg(CASE WHEN support > 0 THEN f1 END), 6) AS macro_f1, round(avg(CASE WHEN support > 0 THEN auprc END), 6) AS macro_auprc FROM per GROUP BY patient_id""")
def biology_metrics(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    _, overall = metrics.label_metrics(rows, ["patient_id"], CLASSES, _class_scores(rows, "patient_id"))
    return rounded(overall, *(c for c, t in overall.dtypes if t == "double"))


@query(f"""WITH {CELLS_SQL}, {PRED_SQL}, {CLASS_SQL.format(g="patient_id")}
SELECT patient_id, round(sum(hits) / max(total), 6) AS accuracy, round(avg(CASE WHEN support > 0 THEN r END), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1, round(avg(CASE WHEN support > 0 THEN auprc END), 6) AS macro_auprc,
  round(avg(CASE WHEN support > 0 AND class IN ('N', 'R') THEN auprc END), 6) AS rare_macro_auprc FROM per GROUP BY patient_id""")
def probe_metrics(spark, sf_dir):
    rows = labelled(spark, sf_dir)
    _, overall = metrics.label_metrics(rows, ["patient_id"], CLASSES, _class_scores(rows, "patient_id"), variant="probe", subsets={"rare": ["N", "R"]})
    return rounded(overall, *(c for c, t in overall.dtypes if t == "double"))


@query(f"""WITH {CELLS_SQL} SELECT n AS label, count(c.cell_id) AS cells, count(DISTINCT specimen_id) AS specimens, count(DISTINCT patient_id) AS patients FROM (SELECT unnest(['A', 'Z']) AS n) LEFT JOIN cells c ON c.cell_type = n GROUP BY n""")
def rare_label_support(spark, sf_dir):
    return metrics.rare_support(cells(spark, sf_dir), ["A", "Z"])


ALPHAS = [0.0, 0.25, 0.5, 1.0]
CURVE_SQL = f"""{SCALE_SQL}, grid AS (SELECT unnest([0.0::DOUBLE, 0.25, 0.5, 1.0]) AS alpha), points AS (
  SELECT specimen_id, cell_type, marker, alpha, CASE WHEN modality = 'O' THEN 0 ELSE 1 END AS side, CASE WHEN modality = 'O' THEN value * 0.9 + alpha * (value * 0.2) ELSE value END AS value, 1.0::DOUBLE AS w FROM long CROSS JOIN grid WHERE cell_type <> 'N'
), {W1_SQL.format(g="specimen_id, cell_type, marker, alpha")}, curve AS (SELECT specimen_id, cell_type, marker, alpha, distance / scale AS error FROM w1 JOIN scales USING (marker))"""


def _curve(spark, sf_dir) -> DataFrame:
    wide = cells(spark, sf_dir)
    dealt = wide.where("cell_type <> 'N'").select("specimen_id", "modality", "cell_type", *MARKERS).repartition("specimen_id")
    sides = _sides(long(dealt)).withColumn("baseline", F.col("value") * 0.9).withColumn("residual", F.col("value") * 0.2)
    return metrics.residual_curve(sides, ["specimen_id", "cell_type", "marker"], _target_scales(long(wide)), ALPHAS)


@query(f"""WITH {LONG_SQL}, {CURVE_SQL}, means AS (SELECT marker, alpha, avg(error) AS error FROM curve WHERE error IS NOT NULL GROUP BY marker, alpha)
SELECT marker, min_by(alpha, (round(error, 9), alpha)) AS alpha, round(min(error), 6) AS error FROM means GROUP BY marker""")
def alpha_argmin(spark, sf_dir):
    means = _curve(spark, sf_dir).where("error is not null").groupBy("marker", "alpha").agg(F.avg("error").alias("error"))
    return rounded(ranks.least_on_grid(means.withColumn("error", F.round("error", 9)), ["marker"], "alpha", "error"), "error")


@query(f"""WITH {LONG_SQL}, {CURVE_SQL}, units AS (SELECT specimen_id, cell_type, marker, max(error) FILTER (alpha = 0) AS base, min(error) AS best, max(error) FILTER (alpha = 0.5) AS picked FROM curve WHERE error IS NOT NULL GROUP BY ALL)
SELECT marker, count(*) AS n, round(avg(base), 6) AS baseline_error, round(avg(base - best), 6) AS oracle_gain, round(avg(base - picked), 6) AS selected_gain FROM units GROUP BY marker""")
def uncertainty_units(spark, sf_dir):
    units = metrics.uncertainty_units(_curve(spark, sf_dir).where("error is not null"), ["specimen_id", "cell_type", "marker"], 0.5)
    out = units.groupBy("marker").agg(F.count(F.lit(1)).alias("n"), *(F.avg(c).alias(c) for c in ("baseline_error", "oracle_gain", "selected_gain")))
    return rounded(out, "baseline_error", "oracle_gain", "selected_gain")


SLICES = [[0.6, 0.8], [0.8, -0.6], [1.0, 0.0]]


@query(f"""WITH {CELLS_SQL}, dirs AS (SELECT unnest([1, 2, 3]) AS projection, unnest([0.6::DOUBLE, 0.8, 1.0]) AS a, unnest([0.8::DOUBLE, -0.6, 0.0]) AS b), points AS (
  SELECT specimen_id, projection, a / 10.0 * quantity + b / 10000.0 * extendedprice AS value, CASE WHEN modality = 'O' THEN 0 ELSE 1 END AS side, 1.0::DOUBLE AS w FROM cells CROSS JOIN dirs), {W1_SQL.format(g="specimen_id, projection")}
SELECT specimen_id, round(avg(distance), 4) AS sliced_w1 FROM w1 GROUP BY specimen_id""")
def sliced_wasserstein(spark, sf_dir):
    import numpy as np

    out = distance.sliced_wasserstein(_sides(cells(spark, sf_dir)), ["specimen_id"], "side", ["quantity", "extendedprice"], np.array(SLICES), {"quantity": 10.0, "extendedprice": 10000.0})
    return rounded(out, "sliced_w1", digits=4)


@query(f"""WITH {CELLS_SQL}, {DERANGE_SQL} SELECT derangement, patient_id, other AS wrong_patient FROM maps""")
def patient_derangements(spark, sf_dir):
    return _maps(spark, sf_dir).select("derangement", "patient_id", "wrong_patient")


@query(f"""WITH {CELLS_SQL}, {DERANGE_SQL}, broken AS (SELECT 1 AS derangement, patient_id, patient_id AS wrong FROM ranked UNION ALL SELECT 2, patient_id, 'n0' FROM ranked UNION ALL SELECT derangement + 10, patient_id, other FROM maps)
SELECT derangement, CASE WHEN derangement = 1 THEN 'fixed_point' ELSE 'no_bijection' END AS rule FROM broken WHERE derangement < 10 GROUP BY derangement""")
def derangement_violations(spark, sf_dir):
    patients = cells(spark, sf_dir).select("patient_id").distinct()
    broken = patients.select(F.lit(1).alias("derangement"), "patient_id", F.col("patient_id").alias("wrong_patient")).unionByName(patients.select(F.lit(2).alias("derangement"), "patient_id", F.lit("n0").alias("wrong_patient")))
    broken = broken.unionByName(_maps(spark, sf_dir).select((F.col("derangement") + 10).alias("derangement"), "patient_id", "wrong_patient"))
    return distance.derangement_violations(broken, patients)
