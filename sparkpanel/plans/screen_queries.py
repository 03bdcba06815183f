"""Queries of screens: distances, fronts, coverage, neighbourhoods, subset skill, probes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import neighbours, screen, splits
from ..sources.cells import CELLS_SQL, LONG_SQL, cells, long, read
from . import probe
from .registry import query
from .statistics_queries import _sides, rounded


@query(f"""WITH {LONG_SQL}, m AS (SELECT specimen_id, marker, value, count(*) FILTER (modality = 'O') AS a, count(*) FILTER (modality = 'F') AS b FROM long GROUP BY ALL),
g AS (SELECT specimen_id, marker, sum(a) OVER o / sum(a) OVER e - sum(b) OVER o / sum(b) OVER e AS d, lead(value) OVER (PARTITION BY specimen_id, marker ORDER BY value) - value AS w FROM m WINDOW o AS (PARTITION BY specimen_id, marker ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), e AS (PARTITION BY specimen_id, marker))
SELECT specimen_id, marker, round(2 * sum(d * d * w), 6) AS energy FROM g GROUP BY specimen_id, marker""")
def energy_by_marker(spark, sf_dir):
    return rounded(screen.energy_distance(_sides(long(cells(spark, sf_dir))), ["specimen_id", "marker"]), "energy")


@query(f"""WITH {LONG_SQL} SELECT specimen_id, marker, round(abs(avg(CASE WHEN value > 0.04 THEN 1.0::DOUBLE ELSE 0 END) FILTER (modality = 'O') - avg(CASE WHEN value > 0.04 THEN 1.0::DOUBLE ELSE 0 END) FILTER (modality = 'F')), 6) AS error FROM long GROUP BY specimen_id, marker""")
def positive_fraction_error(spark, sf_dir):
    return rounded(screen.positive_fraction_error(_sides(long(cells(spark, sf_dir))), ["specimen_id", "marker"], 0.04), "error")


@query(f"""WITH {CELLS_SQL}, p AS (SELECT specimen_id, ntile(10) OVER (PARTITION BY specimen_id ORDER BY tax, cell_id) AS part, abs(extendedprice - 1000 * quantity) AS e FROM cells),
g AS (SELECT specimen_id, part, count(*) AS n, sum(e) AS e FROM p GROUP BY ALL)
SELECT specimen_id, CAST(part AS INTEGER) AS part, round(sum(n) OVER o / sum(n) OVER (PARTITION BY specimen_id), 6) AS coverage, round(sum(e) OVER o / sum(n) OVER o, 4) AS risk FROM g WINDOW o AS (PARTITION BY specimen_id ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def risk_coverage(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("error", F.abs(F.col("extendedprice") - 1000 * F.col("quantity")))
    out = screen.risk_coverage(rows, ["specimen_id"], "tax", "error", ["cell_id"])
    return rounded(rounded(out, "coverage"), "risk", digits=4)


PARTS_SQL = "panels AS (SELECT p_partkey AS panel, p_size AS size, p_partkey % 97 + p_size * 2 AS skill FROM part)"


@query(f"WITH {PARTS_SQL} SELECT panel, size, skill FROM panels p WHERE NOT EXISTS (SELECT 1 FROM panels q WHERE (q.size <= p.size AND q.skill > p.skill) OR (q.size < p.size AND q.skill >= p.skill))")
def pareto_front(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("panel"), F.col("p_size").alias("size"), (F.col("p_partkey") % 97 + F.col("p_size") * 2).alias("skill"))
    return screen.pareto_front(rows, "size", "skill")


@query(f"""WITH {CELLS_SQL}, s AS (SELECT specimen_id, avg(tax) - 0.04 - 0.003 AS ci_lower, avg(tax) - 0.04 + 0.003 AS ci_upper FROM cells GROUP BY specimen_id)
SELECT specimen_id, CASE WHEN ci_lower > 0.002 THEN 'recoverable' WHEN ci_lower > -0.002 AND ci_upper < 0.002 THEN 'equivalent' WHEN ci_lower > 0 THEN 'weakly_recoverable' WHEN ci_upper < 0 THEN 'harmful' ELSE 'inconclusive' END AS status FROM s""")
def marker_status(spark, sf_dir):
    rows = cells(spark, sf_dir).groupBy("specimen_id").agg((F.avg("tax") - 0.04 - 0.003).alias("ci_lower"), (F.avg("tax") - 0.04 + 0.003).alias("ci_upper"))
    return screen.marker_status(rows, margin=0.002).select("specimen_id", "status")


@query()
def subset_skill(spark, sf_dir):
    rows = cells(spark, sf_dir)
    return screen.subset_skill(rows.where("modality = 'O'"), rows.where("modality = 'F'"), ["quantity", "discount", "tax"], ["extendedprice"])


NEAR = """SELECT q.{g}, q.cell_id, b.cell_id AS near, {extra} FROM {table} q JOIN {table} b ON {on} AND q.cell_id <> b.cell_id
  QUALIFY row_number() OVER (PARTITION BY {part}, q.cell_id ORDER BY {d}, b.cell_id) <= {k}"""


def near_sql(features: list[str], k: int, groups: tuple[str, ...], extra: str, table: str = "cells") -> str:
    return NEAR.format(table=table, g=", q.".join(groups), extra=extra, on=" AND ".join(f"q.{g} = b.{g}" for g in groups), part=", ".join(f"q.{g}" for g in groups), d=" + ".join(f"(q.{f} - b.{f}) * (q.{f} - b.{f})" for f in features), k=k)


BOTH = ("modality", "specimen_id")


@query(f"""WITH {CELLS_SQL}, x AS ({near_sql(["quantity", "discount", "tax"], 10, BOTH, "1 AS one")}), y AS ({near_sql(["quantity", "discount"], 10, BOTH, "CASE WHEN q.cell_type = b.cell_type THEN 1.0 ELSE 0.0 END AS own")}),
j AS (SELECT modality, specimen_id, cell_id, count(*) FILTER (one IS NOT NULL AND own IS NOT NULL) / count(*) AS j, avg(own) AS p FROM x FULL JOIN y USING (modality, specimen_id, cell_id, near) GROUP BY ALL),
s AS (SELECT modality, specimen_id, count(*) AS n FROM cells GROUP BY ALL)
SELECT s.modality, s.specimen_id, any_value(n) AS n, round(CASE WHEN any_value(n) > 2 THEN avg(j) END, 12) AS jaccard, round(CASE WHEN any_value(n) > 2 THEN avg(p) END, 12) AS purity FROM s LEFT JOIN j ON s.modality = j.modality AND s.specimen_id = j.specimen_id GROUP BY ALL""")
def neighbourhood_agreement(spark, sf_dir):
    out = screen.neighbourhoods(cells(spark, sf_dir), list(BOTH), "cell_id", ["quantity", "discount", "tax"], ["quantity", "discount"], k=10, label="cell_type")
    return rounded(out, "jaccard", "purity", digits=12)  # means of simple fractions may end in a five


@query(f"""WITH {CELLS_SQL}, named AS (SELECT * REPLACE (modality || '-' || cell_id AS cell_id) FROM cells), x AS ({near_sql(["quantity", "discount", "tax"], 5, ("specimen_id",), "CASE WHEN q.modality = b.modality THEN 1.0 ELSE 0.0 END AS own", "named")}),
c AS (SELECT specimen_id, cell_id, avg(own) AS p FROM x GROUP BY ALL), s AS (SELECT specimen_id, count(*) AS n FROM cells GROUP BY specimen_id)
SELECT s.specimen_id, any_value(n) AS n, round(avg(p), 12) AS same_side FROM s LEFT JOIN c USING (specimen_id) GROUP BY s.specimen_id""")
def neighbour_two_sample(spark, sf_dir):
    rows = cells(spark, sf_dir).withColumn("cell_id", F.concat_ws("-", "modality", "cell_id"))  # a name over both modalities
    return rounded(screen.two_sample(rows, ["specimen_id"], "cell_id", "modality", ["quantity", "discount", "tax"]), "same_side", digits=12)


@query(f"""WITH {CELLS_SQL}, d AS (SELECT q.modality, q.specimen_id, q.cell_id, {" + ".join(f"(q.{f} - b.{f}) * (q.{f} - b.{f})" for f in ("quantity", "discount", "tax"))} AS d2 FROM cells q JOIN cells b ON q.modality = b.modality AND q.specimen_id = b.specimen_id AND q.cell_id <> b.cell_id),
k AS (SELECT *, row_number() OVER (PARTITION BY modality, specimen_id, cell_id ORDER BY d2) AS k FROM d)
SELECT modality, specimen_id, cell_id, round(sqrt(max(d2)), 6) AS radius FROM k WHERE k <= 15 GROUP BY ALL""")
def local_density(spark, sf_dir):
    """The distance of each cell's fifteenth nearest cell of its specimen and modality."""
    return rounded(neighbours.density(cells(spark, sf_dir), list(BOTH), "cell_id", ["quantity", "discount", "tax"], 15), "radius")


@query()
def cell_type_probe(spark, sf_dir):
    """Probes of the source's own representations, every patient scored by the fold that holds it out."""
    rows = cells(spark, sf_dir)
    source = rows.where("modality = 'O'").select("patient_id", "specimen_id", "cell_id", "cell_type", "quantity", "discount", "tax")
    return probe.in_order([probe.held_out(source, splits.hashed_folds(rows, 5, 5), ["quantity", "discount"], ["tax"], "cell_type", ["A", "N", "R"])[1]])
