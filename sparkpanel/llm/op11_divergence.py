"""Source divergence audit: how far the words of each source lie from its language and from the language's other sources.

Within a language, the terms of at least LEAST documents are kept. A source (and the language as a whole) gives a kept
term p = 1 + floor(10**9 (count + 2) / (N + 2 V)), and two of them differ at that term by floor((p - q)**2 / (p + q)).

Terms, by upper-bound search: a source's terms of one count share p, and for p > q the difference only falls as q grows.
So a bucket (source, count) is bounded by the difference at the least q of its terms, and some term attains that bound.
Buckets go best first; once ten bounds are attained, what lies strictly below the tenth cannot hold one of the ten best,
and only terms of the buckets before it are evaluated.

Pairs, by postings: postings of a language are dealt to chunks of terms and pairs of blocks of sources. A term that no
source of a pair has adds what two counts of zero add, so a chunk sums the difference from that over its own terms,
and the first chunk adds the part of all V terms.

All arithmetic is on whole numbers: a quotient's numerator is a decimal(31,0), all other values fit a long.

Defined results: null text, lang and source are the empty string; every row is a document, repeated ones included, and
doc_id is not read; a (lang, source) without terms is a group like any other; with no kept term a language's pairs have
the value 0 and there are no term rows; a language of one source has no pairs; an empty table gives no rows; ties go to
the item of lesser UTF-8 bytes; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import session

LEAST = 10  # documents of a language that a kept term is in
TOP = 10  # terms reported a source
HELD = 1_000_000  # counters a task holds before it hands them on
CHUNK = 4096  # terms of a chunk
BLOCK = 64  # sources of a block
LETTERS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))  # A-Z lower-cased, what is in no term blank
COUNTED = "lang string, source string, term string, n long, docs long"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of each term of each group, summed within the task, and a row without a term for each group."""
    words: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), found in words.items():
            n = len(found) + 1
            terms = pa.array([*found, None], pa.binary()).cast(pa.string())
            counts, spread = [*found.values(), 0], [*map(docs[lang, source].__getitem__, found), 0]
            yield pa.RecordBatch.from_arrays([pa.array([x] * n, pa.string()) for x in (lang, source)] + [terms, pa.array(counts, pa.int64()), pa.array(spread, pa.int64())], names=["lang", "source", "term", "n", "docs"])
        words.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            terms = text.translate(LETTERS).split()
            words.setdefault((lang, source), Counter()).update(terms)
            docs.setdefault((lang, source), Counter()).update(set(terms))
        if sum(map(len, words.values())) > HELD:
            yield from rows()
    yield from rows()


def chance(count: str, total: str) -> str:
    """SQL of p, exact for counts of any size a long holds."""
    return f"1 + CAST(1000000000 AS DECIMAL(10,0)) * CAST({count} + 2 AS DECIMAL(20,0)) div CAST({total} AS DECIMAL(20,0))"


def difference(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def postings(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Postings (lang, source, term, n, p and the language's q) and groups (lang, source, g from 0 in the language, v
    kept terms, p0 of a count of zero), from docs (text, lang, source)."""
    session.prepare(docs.sparkSession)
    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    counted = read.mapInArrow(_counted, COUNTED).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")
    kept = counted.withColumns({"total": F.sum("n").over(term), "spread": F.sum("docs").over(term)})
    kept = session.written(kept.where(F.col("term").isNull() | (F.col("spread") >= least)).select("lang", "source", "term", "n", "total"))
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("all"))
    groups = kept.groupBy("lang", "source").agg(F.sum("n").alias("own"))
    groups = groups.join(langs.withColumnRenamed("lang", "of"), F.col("lang") == F.col("of")).withColumn("g", F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.select("lang", "source", "g", "v", (F.col("own") + 2 * F.col("v")).alias("held"), (F.col("all") + 2 * F.col("v")).alias("lang_held"))
    groups = session.written(groups.withColumn("p0", F.when(F.col("v") > 0, F.expr(chance("0", "held"))).otherwise(1)))
    named = groups.select(F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), "g", "v", "held", "lang_held")
    found = kept.where("term is not null").join(named, (F.col("lang") == F.col("of_lang")) & (F.col("source") == F.col("of_source")))
    found = found.select("lang", "source", "g", "v", "term", "n", F.expr(chance("n", "held")).alias("p"), F.expr(chance("total", "lang_held")).alias("q"))
    return session.written(found), groups


def top_terms(found: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, item, value, rank of the terms that a source overuses most, best first."""
    group = W.partitionBy("lang", "source")
    buckets = found.groupBy("lang", "source", "n").agg(F.first("p").alias("p"), F.min("q").alias("q"))
    bounds = buckets.where("p > q").select("lang", "source", "n", F.expr(difference("p", "q")).alias("bound"))
    bounds = bounds.withColumn("kth", F.nth_value("bound", top).over(group.orderBy(F.desc("bound"), "n").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    asked = bounds.where("kth is null or bound >= kth").select(F.col("lang").alias("l"), F.col("source").alias("s"), F.col("n").alias("c"))
    live = found.where("p > q").join(asked, (F.col("lang") == F.col("l")) & (F.col("source") == F.col("s")) & (F.col("n") == F.col("c")), "leftsemi")
    scored = live.select("lang", "source", F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
    return scored.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).where(F.col("rank") <= top)


def _pairs(rows: pd.DataFrame) -> pd.DataFrame:
    """Sums of one chunk over one pair of blocks; rows without a term name the sources and their p0."""
    marks = rows[rows["term"].isna()].sort_values("g")
    g, p0, blocks = marks["g"].to_numpy(), marks["p"].to_numpy(), marks["block"].to_numpy()
    found = rows[rows["term"].notna()]
    at, terms = pd.factorize(found["term"])
    table = np.repeat(p0[None], len(terms), axis=0)
    table[at, np.searchsorted(g, found["g"].to_numpy())] = found["p"].to_numpy()
    first, second = np.flatnonzero(blocks == blocks.min()), np.flatnonzero(blocks == blocks.max())
    every = marks["v"].to_numpy()[0] if rows["chunk"].iloc[0] == 0 else 0
    out = []
    for i in first:
        p, q = table[:, [i]], table[:, second]
        base = (p0[i] - p0[second]) ** 2 // (p0[i] + p0[second])
        sums = ((p - q) ** 2 // (p + q) - base).sum(axis=0) + every * base
        other = g[second] != g[i]
        out.append(pd.DataFrame({"i": g[i], "j": g[second][other], "value": sums[other]}))
    return pd.concat(out).assign(lang=rows["lang"].iloc[0])[["lang", "i", "j", "value"]]


def pairs(found: DataFrame, groups: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """lang, source, item (another source of the language), value, rank."""
    largest = groups.groupBy("lang").agg((F.floor(F.max("g") / block) + 1).alias("blocks")).withColumnRenamed("lang", "of")
    chunks = F.greatest(F.lit(1), F.ceil(F.col("v") / chunk))
    rows = found.select("lang", "g", "v", "term", "p", F.pmod(F.xxhash64("term"), chunks).alias("chunk"))
    marks = groups.select("lang", "g", "v", F.lit(None).cast("string").alias("term"), F.col("p0").alias("p"), F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"))
    dealt = rows.unionByName(marks).withColumn("block", F.floor(F.col("g") / block)).join(largest, F.col("lang") == F.col("of"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("lang", "chunk", F.least("block", "with").alias("a"), F.greatest("block", "with").alias("b"), "block", "g", "v", "term", "p")
    sums = dealt.groupBy("lang", "chunk", "a", "b").applyInPandas(_pairs, "lang string, i long, j long, value long")
    # within a block both orders are there, between two blocks one is
    sums = sums.withColumn("turn", F.explode(F.when(F.floor(F.col("i") / block) == F.floor(F.col("j") / block), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    sums = sums.select("lang", F.when(F.col("turn"), F.col("j")).otherwise(F.col("i")).alias("i"), F.when(F.col("turn"), F.col("i")).otherwise(F.col("j")).alias("j"), "value")
    sums = sums.groupBy("lang", "i", "j").agg(F.sum("value").alias("value"))
    names = groups.select(F.col("lang").alias("of"), "g", "source")
    sums = sums.join(names, (F.col("lang") == F.col("of")) & (F.col("i") == F.col("g"))).drop("of", "g")
    sums = sums.join(names.withColumnRenamed("source", "item"), (F.col("lang") == F.col("of")) & (F.col("j") == F.col("g"))).drop("of", "g")
    return sums.select("lang", "source", "item", "value", F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank"))


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value (long), rank (int). docs: text, lang, source."""
    found, groups = postings(docs, least)
    parts = [frame.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")) for part, frame in (("pair", pairs(found, groups)), ("term", top_terms(found, top)))]
    return parts[0].unionByName(parts[1])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(session.read(spark, sf_dir, "documents"))


QUERIES = {"op11_source_divergence": op11_source_divergence}
ORACLE_SQL = {
    "op11_source_divergence": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), counted AS (
  SELECT k, lang, source, term, count(*) AS n FROM (SELECT k, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::BIGINT AS total FROM counted GROUP BY lang, term HAVING count(*) >= {LEAST}
), langs AS (
  SELECT l.lang, coalesce(v, 0) AS v, coalesce(held, 0) AS held
  FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN (SELECT lang, count(*) AS v, sum(total) AS held FROM kept GROUP BY lang) k ON l.lang = k.lang
), owned AS (
  SELECT c.lang, c.source, c.term, sum(c.n)::BIGINT AS n FROM counted c SEMI JOIN kept k ON c.lang = k.lang AND c.term = k.term GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(h.held, 0) AS held
  FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN (SELECT lang, source, sum(n) AS held FROM owned GROUP BY ALL) h ON g.lang = h.lang AND g.source = h.source
), given AS (
  SELECT g.lang, g.source, k.term, coalesce(o.n, 0) AS n,
    (1 + (1000000000::HUGEINT * (coalesce(o.n, 0) + 2)) // (g.held + 2 * l.v))::HUGEINT AS p,
    (1 + (1000000000::HUGEINT * (k.total + 2)) // (l.held + 2 * l.v))::HUGEINT AS q
  FROM groups g JOIN langs l ON g.lang = l.lang JOIN kept k ON g.lang = k.lang
  LEFT JOIN owned o ON g.lang = o.lang AND g.source = o.source AND k.term = o.term
), paired AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM given a JOIN given b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), scored AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN paired p ON a.lang = p.lang AND a.source = p.source AND b.source = p.item
  UNION ALL
  SELECT lang, source, 'term', term, (((p - q) * (p - q)) // (p + q))::BIGINT FROM given WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM scored
)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
}
