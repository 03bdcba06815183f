"""Suffix-array dedup: deep-shallow sorting over UTF-8 bytes.

Removes each byte that lies in a string of `window` bytes which also starts anywhere else, the same document
included. Suffixes are sampled at anchors; unlike units of one anchor have their suffixes (and reversed prefixes)
sorted by multikey quicksort to a shallow depth and by blind tries beyond it; repeats are read off the common
prefixes (suffixes.py, repeats.py).

Defined results: null text is empty; rows without doc_id are left out; doc_id is a key, and a row repeated whole is
returned as often as it comes (its bytes then repeat); other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import repeats, session

WINDOW = 200
CROWD = 1024  # units that share a seed and meet in one task
GRAM = 24


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "spans")}
        for doc, text, a, b in repeats.each_text(batch):
            edge = np.zeros(0, dtype=np.int64)
            if a:
                gone = repeats.covered(len(text), a, b)
                edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            edges = [0, *edge.tolist(), len(text)]
            kept = b"".join([text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)])
            for key, value in zip(out, (doc, len(text), len(text) - len(kept), len(edge) // 2, kept, edge.reshape(-1, 2).tolist()), strict=True):
                out[key].append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")), pa.array(out["kept"], pa.binary()), pa.array(out["spans"], pa.list_(pa.list_(pa.int32())))], names=list(out))


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: bytes that stay) and spans ([from, to) in bytes, maximal)."""
    session.prepare(docs.sparkSession)
    docs = session.id_and_text(docs)
    return repeats.cut(docs, repeats.Rule("bytes", window, gram, earlier=False, crowd=crowd)).mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, spans array<array<int>>")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = suffix_dedup(session.read(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_suffix_dedup": op10_suffix_dedup}
ORACLE_SQL = {
    "op10_suffix_dedup": """
WITH spelled AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, len(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents
), windows AS (
  SELECT doc_id, i, sha256(substr(h, 2 * i + 1, 400)) AS content
  FROM (SELECT doc_id, h, unnest(range(0, n - 199)) AS i FROM spelled WHERE n >= 200)
), again AS (
  SELECT content FROM windows GROUP BY content HAVING count(*) > 1
), hit AS (
  SELECT doc_id, i, i - 200 > lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NOT FALSE AS opens
  FROM windows SEMI JOIN again USING (content)
), numbered AS (
  SELECT doc_id, i, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit
), runs AS (
  SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM numbered GROUP BY doc_id, run
), pieces AS (
  SELECT s.doc_id, coalesce(lag(b) OVER (PARTITION BY s.doc_id ORDER BY a), 0) AS a, r.a AS b FROM spelled s JOIN runs r ON s.doc_id = r.doc_id
  UNION ALL
  SELECT s.doc_id, coalesce(max(r.b), 0), any_value(s.n) FROM spelled s LEFT JOIN runs r ON s.doc_id = r.doc_id GROUP BY s.doc_id
), kept AS (
  SELECT p.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS kept FROM pieces p JOIN spelled s ON p.doc_id = s.doc_id GROUP BY p.doc_id
), spans AS (
  SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS n_removed FROM runs GROUP BY doc_id
)
SELECT s.doc_id, s.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM spelled s LEFT JOIN spans p ON s.doc_id = p.doc_id LEFT JOIN kept k ON s.doc_id = k.doc_id
WHERE s.doc_id IS NOT NULL
"""
}
