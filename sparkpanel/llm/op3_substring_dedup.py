"""Substring dedup: seed and extend over words.

Documents meet on winnowed anchors; from each anchor the match is extended to both sides, and what a passage of at
least `window` words shares with a document of smaller id is removed (repeats.py has the method).

Defined results: null or empty text has no words; rows without doc_id are left out, since no row could name them;
doc_id is a key, and a row repeated whole is returned as often as it comes; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import repeats, session

WINDOW = 50
CROWD = 128  # units that share a seed and meet in one task
GRAM = 12


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("doc_id", "n_words", "n_removed", "kept", "spans")}
        for doc, text, a, b in repeats.each_text(batch):
            words = text.split()  # bytes split at [\x20\x09-\x0D] only
            gone = repeats.covered(len(words), a, b)
            edge = np.flatnonzero(np.diff(np.r_[False, gone, False].astype(np.int8)))
            kept = b" ".join(compress(words, ~gone))
            for key, value in zip(out, (doc, len(words), int(gone.sum()), kept.decode(), edge.reshape(-1, 2).tolist()), strict=True):
                out[key].append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(out[k], pa.int64()) for k in ("doc_id", "n_words", "n_removed")), pa.array(out["kept"], pa.string()), pa.array(out["spans"], pa.list_(pa.list_(pa.int32())))], names=list(out))


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_words, n_removed, kept (words that stay, joined by one space) and spans ([from, to) in words, maximal).

    docs: doc_id, text. A word goes if a window of so many words that covers it also starts in a document of
    smaller id.
    """
    session.prepare(docs.sparkSession)
    docs = session.id_and_text(docs)
    return repeats.cut(docs, repeats.Rule("words", window, gram, earlier=True, crowd=crowd)).mapInArrow(_cut, "doc_id long, n_words long, n_removed long, kept string, spans array<array<int>>")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup(session.read(spark, sf_dir, "documents"))
    return kept.selectExpr("doc_id", "n_words", "n_removed", "sha2(kept, 256) AS kept_sha256")


QUERIES = {"op3_substring_dedup": op3_substring_dedup}
ORACLE_SQL = {
    "op3_substring_dedup": """
WITH spelled AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL
), placed AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM spelled
), windows AS (
  SELECT doc_id, i, sha256(array_to_string(w[i : i + 49], ' ')) AS content
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM spelled WHERE len(w) >= 50)
), first AS (
  SELECT content, min(doc_id) AS owner FROM windows GROUP BY content
), hit AS (
  SELECT w.doc_id, w.i FROM windows w JOIN first f ON w.content = f.content WHERE f.owner < w.doc_id
), marked AS (
  SELECT p.doc_id, p.i, p.word,
    coalesce(p.i - max(h.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) < 50, false) AS gone
  FROM placed p LEFT JOIN hit h ON p.doc_id = h.doc_id AND p.i = h.i
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (WHERE gone) AS n_removed,
    coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '') AS kept
  FROM marked GROUP BY doc_id
)
SELECT s.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM spelled s LEFT JOIN kept k ON s.doc_id = k.doc_id
"""
}
