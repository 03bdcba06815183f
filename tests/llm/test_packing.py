"""op6: tokens against the tokenizers library, the plan against its own rules."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sparkpanel.llm import op6_packing as op6

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(pieces, capacity):
    by = collections.defaultdict(list)
    for r in pieces:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [2048, 16])
def test_pieces(table, awkward, capacity):
    data = [*awkward, (None, "no id", "en", "s", 0), (90, "<|endoftext|> text " * 3, "en", "s", 0), awkward[4]]
    got = [r.asDict() for r in op6.pack(table(data), PATH, capacity=capacity).collect()]
    library = Tokenizer.from_file(PATH)
    library.encode_special_tokens = True
    want = collections.Counter()
    for doc, text, *_ in data:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        at, size, k = 0, len(ids) if len(ids) <= capacity else len(ids) % capacity or capacity, 0
        while at < len(ids):
            want[(doc, k, at, size, zlib.crc32(np.array(ids[at : at + size], dtype="<u4").tobytes()))] += 1
            at, size, k = at + size, capacity, k + 1
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")) for r in got) == want
    sequences = check(got, capacity)
    total = sum(r["length"] for r in got)
    assert -(-total // capacity) <= sequences <= 1.25 * total / capacity + 1
    assert op6.pack(table([]), PATH).count() == 0


def greedy(counts, capacity):
    """Best fit, document by document, longest first."""
    free = []
    for length in sorted((x for x, n in counts.items() for _ in range(n)), reverse=True):
        fits = [f for f in free if f >= length]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - length)
        else:
            free.append(capacity - length)
    return len(free)


@pytest.mark.parametrize("seed", range(6))
def test_plan_over_counts_packs_as_document_by_document(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 50): rng.choice([1, 2, 7, 40]) for _ in range(25)}
    slots = op6.plan(counts, 50)
    pieces = [{"length": n, "sequence_id": s + k, "offset": o} for n, r, m, s, o in slots for k in range(m)]
    ranks = sorted((n, r + k) for n, r, m, _, _ in slots for k in range(m))
    assert ranks == sorted((n, k) for n, c in counts.items() for k in range(c))
    assert check(pieces, 50) == greedy(counts, 50)


def test_query_has_the_librarys_ids_at_its_default(spark, tmp_path):
    texts = ["<|endoftext|> text " * 3, "plain", "a<|endoftext|>", "<|endoftext|><|endoftext|>b <|endoftext|", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    library = Tokenizer.from_file(PATH)
    ids = {k: [*library.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    got = {r.doc_id: (r.length, r.ids_crc32) for r in op6.op6_best_fit_packing(spark, str(tmp_path)).collect()}
    assert got == {k: (len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())) for k, x in ids.items()} and 50256 in ids[0]
