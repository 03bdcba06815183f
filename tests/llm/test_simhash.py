"""op9 against all pairs of fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash

from sparkpanel.llm import op9_simhash_dedup as op9
from sparkpanel.llm import vptree
from sparkpanel.llm.components import components


def brute(rows, words, reach):
    prints = {}
    for doc, text, *_ in rows:
        parts = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        shingles = [b" ".join(parts[i : i + words]) for i in range(max(1, len(parts) - words + 1))] if parts else []
        codes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        prints[doc] = sum(1 << b for b in range(64) if 2 * sum(c >> b & 1 for c in codes) > len(codes))
    ids = sorted(prints)
    root = {d: d for d in ids}
    moved = True
    while moved:
        moved = False
        for a in ids:
            for b in ids:
                if (prints[a] ^ prints[b]).bit_count() <= reach and root[a] != root[b]:
                    root[a] = root[b] = min(root[a], root[b])
                    moved = True
    return {d: (prints[d], root[d]) for d in ids}


@pytest.mark.parametrize("words,reach,shard", [(3, 2, 16_384), (5, 9, 5)])
def test_components(table, awkward, words, reach, shard):
    rng = random.Random(1)
    base = awkward[4][1].split()
    near = [(100 + k, " ".join(base[: rng.randint(200, 300)]), "en", "s", 0) for k in range(20)]
    data = [*awkward, *near, (None, "no id", "en", "s", 0)]
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in op9.near_duplicates(table(data), words, reach, shard).collect()}
    assert got == brute(data[:-1], words, reach)


def test_query_and_edges(spark, tmp_path, table, awkward):
    table([*awkward, awkward[4]]).write.parquet(f"{tmp_path}/documents.parquet")
    got = op9.op9_simhash_dedup(spark, str(tmp_path)).collect()
    assert len(got) == len(awkward) + 1
    want = brute(awkward, 3, 2)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(d, f"{f:016x}", c) for d, (f, c) in want.items()}
    assert op9.near_duplicates(table([])).count() == 0


def test_trees_lose_no_pair():
    rng = np.random.default_rng(5)
    centres = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    points = np.unique(np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, 12).astype(np.uint64)) for c in centres] + [centres]))
    for reach in (1, 2, 4):
        near = np.bitwise_count(points[:, None] ^ points[None]) <= reach
        label = np.arange(len(points))
        while True:
            low = np.where(near, label[None], len(points)).min(axis=1)
            if (low == label).all():
                break
            label = low
        for small in (4, 64, 10_000):
            assert (vptree.links(points, reach, small) == points[label]).all()
        tree = vptree.grow(points, reach, 4)
        met = np.zeros_like(near)
        for _, at in vptree.route(tree, points, reach):
            met[np.ix_(at, at)] = True
        assert (met | ~near).all()


def test_connected_components_of_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100 + k, 100) for k in range(1, 30)] + [(200, 200), (-5, 300)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 130), 100), -5: -5, 300: -5}
