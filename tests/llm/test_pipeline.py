"""Each stage on its own input, and run()."""

import random

import public_tokenizers
import pytest

import corpus_pipeline as pipeline
from sparkpanel.llm import op1_line_dedup, op2_mixing, op6_packing, op9_simhash_dedup
from tests.llm.conftest import DOCS, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    data, labels = [], []
    for k in range(240):
        good = k % 5 != 0
        text = "\n".join(words(rng, rng.randint(12, 40)) for _ in range(3))
        if not good:
            text = text.replace(" ", "### ")
        if k % 3 == 0:
            text += "\nshared footer line"
        data.append((k, text, "en", f"src{k % 11}", len(text)))
        if k % 2:
            labels.append((k, int(good), 0))
    copy = data[7][1]
    data += [(1000 + k, copy, "en", f"src{k % 12}", len(copy)) for k in range(30)]
    data += [(2000, None, "en", None, None), (2001, "", "en", "src1", 0), (None, words(rng, 30), "en", "src2", 5)]
    path = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(data, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = dict(pipeline.STAGES)
    out = {}
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{k}")
        out[name] = docs = spark.read.parquet(f"{tmp_path}/{k}")
        if name != "packing":
            assert docs.columns == list(pipeline.COLUMNS)
    ids = {n: sorted((r[0] for r in f.select("doc_id").collect()), key=repr) for n, f in out.items() if n != "packing"}
    kept = set(ids["quality classifier"])
    assert all((k in kept) == (k % 5 != 0) for k in range(240)) and {2000, 2001, None} <= kept and len([k for k in kept if k and k >= 1000]) == 32
    texts = {r.doc_id: r.text for r in out["line dedup"].collect()}
    assert ids["line dedup"] == ids["quality classifier"]
    assert texts[7] == {r.doc_id: r.text for r in out["quality classifier"].collect()}[7]  # the first copy keeps its lines
    assert sum("shared footer line" in (t or "") for t in texts.values()) == 1
    left = set(ids["SimHash near-dedup"])
    assert 7 in left and not any(1000 <= (k or 0) < 1030 for k in left if k != 1000 or texts[1000])
    assert {k for k in range(240) if k % 5} - left == set()
    assert ids["mixing"] == ids["SimHash near-dedup"]
    assert len({(r.doc_id) for r in out["packing"].collect()}) == len(left)
    assert steps["mixing"] is pipeline.mixing


def test_mixing_orders_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    order = [r.doc_id for r in pipeline.mixing(spark, docs, folder).collect()]
    want = [r.doc_id for r in op2_mixing.mix(docs.select(*pipeline.COLUMNS)).orderBy("slot", "place").collect()]
    assert order == want


def test_run_and_empty_table(spark, folder, tmp_path):
    assert pipeline.run(spark, folder).count() > 100
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_line_stage_updates_n_chars(spark):
    rows = [(k, f"same line\nown {k}", "en", f"s{k}", 17) for k in range(op1_line_dedup.SITES + 2)]
    got = pipeline.lines(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert {r.doc_id: r.n_chars for r in got if r.doc_id} == {k: len(f"own {k}") for k in range(1, len(rows))}


def test_near_copies_by_jaccard(spark, tmp_path):
    """Near copies of similarity 0.8 and more (five words) go, however far their fingerprints are apart; others stay."""
    rng = random.Random(23)
    texts = {}
    for k in range(60):
        base = words(rng, 150).split()
        texts[10 * k] = " ".join(base)
        for j in range(1, 4):
            other = list(base)
            for at in rng.sample(range(150), j):
                other[at] = f"changed{rng.randint(0, 10**9)}"
            texts[10 * k + j] = " ".join(other)
        texts[10 * k + 5] = " ".join(base[:105] + words(rng, 45).split())
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for k, t in texts.items()}
    pairs = [(a, b) for a in texts for b in texts if a < b and a // 10 == b // 10]
    alike = {(a, b) for a, b in pairs if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8}
    frame = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in texts.items()], DOCS)
    found = {r.doc_id: r.component_id for r in op9_simhash_dedup.near_copies(frame, pipeline.WORDS, pipeline.REACH, 0.8, block=3).collect()}
    linked = {(a, b) for a, b in pairs if found[a] == found[b]}
    root = {k: k for k in texts}
    for _ in range(5):
        for a, b in alike:
            root[a] = root[b] = min(root[a], root[b])
    assert len(alike) > 150 and len(linked & alike) >= 0.99 * len(alike)
    assert all(root[a] == root[b] for a, b in linked)  # only chains of verified pairs
    left = {r.doc_id for r in pipeline.near_duplicates(spark, frame, "").select("doc_id").collect()}
    assert left == {k for k in texts if found[k] == k}


def test_packing_follows_the_mix(spark, folder, tmp_path, monkeypatch):
    """run() changes with the weights, sequences come in the order of the mix, and pieces of a length as well."""
    sequences = {}
    for name, weights in (("a", {"src1": 50.0}), ("b", {"src2": 50.0})):
        stage = lambda spark, docs, at, w=weights: pipeline.mixing(spark, docs, at, w)
        monkeypatch.setattr(pipeline, "STAGES", [(n, stage if n == "mixing" else f) for n, f in pipeline.STAGES])
        rows = pipeline.run(spark, folder).collect()
        sequences[name] = {(r.doc_id, r.piece, r.sequence_id, r.offset) for r in rows}
    assert {x[:2] for x in sequences["a"]} == {x[:2] for x in sequences["b"]} and sequences["a"] != sequences["b"]
    docs = spark.createDataFrame([(k, "one two" if k % 3 else "one two three four", "en", f"src{k % 4}", 7) for k in range(400)], DOCS)
    pipeline.mixing(spark, docs, "", {"src1": 9.0, "src0": 1.0, "src2": 1.0, "src3": 1.0}).write.parquet(f"{tmp_path}/mixed")
    mixed = spark.read.parquet(f"{tmp_path}/mixed")
    want = [r.doc_id for r in op2_mixing.mix(docs, {"src1": 9.0, "src0": 1.0, "src2": 1.0, "src3": 1.0}).orderBy("slot", "place").collect()]
    placed = {r.doc_id: r["__position"] for r in pipeline.positions(mixed).collect()}
    assert [placed[k] for k in want] == list(range(400))
    got = op6_packing.pack(pipeline.positions(mixed), public_tokenizers.path("byte_bpe_50k.json"), capacity=16, position="__position").collect()
    heads = [placed[r.doc_id] for r in sorted(got, key=lambda r: r.sequence_id) if r.offset == 0]
    assert heads == sorted(heads) and sorted({r.sequence_id for r in got}) == list(range(len(heads)))


def test_rows_that_share_an_id_or_have_none(spark, tmp_path):
    """Each row is judged for itself: a kept row keeps no other, and a repeated id with other words is another document."""
    rng = random.Random(12)
    data, labels = [], []
    for k in range(200):
        text = words(rng, 60)
        data.append((k, text if k % 2 else text.replace(" ", "### "), "en", "s", 1))
        labels.append((k, k % 2, 0))
    good, junk = [words(rng, 60) for _ in range(4)], [words(rng, 60).replace(" ", "### ") for _ in range(4)]
    data += [(None, t, "en", "s", 1) for t in [*good[:2], *junk[:2]]] + [(900, t, "en", "s", 1) for t in [*good[2:], *junk[2:], good[2]]]
    spark.createDataFrame(data, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = pipeline.quality(spark, docs, str(tmp_path))
    odd = sorted((r.doc_id or 0, r.text) for r in kept.where("doc_id is null or doc_id = 900").collect())
    assert odd == sorted([(0, t) for t in good[:2]] + [(900, t) for t in [*good[2:], good[2]]])
    left = sorted((r.doc_id or 0, r.text) for r in pipeline.near_duplicates(spark, kept, "").where("doc_id is null or doc_id = 900").collect())
    assert left == sorted([(0, t) for t in good[:2]] + [(900, t) for t in good[2:]])
