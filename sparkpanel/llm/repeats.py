"""Exact repeats of a fixed length, over words or bytes, without a row per position.

Every window of the fixed length selects an anchor from its own content (arrays.units), so equal windows have equal
anchors and lie in runs ("units"). Units of equal content, told by 128-bit BLAKE2 digests, collapse to a count and an
owner before anything is compared. What is left are unlike units of one anchor: their contexts are ordered to both
sides of the anchor (suffixes.deep_shallow), and a window is repeated where a class of equal right context meets a
class of equal left context.

The units that meet in one task share a seed. A seed is an anchor; where more than `crowd` unlike units share one, each
is dealt on longer seeds, which reach further to both sides and hold for a few places of the window each. A seed that
occurs once drops out without its content being moved, and one that is still shared by more than `crowd` is extended to
whole windows, which tasks sum up before they meet. So no group grows with the input, and no pairs are made in one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays as A
from . import session
from .suffixes import deep_shallow

U = np.uint64
STRETCHES = 6  # longer seeds of a unit
BLOCK = 1 << 18  # bytes of text that are looked at together


@dataclass(frozen=True)
class Rule:
    """What repeats: tokens, window length, and gram length of the anchors.

    tokens: "words" or "bytes". earlier: a window counts only if a document of smaller id has it, else if it
    starts anywhere else. crowd: so many units of one seed meet in a task at most.
    """

    tokens: str
    window: int
    gram: int
    earlier: bool
    crowd: int

    @property
    def reach(self) -> int:
        """Places that an anchor can have in a window."""
        return self.window - self.gram + 1

    @property
    def stretch(self) -> int:
        """Places for which a longer seed holds."""
        return -(-self.reach // STRETCHES)

    @property
    def size(self) -> int:
        """Bytes of a token where units are compared: of a word its code, which anchors are made of, and a 128-bit digest."""
        return 24 if self.tokens == "words" else 1

    def codes(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Token codes of a block, the offsets of its rows in tokens, and a buffer with the bytes of each token run."""
        if self.tokens == "bytes":
            places = np.arange(len(data) + 1)
            return A.BYTE_CODES[data], offsets, (data, places[:-1], places[1:])
        starts, ends, rows = A.words(data, offsets)
        return A.word_codes(data, starts, ends), rows, (data, starts, ends)

    def identity(self, spelled: tuple, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """128-bit digests of runs of tokens: their bytes, words with one space between."""
        data, starts, ends = spelled
        if self.tokens == "words":
            data, starts, ends = A.single_spaced(data, starts, ends)
        return A.digests(data, starts[begin], ends[stop - 1])

    def raw(self, codes: np.ndarray, spelled: tuple, spans: list[tuple[int, int]]) -> np.ndarray:
        """A text's tokens as fixed-size byte strings, laid end to end; only words within the spans are digested."""
        data, starts, ends = spelled
        if self.tokens == "bytes":
            return data
        out = np.zeros((len(codes), 3), dtype=">u8")
        out[:, 0] = codes
        at = np.flatnonzero(covered(len(codes), [a for a, _ in spans], [b for _, b in spans]))
        out[at, 1:] = A.digests(data, starts[at], ends[at])
        return out.view(np.uint8).reshape(-1)

    def codes_of(self, raw: np.ndarray) -> np.ndarray:
        return A.BYTE_CODES[raw] if self.tokens == "bytes" else raw.view(">u8").reshape(-1, 3)[:, 0].astype(U)

    def compared(self, raw: np.ndarray) -> np.ndarray:
        """A row of bytes for each token: equal rows for equal tokens. Words are numbered anew, from 1."""
        if self.tokens == "bytes":
            return raw[:, None]
        columns = raw.view(">u8").reshape(-1, 3)
        order = np.lexsort(columns.T)
        new = np.r_[True, (columns[order][1:] != columns[order][:-1]).any(axis=1)] if len(order) else np.zeros(0, dtype=bool)
        number = np.empty(len(order), dtype=">u4")
        number[order] = np.cumsum(new)
        return number.view(np.uint8).reshape(-1, 4)


def _unit_rows(rule: Rule, identify: bool):
    """Units of each text; only identify makes their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            data, offsets = A.utf8(batch.column("text"))
            for a, b in A.blocks(offsets, BLOCK):
                part = data[offsets[a] : offsets[b]]
                codes, rows, spelled = rule.codes(part, offsets[a : b + 1] - offsets[a])
                u = A.units(codes, rows, rule.window, rule.gram)
                columns = {"anchor": A.signed(u["anchor"]), "echo": u["echo"]}
                if identify:
                    same = rule.identity(spelled, u["begin"], u["stop"])
                    columns |= {"doc_id": ids[a:b][u["row"]].astype(np.int64), "first": u["first"].astype(np.int32), "last": u["last"].astype(np.int32)}
                    columns |= {f"u{k + 1}": A.signed(np.ascontiguousarray(same[:, k])) for k in (0, 1)}
                yield pa.RecordBatch.from_pydict(columns)

    return run


def _few(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows, few at a time: for what makes many rows, or wide ones, of each."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        data, offsets = A.utf8(batch.column("text"))
        whole = data.tobytes()
        packed = [squeeze(whole[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("named"), pa.array(packed, pa.binary())], names=["doc_id", "named", "packed"])


def _opened(column: pa.Array) -> list[bytes]:
    opened = zstandard.ZstdDecompressor().decompress
    return [opened(x) for x in column.to_pylist()]


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), dtype=np.uint8), np.r_[0, np.cumsum([len(x) for x in texts], dtype=np.int64)].astype(np.int64)


def _contents(rule: Rule):
    """Adds the tokens of the listed units, taken from the owner's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            listed = batch.column("units").to_pylist()
            texts = _opened(batch.column("packed"))
            for k, (doc, text) in enumerate(zip(batch.column("doc_id").to_pylist(), texts, strict=True)):
                data, offsets = _joined([text])
                codes, rows, spelled = rule.codes(data, offsets)
                mine = [x for x in listed[k] if x["last"] + rule.window <= rows[-1]]
                if not mine:
                    continue
                raw = rule.raw(codes, spelled, [(x["first"], x["last"] + rule.window) for x in mine])
                out = {key: [x[key] for x in mine] for key in ("anchor", "u1", "u2", "n", "kinds")}
                out |= {"doc_id": [doc] * len(mine)}
                content = [raw[x["first"] * rule.size : (x["last"] + rule.window) * rule.size].tobytes() for x in mine]
                yield pa.RecordBatch.from_arrays([*(pa.array(out[c], pa.int64()) for c in ("anchor", "u1", "u2", "n", "kinds", "doc_id")), pa.array(content, pa.binary())], names=["anchor", "u1", "u2", "n", "kinds", "doc_id", "content"])

    return run


@dataclass(frozen=True)
class Places:
    """The places of anchors in units, and the windows that select them: those that start low to high tokens before."""

    raw: np.ndarray
    at: np.ndarray  # where each unit starts, in tokens
    unit: np.ndarray
    position: np.ndarray
    low: np.ndarray
    high: np.ndarray


def anchor_places(rule: Rule, anchor: np.ndarray, content: list[bytes]) -> Places:
    lengths = np.array([len(c) // rule.size for c in content], dtype=np.int64)
    at = np.r_[0, np.cumsum(lengths)].astype(np.int64)
    raw = np.frombuffer(b"".join(content), dtype=np.uint8)
    grams = A.gram_hashes(rule.codes_of(raw), rule.gram)
    owner = np.repeat(np.arange(len(content)), lengths)[: len(grams)]
    hits = np.flatnonzero((grams == anchor.view(U)[owner]) & (np.arange(len(grams)) + rule.gram <= at[1:][owner]))
    unit = owner[hits]
    position = hits - at[unit]
    before = np.r_[-1, np.where(unit[1:] == unit[:-1], position[:-1], -1)] if len(hits) else position
    last = lengths[unit] - rule.window  # the unit's last window
    low = np.maximum(position - last, 0)  # a window selects the first place that its anchor has in it
    high = np.minimum(np.minimum(position - before - 1, position), rule.reach - 1)
    some = low <= high
    return Places(raw, at, unit[some], position[some], low[some], high[some])


def _contexts(tokens: np.ndarray, base: np.ndarray, before: np.ndarray, after: np.ndarray, ahead: int, back: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens from each place on, and those before it going backwards, as bytes; zero beyond the place's unit, which
    has so many tokens before and after it. Read through a sliding view: a place takes its own bytes and no index."""
    size = tokens.shape[1]
    padded = np.concatenate([np.zeros((back, size), np.uint8), tokens, np.zeros((ahead, size), np.uint8)])
    right = np.moveaxis(sliding_window_view(padded, ahead, axis=0)[base + back], 1, 2)
    right[np.arange(ahead)[None] >= after[:, None]] = 0
    left = np.moveaxis(sliding_window_view(padded, back, axis=0)[base], 1, 2)[:, ::-1]
    left[np.arange(back)[None] >= before[:, None]] = 0
    return right.reshape(len(base), -1), left.reshape(len(base), -1)


def repeated_windows(rule: Rule, seed: np.ndarray, anchor: np.ndarray, weight: np.ndarray, content: list[bytes]) -> list[list[tuple[int, int]]]:
    """For each unit the runs (first, last) of its windows that repeat among the units of its seed.

    weight: number of occurrences, or the owner's id where the rule looks for an earlier document.
    """
    reach = rule.reach
    found_at = anchor_places(rule, anchor, content)
    raw, at, unit, position, low, high = (getattr(found_at, f) for f in ("raw", "at", "unit", "position", "low", "high"))
    lengths = np.diff(at)
    out: list[list[tuple[int, int]]] = [[] for _ in content]
    if not len(unit):
        return out
    bucket = np.unique(seed[unit], return_inverse=True)[1]
    base, end = (at[unit] + position).astype(np.int32), at[unit] + lengths[unit]
    tokens = rule.compared(raw)
    size = tokens.shape[1]
    right, left = _contexts(tokens, base, base - at[unit], end - base, rule.window, max(reach - 1, 1))
    (ro, rs), (lo, ls) = deep_shallow(bucket, right), deep_shallow(bucket, left)
    rs, ls = rs // size, ls // size  # -1 stays below zero
    rank_r, rank_l = np.empty(len(unit), dtype=np.int64), np.empty(len(unit), dtype=np.int64)
    rank_r[ro] = rank_l[lo] = np.arange(len(unit))
    found = np.zeros((len(unit), reach), dtype=bool)
    w = weight[unit]
    for d in range(int(low.min()), int(high.max()) + 1):
        here = np.flatnonzero((low <= d) & (d <= high))
        if not len(here):
            continue
        cls = np.cumsum(rs < rule.window - d)[rank_r[here]] * (len(unit) + 1) + np.cumsum(ls < d)[rank_l[here]]
        by = np.argsort(cls, kind="stable")
        heads = np.flatnonzero(np.r_[True, cls[by][1:] != cls[by][:-1]])
        sizes = np.diff(np.r_[heads, len(by)])
        total = (np.minimum if rule.earlier else np.add).reduceat(w[here][by], heads)
        again = np.repeat(total, sizes)
        found[here[by], d] = again < w[here][by] if rule.earlier else again > 1
    for i in np.flatnonzero(found.any(axis=1)):
        ds = np.flatnonzero(found[i])
        cuts = np.flatnonzero(np.diff(ds) > 1)
        for a, b in zip(np.r_[ds[0], ds[cuts + 1]], np.r_[ds[cuts], ds[-1]], strict=True):
            out[unit[i]].append((int(position[i] - b), int(position[i] - a)))
    return out


PLACES = 1 << 14  # of anchors that are ordered together


def _pieces(rule: Rule, seed: np.ndarray, anchor: np.ndarray, content: list[bytes]) -> Iterator[tuple[int, int]]:
    """Runs of whole seeds with at most so many places of anchors together; a seed with more is a run of its own. In text
    of a short period a unit has its anchor at many places, so that bytes alone bound nothing."""
    places = np.r_[0, np.cumsum(np.bincount(anchor_places(rule, anchor, content).unit, minlength=len(seed)))]
    heads = np.flatnonzero(np.r_[True, seed[1:] != seed[:-1]])
    a = 0
    for k, b in enumerate(np.r_[heads[1:], len(seed)].tolist()):
        if places[b] - places[a] > PLACES and heads[k] > a:
            yield a, int(heads[k])
            a = int(heads[k])
    yield a, len(seed)


def _decide(rule: Rule, most: int = 2 << 20):
    """Runs repeated_windows over whole seeds; input is sorted by seed within a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        size = 0

        def solve(rows: pa.Table) -> pa.RecordBatch:
            seed, anchor = (rows.column(c).to_numpy().astype(np.int64) for c in ("seed", "anchor"))
            weight, base = rows.column("doc_id" if rule.earlier else "n").to_numpy(), rows.column("base").to_numpy()
            content = rows.column("content").to_pylist()
            runs = [r for a, b in _pieces(rule, seed, anchor, content) for r in repeated_windows(rule, seed[a:b], anchor[a:b], weight[a:b], content[a:b])]
            which = [k for k, r in enumerate(runs) if r]
            pick = lambda c: pa.array(rows.column(c).to_numpy()[which].astype(np.int64))
            sides = [pa.array([[x[s] + int(base[k]) for x in runs[k]] for k in which], pa.list_(pa.int32())) for s in (0, 1)]
            return pa.RecordBatch.from_arrays([pick("u1"), pick("u2"), *sides], names=["u1", "u2", "lo", "hi"])

        for batch in batches:
            kept.append(batch)
            size += batch.nbytes
            if size > most:
                rows = pa.Table.from_batches(kept)
                seed = rows.column("seed").to_numpy()
                whole = int(np.searchsorted(seed, seed[-1]))  # the last seed may go on
                if whole:
                    yield solve(rows.slice(0, whole))
                kept = rows.slice(whole).combine_chunks().to_batches()
                size = sum(b.nbytes for b in kept) if whole else size
        if kept:
            yield solve(pa.Table.from_batches(kept))

    return run


def _runs(dealt: DataFrame, rule: Rule) -> DataFrame:
    """dealt: seed, anchor, u1, u2, n, doc_id, base, content. u1, u2, lo, hi of units with repeated windows."""
    return dealt.repartition("seed").sortWithinPartitions("seed").mapInArrow(_decide(rule), "u1 long, u2 long, lo array<int>, hi array<int>")


def _longer_seeds(rule: Rule):
    """u1, u2, position, part, seed: for each place of an anchor, and each part of the windows that select it, the tokens
    that all of the part's windows hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            content = batch.column("content").to_pylist()
            p = anchor_places(rule, batch.column("anchor").to_numpy(), content)
            first, last = p.low // rule.stretch, p.high // rule.stretch
            of = np.repeat(np.arange(len(p.unit)), last - first + 1)
            part = np.arange(len(of)) - np.repeat(np.cumsum(last - first + 1) - (last - first + 1), last - first + 1) + first[of]
            least, most = part * rule.stretch, np.minimum((part + 1) * rule.stretch, rule.reach) - 1
            here = p.at[p.unit[of]] + p.position[of]
            digest = A.digests(p.raw, (here - least) * rule.size, (here + rule.window - most) * rule.size)[:, 0] if len(of) else np.zeros(0, dtype=U)
            out = {c: batch.column(c).to_numpy()[p.unit[of]] for c in ("u1", "u2")}
            out |= {"position": p.position[of].astype(np.int32), "part": part.astype(np.int32), "seed": A.signed(digest ^ part.astype(U))}
            yield pa.RecordBatch.from_pydict(out)

    return run


def _windows_of(rule: Rule, batch: pa.RecordBatch):
    """Of each listed part (its unit's row, seed and number of units) the first and last window, as places in the unit."""
    anchor, content = batch.column("anchor").to_numpy(), batch.column("content").to_pylist()
    p = anchor_places(rule, anchor, content)
    reaches = {(u, x): (lo, hi) for u, x, lo, hi in zip(p.unit.tolist(), p.position.tolist(), p.low.tolist(), p.high.tolist(), strict=True)}
    for k, parts in enumerate(batch.column("parts").to_pylist()):
        for x in parts:
            low, high = reaches[k, x["position"]]
            low, high = max(low, x["part"] * rule.stretch), min(high, (x["part"] + 1) * rule.stretch - 1)
            yield k, x["seed"], content[k], x["position"] - high, x["position"] - low


def _trimmed(rule: Rule):
    """A row for each listed part: its seed, and the unit's content cut to the part's windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = [(k, seed, a, text[a * rule.size : (b + rule.window) * rule.size]) for k, seed, text, a, b in _windows_of(rule, batch)]
            of = np.array([r[0] for r in rows], dtype=np.int64)
            same = [pa.array(batch.column(c).to_numpy()[of]) for c in ("anchor", "u1", "u2", "n", "doc_id")]
            columns = [pa.array([r[1] for r in rows], pa.int64()), *same, pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["seed", "anchor", "u1", "u2", "n", "doc_id", "base", "content"])

    return run


def _window_rows(rule: Rule):
    """A row for each window of the listed parts, with the digest of its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            found = [(k, text[x * rule.size : (x + rule.window) * rule.size], x) for k, _, text, a, b in _windows_of(rule, batch) for x in range(a, b + 1)]
            of = np.array([f[0] for f in found], dtype=np.int64)
            ends = np.cumsum([len(f[1]) for f in found], dtype=np.int64) if found else of
            digest = A.digests(np.frombuffer(b"".join([f[1] for f in found]), dtype=np.uint8), ends - rule.window * rule.size, ends) if found else np.zeros((0, 2), dtype=U)
            out = {"x": np.array([f[2] for f in found], dtype=np.int32)} | {f"w{k + 1}": A.signed(np.ascontiguousarray(digest[:, k])) for k in (0, 1)}
            out |= {c: batch.column(c).to_numpy()[of] for c in ("u1", "u2", "n", "doc_id")}
            yield pa.RecordBatch.from_pydict(out)

    return run


LAID = "seed long, anchor long, u1 long, u2 long, n long, doc_id long, base int, content binary"


def _longer(contents: DataFrame, rule: Rule) -> DataFrame:
    """Units of crowded anchors with their parts, by the longer seed, that other places share: some of them crowded still."""
    contents = contents.select("anchor", "u1", "u2", "n", "doc_id", "content")
    seeds = contents.mapInArrow(_longer_seeds(rule), "u1 long, u2 long, position int, part int, seed long")
    shared = session.dealt(seeds.groupBy(F.col("seed").alias("shared")).agg(F.count(F.lit(1)).alias("m")).where("m > 1"), "shared")
    parts = seeds.join(shared, F.col("seed") == F.col("shared")).select("u1", "u2", (F.col("m") > rule.crowd).alias("crowded"), F.struct("position", "part", "seed").alias("x"))
    listed = parts.groupBy(F.col("u1").alias("p1"), F.col("u2").alias("p2"), "crowded").agg(F.collect_list("x").alias("parts"))
    return session.written(contents.join(listed, (F.col("u1") == F.col("p1")) & (F.col("u2") == F.col("p2"))).drop("p1", "p2"))


def _window_runs(alive: DataFrame, rule: Rule) -> DataFrame:
    """_runs for the parts whose longer seeds are crowded, window by window."""
    rows = alive.where("crowded").mapInArrow(_window_rows(rule), "x int, w1 long, w2 long, u1 long, u2 long, n long, doc_id long")
    total = F.min("doc_id") if rule.earlier else F.sum("n")
    again = session.dealt(rows.groupBy("w1", "w2").agg(total.alias("total"), F.max("doc_id").alias("most")).where("most > total" if rule.earlier else "total > 1"), "w1")
    hit = rows.join(again.drop("most"), ["w1", "w2"])
    hit = (hit.where("total < doc_id") if rule.earlier else hit).groupBy("u1", "u2").agg(F.sort_array(F.collect_set("x")).alias("lo"))
    return hit.select("u1", "u2", "lo", F.col("lo").alias("hi"))


def packed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, named and the compressed text: what joins have to move. docs: as witnesses() makes them."""
    return docs.mapInArrow(_pack, _not_null("doc_id long, named boolean, packed binary", "doc_id", "named"))


def witnesses(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, text, named. Rows without an id are no one's smaller document; where any place counts they are there
    under a number of their own text's, not named."""
    if rule.earlier:
        return docs.where("doc_id is not null").select("doc_id", "text", F.lit(True).alias("named"))
    own = F.shiftrightunsigned(F.xxhash64("text"), 2).bitwiseOR(F.lit(-(1 << 63)))
    return docs.select(F.coalesce("doc_id", own).alias("doc_id"), "text", F.col("doc_id").isNotNull().alias("named"))


def _not_null(ddl: str, *names: str):
    from pyspark.sql import types as T

    schema = T._parse_datatype_string(ddl)
    return T.StructType([T.StructField(f.name, f.dataType, f.name not in names) for f in schema])


def repeated_spans(docs: DataFrame, packed: DataFrame, rule: Rule) -> DataFrame:
    """Token spans [a, b) that windows repeated under the rule cover, one list per document that has any.

    docs: witnesses(); packed: packed_texts of the same. Returns span_id (of the document), a array<int>, b array<int>;
    spans of a document may overlap and come in no order.
    """
    texts = docs.select("doc_id", "text")
    anchors = texts.mapInArrow(_unit_rows(rule, False), _not_null("anchor long, echo boolean", "anchor"))
    met = anchors.groupBy(F.col("anchor").alias("met")).agg(F.count(F.lit(1)).alias("n"), F.max("echo").alias("echoes")).where("n > 1" if rule.earlier else "n > 1 or echoes")
    met = session.dealt(met.select("met"), "met")
    every = texts.mapInArrow(_unit_rows(rule, True), _not_null("anchor long, echo boolean, doc_id long, first int, last int, u1 long, u2 long", "doc_id", "u1", "u2", "anchor"))
    occ = session.written(every.join(met, F.col("anchor") == F.col("met"), "leftsemi"))
    distinct = session.written(occ.groupBy("u1", "u2").agg(F.min("anchor").alias("anchor"), F.max("echo").alias("echo"), F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "first", "last")).alias("owner")))
    counts = F.count(F.lit(1)).alias("kinds")
    shared = distinct.groupBy(F.col("anchor").alias("shared")).agg(counts, F.min("n").alias("least"), F.max("echo").alias("echoes"))
    shared = shared.where("kinds > 1" if rule.earlier else "least = 1 and (kinds > 1 or echoes)").select("shared", "kinds")
    shared = session.written(shared)
    unlike = distinct.join(shared, F.col("anchor") == F.col("shared"))
    item = F.struct("anchor", "u1", "u2", "n", "kinds", F.col("owner.first").alias("first"), F.col("owner.last").alias("last"))
    owners = unlike.groupBy(F.col("owner.doc_id").alias("owner_id")).agg(F.collect_list(item).alias("units"))
    contents = packed.join(owners, F.col("doc_id") == F.col("owner_id")).select("doc_id", "packed", "units")
    contents = session.written(contents.mapInArrow(_contents(rule), "anchor long, u1 long, u2 long, n long, kinds long, doc_id long, content binary"))
    calm = contents.where(F.col("kinds") <= rule.crowd).select(F.col("anchor").alias("seed"), "anchor", "u1", "u2", "n", "doc_id", F.lit(0).alias("base"), "content")
    if shared.where(F.col("kinds") > rule.crowd).isEmpty():
        runs = _runs(calm, rule)
    else:
        longer = _longer(contents.where(F.col("kinds") > rule.crowd), rule)
        dealt = calm.unionByName(longer.where("not crowded").mapInArrow(_trimmed(rule), LAID))
        runs = _runs(dealt, rule).unionByName(_window_runs(longer, rule))
    runs = runs.groupBy(F.col("u1").alias("r1"), F.col("u2").alias("r2")).agg(F.flatten(F.collect_list("lo")).alias("lo"), F.flatten(F.collect_list("hi")).alias("hi"))
    marked = distinct.join(runs, (F.col("u1") == F.col("r1")) & (F.col("u2") == F.col("r2")), "left").where("n > 1 or lo is not null")
    marked = session.dealt(marked.select(F.col("u1").alias("m1"), F.col("u2").alias("m2"), F.col("owner.doc_id").alias("owner_id"), "n", "lo", "hi"), "m1")
    hit = occ.join(marked, (F.col("u1") == F.col("m1")) & (F.col("u2") == F.col("m2")))
    whole = F.col("doc_id") > F.col("owner_id") if rule.earlier else F.col("n") > 1
    first = F.col("first")
    full = F.array(first), F.array(F.col("last") + F.lit(rule.window))
    part = F.transform("lo", lambda x: x + first), F.transform("hi", lambda x: x + first + F.lit(rule.window))
    spans = hit.where(whole | F.col("lo").isNotNull()).select(F.col("doc_id").alias("span_id"), F.when(whole, full[0]).otherwise(part[0]).alias("a"), F.when(whole, full[1]).otherwise(part[1]).alias("b"))
    return spans.groupBy("span_id").agg(F.flatten(F.collect_list("a")).alias("a"), F.flatten(F.collect_list("b")).alias("b"))


def cut(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, packed, a, b of every row with an id: the compressed text, and the spans that go from it (null: none)."""
    seen = witnesses(docs, rule)
    packed = packed_texts(seen)
    spans = repeated_spans(seen, packed, rule)
    return packed.where("named").join(spans, F.col("doc_id") == F.col("span_id"), "left").select("doc_id", "packed", "a", "b")


def covered(n: int, a, b) -> np.ndarray:
    """Tokens of n that lie in any span."""
    edge = np.zeros(n + 1, dtype=np.int32)
    if a is not None and len(a):
        np.add.at(edge, np.minimum(np.asarray(a), n), 1)
        np.add.at(edge, np.minimum(np.asarray(b), n), -1)
    return np.cumsum(edge[:n]) > 0


def each_text(batch: pa.RecordBatch):
    """doc_id, text as bytes and covering spans of each row of packed texts joined with spans."""
    yield from zip(batch.column("doc_id").to_pylist(), _opened(batch.column("packed")), batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)
