"""Deterministic sampling. A row's priority is the md5 of its key and a seed, so that neither the number of partitions nor
the order of rows changes a sample, and SQL can repeat it; ties go by key."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import kept

COUNTED = 1_000  # rows of a group, from which on groups are counted before they are cut
LARGE = 10_000  # groups to cut that go to every task


def priority(key: list[str], seed: int | str) -> Column:
    return F.md5(F.concat_ws("~", *key, F.lit(str(seed))))


def _first(rows: DataFrame, groups: list[str], n: int | Column, key: list[str], seed: int | str) -> DataFrame:
    w = W.partitionBy(*groups).orderBy(priority(key, seed), *key)
    return rows.withColumn("__rank", F.row_number().over(w)).where(F.col("__rank") <= n).drop("__rank")


def reservoir(rows: DataFrame, groups: list[str], n: int, key: list[str], seed: int | str) -> DataFrame:
    """At most n rows of each group, uniform without replacement.

    Where n is large, groups are counted first: only what belongs to larger ones is moved and ordered.
    """
    if n < COUNTED:
        return _first(rows, groups, n, key, seed)
    large = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > n).select(*(F.col(g).alias(f"__{g}") for g in groups))
    held = large.limit(LARGE + 1).collect()
    if not held:
        return rows
    if len(held) > LARGE:
        return _first(rows, groups, n, key, seed)
    table = rows.sparkSession.createDataFrame(held, large.schema)
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"__{g}"))
    rest, over = (rows.join(F.broadcast(table), same, how) for how in ("leftanti", "leftsemi"))
    return rest.unionByName(_first(over, groups, n, key, seed))


def sample(rows: DataFrame, n: int, key: list[str], seed: int | str) -> DataFrame:
    """At most n rows of all. A top-k over partitions, not a single-partition window."""
    return rows.orderBy(priority(key, seed), *key).limit(n)


def balanced_bank(rows: DataFrame, group: str, n: int, key: list[str], seed: int | str, within: list[str] | None = None) -> DataFrame:
    """At most n rows (of each combination of `within`): a quota of ceil(n / groups) a group, then a trim to n at random.

    Groups under their quota are not topped up. Where there are at most n rows all stay. Groups are counted first: of a
    large one only the rows with the least priorities are moved and ordered, a few more than its quota.
    """
    within = within or []
    sizes = rows.groupBy(*within, group).agg(F.count(F.lit(1)).alias("__n"))
    totals = sizes.groupBy(*within).agg(F.count(F.lit(1)).alias("__groups"), F.sum("__n").alias("__rows"))
    quota = F.when(F.col("__rows") <= n, F.col("__rows")).otherwise(F.ceil(F.lit(n) / F.col("__groups")))
    named = totals.withColumnsRenamed({c: f"__{c}" for c in within})
    met = sizes.join(F.broadcast(named), _same({c: f"__{c}" for c in within})) if within else sizes.crossJoin(F.broadcast(named))  # one row a combination
    cuts = kept(met.select(*(F.col(c).alias(f"__{c}") for c in [*within, group]), quota.cast("long").alias("__quota"), "__n"), "quotas")  # a row a group
    joined = rows.join(F.broadcast(cuts), _same({c: f"__{c}" for c in [*within, group]}))
    drop = ["__quota", "__n", *(f"__{c}" for c in [*within, group])]
    # priorities are uniform: more than eight deviations lie between the expected number under the bar and the quota
    bar = (F.col("__quota") + 8 * F.sqrt(F.col("__quota")) + 64) / F.col("__n") * (1 << 32)
    low = F.conv(F.substring(priority(key, seed), 1, 8), 16, 10).cast("long") < bar
    some = kept(joined.where(low), "bank")
    found = some.groupBy(*within, group).agg(F.count(F.lit(1)).alias("__found"))
    short = cuts.join(F.broadcast(found), _same({c: f"__{c}" for c in [*within, group]}), "left").where(F.coalesce("__found", F.lit(0)) < F.least("__quota", "__n"))
    drawn = _first(some if short.isEmpty() else joined, [*within, group], F.col("__quota"), key, seed).drop(*drop)
    return _first(drawn, within, n, key, f"{seed}-trim") if within else sample(drawn, n, key, f"{seed}-trim")


def _same(pairs: dict[str, str]) -> Column:
    out = F.lit(True)
    for a, b in pairs.items():
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def class_balanced(rows: DataFrame, label: str, group: str, n: int, key: list[str], seed: int | str) -> DataFrame:
    """balanced_bank within each label."""
    return balanced_bank(rows, group, n, key, seed, within=[label])


def probe_rows(rows: DataFrame, specimen: str, label: str, per_specimen: int, per_label: int, key: list[str], seed: int | str) -> DataFrame:
    """At most per_specimen rows of a label in a specimen, then at most per_label of a label."""
    return _first(_first(rows, [specimen, label], per_specimen, key, seed), [label], per_label, key, f"{seed}-total")


def shuffled_within(rows: DataFrame, groups: list[str], values: list[str], key: list[str], seed: int | str) -> DataFrame:
    """rows with the given columns permuted among the rows of a group; every other column stays in place.

    A row takes the values of the row whose place by priority is its own by key. Both stand side by side by their place, so
    that rows are moved once, or not at all where they are dealt by some of groups.
    """
    at = lambda *order: F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    placed = rows.withColumn("__k", at(*key)).withColumn("__j", at(priority(key, seed), *key))
    sides = placed.withColumn("__at", F.explode(F.array(F.struct(F.col("__k").alias("place"), F.lit(0).alias("side")), F.struct(F.col("__j").alias("place"), F.lit(1).alias("side")))))
    sides = sides.select(*(F.col(f"`{c}`") for c in rows.columns), F.col("__at.place").alias("__place"), F.col("__at.side").alias("__side"))
    meet = W.partitionBy(*groups, "__place").orderBy("__side")
    taken = sides.select("*", *(F.lead(v).over(meet).alias(f"__v{j}") for j, v in enumerate(values))).where("__side = 0")
    rest = [c for c in rows.columns if c not in values]
    return taken.select(*(F.col(f"`{c}`") for c in rest), *(F.col(f"__v{j}").alias(v) for j, v in enumerate(values)))


def uniform(key: list[str | Column], salt: str) -> Column:
    """A number in [0, 2**31) from the first eight hexadecimal digits of an md5."""
    digest = F.md5(F.concat_ws("~", *key, F.lit(salt)))
    return F.pmod(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"), F.lit(1 << 31))


def prior_draw(bank: DataFrame, queries: DataFrame, query_key: list[str], seed: int | str, key: list[str]) -> DataFrame:
    """For each query a row of the bank: a patient uniformly, one of its specimens uniformly, one of its cells uniformly.

    queries keep their columns; the drawn cell comes as columns patient_id, specimen_id and the rest of the bank.
    """
    patients = bank.select("patient_id").distinct().withColumn("__p", F.row_number().over(W.orderBy("patient_id")) - 1)
    specimens = bank.select("patient_id", "specimen_id").distinct().withColumn("__s", F.row_number().over(W.partitionBy("patient_id").orderBy("specimen_id")) - 1)
    per_specimen = bank.groupBy("specimen_id").agg(F.count(F.lit(1)).alias("__cells"))
    counted = specimens.join(specimens.groupBy("patient_id").agg(F.count(F.lit(1)).alias("__specimens")), "patient_id").join(per_specimen, "specimen_id")
    n_patients = patients.agg(F.count(F.lit(1)).alias("__patients"))
    q = queries.crossJoin(F.broadcast(n_patients)).withColumn("__p", F.pmod(uniform(query_key, f"{seed}-patient"), F.col("__patients")).cast("int"))
    q = q.join(F.broadcast(patients), "__p")
    first = counted.select("patient_id", "__specimens").distinct()
    q = q.join(F.broadcast(first), "patient_id").withColumn("__s", F.pmod(uniform(query_key, f"{seed}-specimen"), F.col("__specimens")).cast("int")).drop("__specimens")
    q = q.join(F.broadcast(counted.select("patient_id", "specimen_id", "__s", "__cells")), ["patient_id", "__s"])
    q = q.withColumn("__c", F.pmod(uniform(query_key, f"{seed}-cell"), F.col("__cells")).cast("int")).drop("patient_id")
    asked = q.select("specimen_id").distinct()  # cells of no other specimen are numbered
    cells = bank.join(asked, "specimen_id", "leftsemi").withColumn("__c", F.row_number().over(W.partitionBy("specimen_id").orderBy(*key)) - 1)
    return q.join(cells, ["specimen_id", "__c"]).drop("__p", "__s", "__c", "__cells", "__patients")


def stable_seed(*parts: object) -> int:
    """A 32-bit seed: the first four bytes, little-endian, of the SHA-256 of the parts joined by |."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:4], "little")


def stable_seed_column(*parts: Column | str) -> Column:
    digest = F.sha2(F.concat_ws("|", *parts), 256)
    little = F.concat(*(F.substring(digest, 2 * k + 1, 2) for k in (3, 2, 1, 0)))
    return F.conv(little, 16, 10).cast("long")


def hash_order(items, seed: int | str) -> list[str]:
    """Items by priority(), on the driver: the order that hashed tables have as well."""
    return sorted(items, key=lambda x: (hashlib.md5(f"{x}~{seed}".encode()).hexdigest(), x))


def derangement(patients: list[str], seed: int) -> dict[str, str]:
    """A map of patients onto each other without a fixed point: one cycle through all of them, in hash order."""
    if len(patients) < 2 or len(set(patients)) < len(patients) or any(not p.strip() for p in patients):
        raise ValueError("derangements need two or more unique, non-blank patients")
    cycle = hash_order(patients, seed)
    return {p: cycle[k - 1] for k, p in enumerate(cycle)}


def derangement_by_hash(patients: DataFrame, seed: int | str, shift: int = 1) -> DataFrame:
    """patient_id, wrong_patient: patients in hash order, each mapped to the one `shift` places on. Tables of patients are small."""
    order = patients.select("patient_id").distinct().withColumn("__k", F.row_number().over(W.orderBy(priority(["patient_id"], seed), "patient_id")) - 1)
    n = order.agg(F.count(F.lit(1)).alias("__n"))
    ahead = order.select(F.col("patient_id").alias("wrong_patient"), F.col("__k").alias("__to"))
    here = order.crossJoin(F.broadcast(n)).withColumn("__to", F.pmod(F.col("__k") + shift, F.col("__n")).cast("int"))
    return here.join(ahead, "__to").select("patient_id", "wrong_patient").where("patient_id <> wrong_patient")


def derangements_digest(maps: list[dict[str, str]]) -> str:
    import json

    return hashlib.sha256(json.dumps([dict(sorted(m.items())) for m in maps], sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def nested_subset(items: list[str], count: int, seed: int) -> list[str]:
    """The first count in hash order: subsets of growing count are nested."""
    return hash_order(items, seed)[:count]


def paired_targets(specimens: list[str], patient: dict[str, str], pairing: str, seed: int) -> list[str]:
    """Target specimen of each source specimen: its own (matched, unpaired), or one of another patient (shuffled).

    Shuffled: with a patient's specimens side by side and patients in hash order, each takes the one that stands as many
    places on as the largest patient has specimens, which is past its own patient's and not yet round to them again.
    """
    if pairing not in ("matched", "unpaired", "shuffled"):
        raise ValueError("pairing is matched, unpaired or shuffled")
    if pairing != "shuffled" or not specimens:
        return list(specimens)
    of: dict[str, list[str]] = {}
    for s in specimens:
        of.setdefault(patient[s], []).append(s)
    step = max(map(len, of.values()))
    if 2 * step > len(specimens):
        raise ValueError("a patient with more than half of the specimens cannot be paired with others")
    ring = [s for p in hash_order(of, seed) for s in hash_order(of[p], seed)]
    target = dict(zip(ring, ring[step:] + ring[:step], strict=True))
    return [target[s] for s in specimens]


def patient_prefix(patients: list[str], specimens: dict[str, list[str]], count: int | str, seed: int) -> list[str]:
    """All specimens of the first `count` patients ("all": every one) of a seeded order; prefixes are nested."""
    if count != "all" and (isinstance(count, bool) or not isinstance(count, int) or not 1 <= count <= len(patients)):
        raise ValueError(f"no valid number of patients: {count!r}")
    chosen = nested_subset(patients, len(patients) if count == "all" else count, seed)
    return sorted(s for p in chosen for s in specimens[p])


CONDITIONS = ("target_prior", "identity_blind_pooled", "patient_deranged", "patient_matched")


def pairing_conditions(target: DataFrame, budget: int, seed: int | str, derangements: int = 2, key: list[str] | None = None) -> DataFrame:
    """condition, derangement (null where there is none), patient_id, reference_patient, specimen_id, cell_id: the target
    cells that stand as a patient's reference under each of CONDITIONS, as many for every patient and condition.

    matched: cells of the patient's own; deranged: of another patient, by maps that are frozen by the seed; pooled: one bank
    of all patients alike, which knows no identity; prior: draws with repeats of a patient, a specimen and a cell, each
    uniform. Patients with fewer cells than the budget take part in no condition, neither side. target: patient_id,
    specimen_id, cell_id. The same cells of a patient serve its matched and its deranged rows, so that these differ by
    the patient alone.
    """
    key = key or ["specimen_id", "cell_id"]
    columns = ["patient_id", *key]
    enough = kept(target.groupBy("patient_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= budget).select("patient_id"), "patients")  # a row a patient, read often
    cells = target.select(*columns).join(enough, "patient_id", "leftsemi")
    own = kept(reservoir(cells, ["patient_id"], budget, key, seed), "own")
    shape = lambda frame, condition, number, reference: frame.select(F.lit(condition).alias("condition"), number.cast("int").alias("derangement"), "patient_id", reference.alias("reference_patient"), *key)
    none = F.lit(None)
    out = shape(own, "patient_matched", none, F.col("patient_id"))
    theirs = own.withColumnRenamed("patient_id", "wrong_patient")
    for shift in range(1, derangements + 1):
        out = out.unionByName(shape(theirs.join(derangement_by_hash(enough, seed, shift), "wrong_patient"), "patient_deranged", F.lit(shift - 1), F.col("wrong_patient")))
    bank = balanced_bank(cells, "patient_id", budget, key, f"{seed}-pool").withColumnRenamed("patient_id", "reference")
    out = out.unionByName(shape(bank.crossJoin(F.broadcast(enough)), "identity_blind_pooled", none, F.col("reference")))  # `budget` rows by a row a patient
    asked = enough.withColumnRenamed("patient_id", "asked").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(budget - 1))))
    drawn = prior_draw(cells, asked, ["asked", "draw"], f"{seed}-prior", key).withColumnRenamed("patient_id", "reference").withColumnRenamed("asked", "patient_id")
    return out.unionByName(shape(drawn, "target_prior", none, F.col("reference")))


def pairing_violations(rows: DataFrame, target: DataFrame, budget: int, key: list[str] | None = None) -> DataFrame:
    """rule, condition, patient_id of every broken rule of pairing conditions; no rows for what pairing_conditions makes."""
    key = key or ["specimen_id", "cell_id"]
    rule = lambda frame, name: frame.select(F.lit(name).alias("rule"), "condition", "patient_id").distinct()
    per = rows.groupBy("condition", "derangement", "patient_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("reference_patient").alias("p"), F.sum(F.xxhash64(*key).cast("decimal(38,0)")).alias("sum"))
    sums = per.where("condition = 'identity_blind_pooled'").agg(F.count_distinct("sum").alias("banks"))
    lacking = rows.select("condition", "patient_id").distinct().groupBy("patient_id").agg(F.collect_set("condition").alias("have")).where(F.size("have") < len(CONDITIONS))
    found = [
        rule(per.where(F.col("n") != budget), "budget_differs"),
        rule(rows.where("condition = 'patient_matched' and patient_id <> reference_patient"), "matched_to_another_patient"),
        rule(rows.where("condition = 'patient_deranged' and patient_id = reference_patient"), "deranged_to_itself"),
        rule(per.where("condition = 'patient_deranged' and p > 1"), "deranged_to_several_patients"),
        rule(rows.where("condition <> 'target_prior'").groupBy("condition", "derangement", "patient_id", *key).count().where("count > 1"), "cell_repeated"),
        rule(rows.join(target.select(F.col("patient_id").alias("reference_patient"), *key), ["reference_patient", *key], "leftanti"), "cell_of_no_target"),
        rule(per.where("condition = 'identity_blind_pooled'").crossJoin(F.broadcast(sums)).where("banks > 1"), "pool_differs_between_patients"),
        lacking.select(F.lit("condition_missing").alias("rule"), F.array_join("have", "+").alias("condition"), "patient_id"),
    ]
    out = found[0]
    for frame in found[1:]:
        out = out.unionByName(frame)
    return out
