"""A whole translation as files: what a fit leaves, written and read by Spark, and predictions from it.

Every part is a small table below one folder, on any file system that Spark reaches: knots (marker, knots,
probabilities), numbers (part, k, shape, values: the ridge's and the network's arrays), gates (marker, alpha) and about
(names and settings). Nothing is unpickled, and nothing of the fit has to be at hand to predict.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.models import Network, Ridge, predict_network
from .runs import KEYS, Translation, to_percentiles

VERSION = 1
RIDGE = ("mean", "scale", "weights", "intercept")
NETWORK = ("xm", "xs", "ym", "ys")


@dataclass
class Translator:
    """A fitted translation of source cells to a target's own markers."""

    shared: list[str]
    source_only: list[str]
    targets: list[str]
    knots: DataFrame
    base: Ridge
    net: Network | None
    gates: dict[str, float]

    @classmethod
    def fit(cls, source: DataFrame, target: DataFrame, roles: DataFrame, spec, specimens: list[str] | None = None) -> Translator:
        """Fits over the train roles (the residual over the paired specimens given) and picks gates by validation."""
        run = Translation(source, target, roles, spec)
        net = run.residual(specimens)
        gates = {r["marker"]: float(r["alpha"]) for r in run.gates(net)[1].collect()}  # a row a marker
        return cls(spec.shared, spec.source_only, spec.target_only, run.knots["source"], run.base, net, {t: gates.get(t, 0.0) for t in spec.target_only})

    def predict(self, rows: DataFrame) -> DataFrame:
        """patient_id, specimen_id, cell_id and predicted_<target> of source cells with shared and own markers."""
        missing = sorted({*self.shared, *self.source_only} - set(rows.columns))
        if missing:
            raise ValueError(f"no such markers: {missing}")
        keep = ["patient_id", *KEYS]
        placed = to_percentiles(rows.select(*keep, *self.shared, *self.source_only), self.knots, self.shared)
        out = self.base.predict(placed)
        if self.net is not None and any(self.gates.values()):
            out = predict_network(out, self.net, [*self.shared, *self.source_only], [f"left_{t}" for t in self.targets])
            out = out.withColumns({f"predicted_{t}": F.col(f"predicted_{t}") + F.lit(self.gates[t]) * F.col(f"predicted_left_{t}") for t in self.targets})
        return out.select(*keep, *(f"predicted_{t}" for t in self.targets))

    def save(self, path: str) -> None:
        spark = self.knots.sparkSession
        arrays = [(f"ridge.{n}", 0, getattr(self.base, n)) for n in RIDGE]
        if self.net is not None:
            arrays += [(f"net.{n}", 0, getattr(self.net, n)) for n in NETWORK]
            arrays += [(f"net.{kind}", k, a) for k, layer in enumerate(self.net.layers) for kind, a in zip("wb", layer, strict=True)]
        numbers = spark.createDataFrame([(n, k, list(a.shape), np.asarray(a, dtype=float).ravel().tolist()) for n, k, a in arrays], "part string, k int, shape array<int>, values array<double>")
        about = {"version": VERSION, "shared": self.shared, "source_only": self.source_only, "targets": self.targets, "labels": self.base.labels, "label": self.base.label}
        tables = {
            "knots": self.knots,
            "numbers": numbers,
            "gates": spark.createDataFrame(list(self.gates.items()), "marker string, alpha double"),
            "about": spark.createDataFrame([(json.dumps(about, sort_keys=True),)], "about string"),
        }
        for name, frame in tables.items():
            frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Translator:
        about = json.loads(spark.read.parquet(f"{path}/about").first()[0])
        if about["version"] != VERSION:
            raise ValueError(f"a model of version {about['version']}")
        found = {(r["part"], r["k"]): np.array(r["values"]).reshape(r["shape"]) for r in spark.read.parquet(f"{path}/numbers").collect()}  # a row an array
        base = Ridge(about["shared"], about["targets"], about["labels"], *(found[f"ridge.{n}", 0] for n in RIDGE), about["label"])
        net = None
        if ("net.xm", 0) in found:
            net = Network()
            for n in NETWORK:
                setattr(net, n, found[f"net.{n}", 0])
            net.layers = [[found["net.w", k], found["net.b", k]] for k in range(sum(part == "net.w" for part, _ in found))]
        gates = {r["marker"]: r["alpha"] for r in spark.read.parquet(f"{path}/gates").collect()}
        return cls(about["shared"], about["source_only"], about["targets"], spark.read.parquet(f"{path}/knots"), base, net, gates)
