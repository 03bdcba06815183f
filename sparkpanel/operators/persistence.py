"""Fitted models as plain files: JSON and NumPy arrays beside Spark ML's own format. Nothing is unpickled."""

from __future__ import annotations

import json
from pathlib import Path

import numpy as np

from .models import Classifier, Network, Ridge


def save_ridge(model: Ridge, path: str | Path) -> None:
    values = {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in vars(model).items()}
    Path(path).write_text(json.dumps(values), encoding="utf-8")


def load_ridge(path: str | Path) -> Ridge:
    values = json.loads(Path(path).read_text(encoding="utf-8"))
    return Ridge(**{k: np.array(v) if k in ("mean", "scale", "weights", "intercept") else v for k, v in values.items()})


def save_network(model: Network, path: str | Path) -> None:
    arrays = {f"{kind}{k}": a for k, layer in enumerate(model.layers) for kind, a in zip("wb", layer, strict=True)}
    np.savez(path, xm=model.xm, xs=model.xs, ym=model.ym, ys=model.ys, **arrays)


def load_network(path: str | Path) -> Network:
    model = Network()
    with np.load(path, allow_pickle=False) as f:
        model.xm, model.xs, model.ym, model.ys = (f[k] for k in ("xm", "xs", "ym", "ys"))
        model.layers = [[f[f"w{k}"], f[f"b{k}"]] for k in range(sum(n.startswith("w") for n in f.files))]
    return model


def save_classifier(model: Classifier, path: str | Path) -> None:
    path = Path(path)
    model.model.write().overwrite().save(str(path / "model"))
    (path / "about.json").write_text(json.dumps({k: v for k, v in vars(model).items() if k != "model"}), encoding="utf-8")


def load_classifier(path: str | Path) -> Classifier:
    from pyspark.ml.classification import LogisticRegressionModel

    about = json.loads((Path(path) / "about.json").read_text(encoding="utf-8"))
    return Classifier(model=LogisticRegressionModel.load(str(Path(path) / "model")), **about)
