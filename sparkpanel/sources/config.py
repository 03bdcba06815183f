"""Run configurations: YAML files that may extend a parent, and small JSON files written whole."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Mapping
from pathlib import Path


def merged(base: Mapping, over: Mapping) -> dict:
    """base with over laid on it: mappings merge, anything else is replaced."""
    return {**base, **{k: merged(base[k], v) if isinstance(v, Mapping) and isinstance(base.get(k), Mapping) else v for k, v in over.items()}}


def load(path: str | Path) -> dict:
    """The configuration of a file, laid on that of the file named by its key `extends`, and so on."""
    import yaml

    path = Path(path)
    own = yaml.safe_load(path.read_text(encoding="utf-8")) or {}
    parent = own.pop("extends", None)
    return merged(load(path.parent / parent), own) if parent else own


def write_json(value: object, path: str | Path) -> None:
    """Writes beside the path, then renames: a reader sees the old file or the new one."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=path.parent, suffix=".part")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2, sort_keys=True)
        f.write("\n")
    os.replace(name, path)


def read_splits(path: str | Path) -> list[tuple[int, str, str, str]]:
    """(fold, role, patient, specimen) of a nested split file: folds with <role>_patients and <role>_specimens."""
    from ..functions.names import patient_id

    content = json.loads(Path(path).read_text(encoding="utf-8"))
    return [(int(f["fold_index"]), role, patient_id(s), s) for f in content["folds"] for role in ("train", "validation", "test") for s in f[f"{role}_specimens"]]


def write_splits(rows: list[tuple[int, str, str, str]], path: str | Path) -> None:
    """The nested form of split rows."""
    folds: dict[int, dict] = {}
    for fold, role, patient, specimen in rows:
        one = folds.setdefault(fold, {"fold_index": fold, **{f"{r}_{k}": set() for r in ("train", "validation", "test") for k in ("patients", "specimens")}})
        one[f"{role}_patients"].add(patient)
        one[f"{role}_specimens"].add(specimen)
    ordered = [{k: sorted(v) if isinstance(v, set) else v for k, v in folds[f].items()} for f in sorted(folds)]
    write_json({"specimens": sorted({r[3] for r in rows}), "folds": ordered}, path)
