"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import importlib
import pkgutil

_MODULES = [importlib.import_module(f"{__package__}.{m.name}") for m in pkgutil.iter_modules(__import__(__package__, fromlist=["x"]).__path__) if m.name.startswith("op")]


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
