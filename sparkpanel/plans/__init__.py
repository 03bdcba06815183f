"""Runs composed of operators, and the registered queries."""

from __future__ import annotations


def _registry():
    from . import design_queries, manifest_queries, model_queries, panel_queries, registry, screen_queries, source_queries, statistics_queries  # noqa: F401  their queries register themselves

    return registry


def queries() -> dict:
    return dict(_registry().QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_registry().SQL)
