"""All queries of the library with their DuckDB counterparts."""

from __future__ import annotations

from . import analytics, documents, evaluation, experiments, files, graph_store, graphs, grouping, language, library, linking, retrieval, rules, scoring, storage, text, tools, trees, usage  # noqa: F401
from .registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
