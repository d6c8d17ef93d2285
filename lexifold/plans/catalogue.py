"""All registered queries of the engine with their DuckDB counterparts."""

from __future__ import annotations

from . import q_aggregates, q_maintenance, q_records, q_search, q_vectors

_PARTS = (q_search, q_records, q_aggregates, q_vectors, q_maintenance)


def queries():
    return {name: f for part in _PARTS for name, (f, _) in part.Q.items()}


def oracle_sql():
    return {name: sql for part in _PARTS for name, (_, sql) in part.Q.items() if sql}
