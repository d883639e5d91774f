"""Queries over the driver's tables and their DuckDB counterparts."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "j7_hybrid_search"


def query(sql: str | None = None):
    """Register a function of (spark, sf_dir) under its name, with the SQL that gives the same rows."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


for _name in ("retrieval", "shaping", "structure", "changes", "watching", "details"):
    importlib.import_module(f"quillmap.plans.{_name}")
