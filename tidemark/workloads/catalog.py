"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib

MODULES = ["scalar_queries", "table_queries", "ranking_queries", "window_queries", "stage_queries"]

QUERIES: dict = {}
SQL: dict = {}
for _name in MODULES:
    _module = importlib.import_module(f"tidemark.workloads.{_name}")
    QUERIES.update(_module.QUERIES)
    SQL.update(_module.SQL)
