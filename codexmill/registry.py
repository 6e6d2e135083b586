"""All core queries and their SQL."""

from __future__ import annotations

import importlib

#: Modules with QUERIES (name -> callable) and SQL (name -> DuckDB text).
MODULES = ("plans.catalog", "plans.text", "plans.structure", "plans.ingest", "plans.relational", "plans.library", "plans.service")


def _merged(attr: str) -> dict:
    out: dict = {}
    for name in MODULES:
        out.update(getattr(importlib.import_module(f"codexmill.{name}"), attr))
    return out


def queries() -> dict:
    return _merged("QUERIES")


def oracle_sql() -> dict:
    return _merged("SQL")
