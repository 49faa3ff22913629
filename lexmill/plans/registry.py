"""All queries of the engine's own operators."""

from __future__ import annotations

from lexmill.plans import library, records, search, texts

_MODULES = (search, texts, library, records)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLE_SQL = {name: sql for module in _MODULES for name, sql in module.ORACLE_SQL.items()}
