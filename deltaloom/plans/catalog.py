"""All queries of the library and the SQL that gives the same rows."""

from __future__ import annotations

from deltaloom.plans import code, documents, extensions, facts, reasoning, relations, rows  # noqa: F401  (importing registers their queries)
from deltaloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
