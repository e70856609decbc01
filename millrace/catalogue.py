"""All queries of the catalogue: those over single operators, and those that serve pages and work."""

from __future__ import annotations

from millrace import serving_queries
from millrace.queries import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "serving_queries"]
