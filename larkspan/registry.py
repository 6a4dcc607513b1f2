"""Every query of the engine by name, and the SQL that says the same."""

from __future__ import annotations

from larkspan import queries
from larkspan.queries import hybrid, storage, text, vectors

QUERIES, ORACLE_SQL = queries.QUERIES, queries.ORACLE_SQL

__all__ = ["ORACLE_SQL", "QUERIES", "hybrid", "storage", "text", "vectors"]
