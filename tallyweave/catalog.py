"""Every query of the engine by name, with its SQL."""

from __future__ import annotations

from .plans import queries

QUERIES = queries.QUERIES
ORACLE_SQL = queries.SQL
