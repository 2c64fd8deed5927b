"""The registered queries and their SQL."""

from __future__ import annotations

from . import queries_link, queries_prepare, queries_vectors

QUERIES = queries_vectors.QUERIES | queries_prepare.QUERIES | queries_link.QUERIES
ORACLE_SQL = queries_vectors.ORACLE_SQL | queries_prepare.ORACLE_SQL | queries_link.ORACLE_SQL
