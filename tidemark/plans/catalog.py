"""All queries of the key-value engine with their SQL."""

from __future__ import annotations

from . import block_queries, bytes_queries, state_queries, store_queries, txn_queries

QUERIES = state_queries.QUERIES | bytes_queries.QUERIES | block_queries.QUERIES | txn_queries.QUERIES | store_queries.QUERIES
ORACLE_SQL = (
    state_queries.ORACLE_SQL | bytes_queries.ORACLE_SQL | block_queries.ORACLE_SQL | txn_queries.ORACLE_SQL | store_queries.ORACLE_SQL
)
