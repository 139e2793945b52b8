"""All queries and their SQL."""

from catalog import sample_queries, scan_queries

QUERIES = scan_queries.QUERIES
ORACLE = scan_queries.ORACLE
__all__ = ["ORACLE", "QUERIES", "sample_queries"]
