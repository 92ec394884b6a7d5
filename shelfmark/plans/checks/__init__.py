"""Registered checks: every operator as a query over the driver tables.

Each module pairs a DataFrame built from the library's operators with the SQL
that must give the same rows.
"""


from shelfmark.plans.checks import bookmaps, cleanup, ingest, search, structure, text  # noqa: F401
from shelfmark.plans.checks.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
