"""Named queries over the sample tables, each with the SQL it must agree with."""

from tablepact.catalogue import attempts, checking, cleaning, logs, profiling, robust, sources  # noqa: F401
from tablepact.catalogue.registry import ENTRIES, oracle_sql, queries

__all__ = ["ENTRIES", "oracle_sql", "queries"]
