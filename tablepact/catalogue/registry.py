"""Registry of named queries."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tablepact.plans.ordered import checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    run: Query
    covers: tuple[str, ...]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register a query with the inventory rows it covers and its reference SQL."""
    def register(run: Query) -> Query:
        if name in ENTRIES:
            raise ValueError(f"duplicate query {name}")
        ENTRIES[name] = Entry(name, run, tuple(covers.split()), sql)
        return run
    return register


def queries() -> dict[str, Query]:
    return {name: entry.run for name, entry in ENTRIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: entry.sql for name, entry in ENTRIES.items() if entry.sql}


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared area, for queries that go through files."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tablepact-{label}-{uuid.uuid4().hex}"


def union_counts(source: str, rows: list[tuple[str, str]], label: str = "check_id",
                 count: str = "actual") -> str:
    """Reference SQL: one count per (label, condition) over a common table ``t``."""
    parts = [
        f"SELECT '{name}' AS {label}, count(*) FILTER (WHERE {condition}) AS {count} FROM t"
        for name, condition in rows]
    return f"WITH t AS (SELECT * FROM {source}) " + " UNION ALL ".join(parts)
