"""Catalog status and read-only ad-hoc SQL."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.sources import guard

# Fixed value: rows of an ad-hoc result that are returned.
RESULT_ROWS = 100
# Statements that read metadata only and cannot stand inside a sub-select.
METADATA_STATEMENTS = ("show", "describe", "desc", "explain")


def count_tables(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Row count per table as one union of counts; a table without frame is an error."""
    parts = []
    for name, df in tables.items():
        if df is not None:
            parts.append(df.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("row_count"),
                                F.lit("ok").alias("status")))
    bad = [n for n, df in tables.items() if df is None]
    if bad:
        spark = SparkSession.getActiveSession()
        parts += [spark.range(0, 1, 1, 1).select(
            F.lit(n).alias("table"), F.lit(None).cast("bigint").alias("row_count"),
            F.lit("error").alias("status")) for n in bad]
    return reduce(DataFrame.unionAll, parts)


def _count_or_error(spark: SparkSession, name: str, df: DataFrame | None) -> DataFrame:
    try:
        return spark.createDataFrame(count_tables({name: df}).collect(), "table string, row_count bigint, status string")
    except Exception:  # a damaged file, for example
        return count_tables({name: None})


def table_status(spark: SparkSession, names: Sequence[str] | None = None) -> DataFrame:
    """Tables of the current database with their row counts.

    The counts are taken now, all together; if that fails, table by table, and the
    ones that fail are reported as errors.
    """
    if names is None:
        names = [t.name for t in spark.catalog.listTables()]
    found: dict[str, DataFrame | None] = {}
    for name in names:
        try:
            df = spark.table(name)
            df.schema  # noqa: B018  resolves the table; a broken one is reported, not raised
            found[name] = df
        except PySparkException:
            found[name] = None
    if not found:
        return spark.range(0).select(
            F.lit("").alias("table"), F.col("id").alias("row_count"), F.lit("ok").alias("status"))
    try:
        rows = count_tables(found).collect()  # one row per table
        return spark.createDataFrame(rows, "table string, row_count bigint, status string")
    except Exception:  # some table fails while it is counted: one by one
        return reduce(DataFrame.unionAll, [_count_or_error(spark, n, df) for n, df in found.items()])


@dataclass
class QueryResult:
    """Outcome of an ad-hoc query; ``rows`` is limited, ``frame`` is not.

    The query is run when its rows are first asked for, and then once: one row
    beyond the limit tells whether there are more, and only then has
    ``row_count`` to count them.
    """

    query: str
    columns: list[str]
    frame: DataFrame | None
    rows: DataFrame | None
    error: str | None = None
    limit: int = RESULT_ROWS
    _fetched: tuple[list, str | None] | None = field(default=None, repr=False)
    _count: int | None = field(default=None, repr=False)

    def _fetch(self) -> tuple[list, str | None]:
        if self._fetched is None:
            if self.frame is None:
                self._fetched = [], self.error
            else:
                try:
                    self._fetched = self.frame.limit(self.limit + 1).collect(), None
                except Exception as exc:  # run-time errors reach the driver as Java errors
                    self._fetched = [], str(exc).splitlines()[0]
        return self._fetched

    @property
    def truncated(self) -> bool | None:
        """Whether the result has more rows than ``rows`` holds; unknown if it failed."""
        found, error = self._fetch()
        return None if error is not None else len(found) > self.limit

    def execute(self) -> tuple[list, str | None]:
        """The limited rows, or no rows and the error met while running."""
        found, error = self._fetch()
        return found[:self.limit], error

    def row_count(self) -> int | None:
        """All rows of the result; none if it failed."""
        if self._count is None and self.truncated is not None:
            self._count = self.frame.count() if self.truncated else len(self._fetch()[0])
        return self._count


def run_query(spark: SparkSession, query: str, limit: int = RESULT_ROWS) -> QueryResult:
    """Run one read-only query.

    The text is placed inside a sub-select, where the grammar allows queries
    only: commands and inserts are refused before anything runs.  Of queries,
    those are refused that read files instead of tables and views, or that call
    foreign code, wherever a view or a sub-query hides it (see
    :mod:`tablepact.sources.guard`).  Errors of the analysis are returned;
    ``execute`` returns those of the run.
    """
    text = query.strip().rstrip(";")
    first_word = text.split(None, 1)[0].lower() if text else ""
    try:
        if first_word in METADATA_STATEMENTS:
            frame = spark.sql(text)
            guard.check_metadata(frame)
        else:
            frame = spark.sql(f"SELECT * FROM (\n{text}\n)")
            guard.check_query(frame)
        return QueryResult(query, frame.columns, frame, frame.limit(limit), None, limit)
    except guard.Refused as exc:
        return QueryResult(query, [], None, None, str(exc))
    except PySparkException as exc:
        message = exc.getMessage() or str(exc)
        return QueryResult(query, [], None, None, message)
