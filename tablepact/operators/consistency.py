"""Consistency and business checks on a table or between two tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.functions import predicates as P
from tablepact.functions.text import quoted, sql_literal
from tablepact.plans.shapes import Label, differing_digests, measure_rows, repeated_only, status_when

# Acceptance thresholds of a run; time and memory are those of LIMIT_ROWS rows.
MAX_SECONDS = 60.0
MAX_MEMORY_MB = 100.0
MIN_ROWS_PER_SECOND = 1000.0
LIMIT_ROWS = 100_000
EARLIEST_DATE = "1900-01-01"


def reconcile(source: DataFrame, output: DataFrame) -> DataFrame:
    """Source and output row counts with a verdict; equality wins, so 0 = 0 passes."""
    counts = source.agg(F.count(F.lit(1)).alias("source_count")).withColumn(
        "clean_count", output.agg(F.count(F.lit(1))).scalar())
    clean, raw = F.col("clean_count"), F.col("source_count")
    status = (F.when(clean == raw, "PASS").when(clean == 0, "FAIL")
              .when(clean < raw, "WARN").otherwise("ERROR"))
    note = (F.when(clean == raw, F.format_string("All %d rows processed", clean))
            .when(clean == 0, F.lit("No rows processed - pipeline may have failed silently"))
            .when(clean < raw, F.format_string(
                "Only %d/%d rows processed - some may have been filtered", clean, raw))
            .otherwise(F.format_string(
                "More clean rows (%d) than source (%d) - duplicate generation?", clean, raw)))
    return counts.select("source_count", "clean_count", status.alias("status"), note.alias("note"))


def null_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Null count and status per column, from one aggregation."""
    return measure_rows(df, [
        {"column_name": n, "null_count": F.count_if(F.col(quoted(n)).isNull())} for n in columns
    ]).withColumn("status", status_when(F.col("null_count") > 0))


def type_matrix(df: DataFrame, expected: Mapping[str, Sequence[str]]) -> DataFrame:
    """Type of the stored values of each column against the accepted type names."""
    found = measure_rows(df, [
        {"column_name": n, "actual_type": F.max(F.typeof(F.col(quoted(n)))),
         "expected_type": accepted[0], "_accepted": Label(f"array({', '.join(map(sql_literal, accepted))})")}
        for n, accepted in expected.items()])
    ok = F.array_contains("_accepted", F.col("actual_type"))
    return found.withColumn("status", status_when(~F.coalesce(ok, F.lit(False)))).drop("_accepted")


def violation_status(df: DataFrame, violations: Mapping[str, Column]) -> DataFrame:
    """One row per named violation: count and PASS/FAIL, all in one pass."""
    return measure_rows(df, [
        {"check_name": name, "violations": F.count_if(cond)} for name, cond in violations.items()
    ]).withColumn("status", status_when(F.col("violations") > 0))


def out_of_range(c: Column, low, high) -> Column:
    return (c < low) | (c > high)


def outside_values(c: Column, values: Sequence) -> Column:
    return ~c.isin(*values)


def _as_of(as_of: str | None) -> Column:
    return F.current_date() if as_of is None else F.lit(as_of).cast("date")


def out_of_date_range(c: Column, earliest: str = EARLIEST_DATE, as_of: str | None = None) -> Column:
    return (c < F.lit(earliest).cast("date")) | (c > _as_of(as_of))


def in_future(c: Column, as_of: str | None = None) -> Column:
    return c > _as_of(as_of)


def bad_email(c: Column, form: str = "like") -> Column:
    """``like``: not of the loose LIKE shape.  ``strict``: not a full match, null included."""
    if form == "like":
        return ~P.is_email_like(c)
    return ~F.coalesce(P.is_email_strict(c), F.lit(False))


def duplicate_keys(df: DataFrame, keys: Sequence[str], wide: bool = False) -> DataFrame:
    """Keys that occur more than once, with their row count.

    ``wide=True`` is for long keys such as whole texts: rows are first counted by
    digests, and a filter of the repeated ones is applied where the rows are read
    again, so that unique keys are not shuffled (see ``shapes.repeated_only``).
    The result is the same either way.
    """
    columns = [F.col(quoted(k)) for k in keys]
    rows = repeated_only(df.select(*columns), list(keys)) if wide else df
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("row_count")).filter(F.col("row_count") > 1)


def conditional_rule(when: Column, require: Column) -> Column:
    """Violated where the condition holds and the requirement does not (or is unknown)."""
    return F.coalesce(when, F.lit(False)) & ~F.coalesce(require, F.lit(False))


def active_needs_email(status: Column, email: Column) -> Column:
    usable = email.isNotNull() & (email != "") & P.is_email_like(email)
    return conditional_rule(status == "active", usable)


def unlikely_age(age: Column, status: Column) -> Column:
    return ((age < 18) & (status == "active")) | (age > 150)


def throughput_status(metrics: DataFrame, rows: str = "rows", seconds: str = "seconds",
                      memory_mb: str | None = None, max_seconds: float = MAX_SECONDS,
                      max_memory_mb: float = MAX_MEMORY_MB, min_rate: float = MIN_ROWS_PER_SECOND,
                      limit_rows: int = LIMIT_ROWS) -> DataFrame:
    """Rows per second and a verdict per run: PASS, WARN (slow) or FAIL (over time or memory).

    The limits are those of ``limit_rows`` rows and grow with the rows of larger runs.
    """
    r, s = F.col(rows), F.col(seconds)
    rate = F.when(s > 0, r / s)
    slow = rate <= min_rate
    share = F.greatest(F.lit(1.0), r / limit_rows)
    over = s >= max_seconds * share
    if memory_mb is not None:
        over = over | (F.col(memory_mb) >= max_memory_mb * share)
    return metrics.withColumn("rows_per_second", rate).withColumn(
        "performance_status", F.when(over, "FAIL").when(slow, "WARN").otherwise("PASS"))


def idempotency(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two runs gave the same rows, duplicates included.

    Rows are compared by their digests, and each run is read once.
    """
    return differing_digests(first, second).agg(F.count(F.lit(1)).alias("differing_rows")).withColumn(
        "status", status_when(F.col("differing_rows") > 0))


def severity_status(results: DataFrame) -> DataFrame:
    """Overall status by severity: a failed critical check fails, a failed high one warns.

    Unlike ``checks.summary``, medium failures do not count.
    """
    bad = F.col("status") == "FAIL"
    return results.agg(
        F.count_if(bad & (F.col("severity") == "critical")).alias("critical_failures"),
        F.count_if(bad & (F.col("severity") == "high")).alias("high_failures"),
    ).withColumn("overall_status",
                 F.when(F.col("critical_failures") > 0, "FAIL")
                 .when(F.col("high_failures") > 0, "WARN").otherwise("PASS"))
