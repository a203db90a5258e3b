"""Checks generated from a contract, run together in one aggregation.

A check is a SQL condition that marks a violating row (or no condition: count
all rows) and an expectation on the count.  Conditions are plain text, so checks
can be stored, reloaded and extended by hand; however many there are, one scan
evaluates them all.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import TableContract
from tablepact.functions import predicates as P
from tablepact.functions.text import quoted, sql_literal
from tablepact.functions.types import (
    DATE_LIKE_TYPE_NAMES,
    accepted_type_names,
)
from tablepact.operators.tolerant import Unforeseen, tolerant
from tablepact.plans.shapes import NULL_COUNT, NULL_TEXT, measure_rows

CHECK_SCHEMA = T.StructType([
    T.StructField("check_id", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("check_type", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("condition", T.StringType()),
    T.StructField("expected", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("column", T.StringType()),
    T.StructField("table", T.StringType()),
])


@dataclass(frozen=True)
class Check:
    check_id: str
    description: str
    check_type: str = "sql"
    kind: str = "custom"
    condition: str | None = None
    expected: str | None = "0"
    severity: str = "medium"
    column: str | None = None
    table: str | None = None

    @property
    def query(self) -> str:
        """The stand-alone SQL of this check."""
        where = f" WHERE {self.condition}" if self.condition else ""
        return f"SELECT count(*) FROM {self.table}{where}"


def _name_list(values: Sequence) -> str:
    return ", ".join(sql_literal(v) for v in values)


def _bound(rule, bound) -> str:
    """A bound as a literal of the column's kind."""
    if rule.type in ("date", "datetime"):
        return f"{'DATE' if rule.type == 'date' else 'TIMESTAMP'} {sql_literal(str(bound))}"
    return str(bound) if isinstance(bound, (int, float)) else sql_literal(bound)


def generate_checks(contract: TableContract, output_table: str | None = None) -> list[Check]:
    """All checks of a contract: row count, then per column not-null, type,
    bounds, enum, e-mail format, date validity and lengths."""
    table = output_table or contract.name
    checks = [Check(f"{table}_row_count", f"Verify {table} has data", kind="row_count",
                    expected="> 0", severity="medium", table=table)]

    def add(rule, kind, description, condition, severity):
        checks.append(Check(f"{table}_{rule.name}_{kind}", description, "sql", kind, condition,
                            "0", severity, rule.name, table))

    for rule in contract.columns:
        c = quoted(rule.name)
        if not rule.nullable_in_checks:
            add(rule, "not_null", f"Verify {rule.name} has no NULL values (NOT NULL constraint)",
                f"{c} IS NULL", "critical")
        add(rule, "type_check", f"Verify {rule.name} has correct type ({rule.type})",
            f"typeof({c}) NOT IN ({_name_list(accepted_type_names(rule.type))})", "critical")
        for kind, sign, shown in (("min", "<", ">="), ("max", ">", "<=")):
            if kind in rule.constraints:
                bound = rule.constraints[kind]
                add(rule, kind, f"Verify {rule.name} {shown} {bound}", f"{c} {sign} {_bound(rule, bound)}", "high")
        if rule.enum:
            add(rule, "enum", f"Verify {rule.name} is in valid enum values",
                f"{c} NOT IN ({_name_list(rule.enum)})", "high")
        if rule.format == "email":
            add(rule, "email_format", f"Verify {rule.name} has valid email format",
                f"{c} IS NOT NULL AND {c} NOT LIKE '{P.EMAIL_LIKE_PATTERN}'", "medium")
        if rule.type == "date":
            add(rule, "date_valid", f"Verify {rule.name} contains valid dates",
                f"{c} IS NOT NULL AND typeof({c}) NOT IN ({_name_list(DATE_LIKE_TYPE_NAMES)})",
                "high")
        if rule.type in ("string", "text"):
            for kind, sign, shown in (("min_length", "<", ">="), ("max_length", ">", "<=")):
                if kind in rule.constraints:
                    bound = rule.constraints[kind]
                    add(rule, kind, f"Verify {rule.name} length {shown} {bound}",
                        f"length({c}) {sign} {bound}", "medium")
    return checks


def basic_checks(contract: TableContract, output_table: str | None = None) -> list[Check]:
    """The older, shorter list: row count, nulls, types, bounds, enums."""
    kept = ("row_count", "not_null", "type_check", "min", "max", "enum")
    order = {k: i for i, k in enumerate(kept)}
    chosen = [c for c in generate_checks(contract, output_table) if c.kind in kept]
    # bounds stay together per column
    return sorted(chosen, key=lambda c: order["min" if c.kind == "max" else c.kind])


def checks_frame(spark: SparkSession, checks: Sequence[Check]) -> DataFrame:
    return spark.createDataFrame([tuple(asdict(c).values()) for c in checks], CHECK_SCHEMA)


def checks_from_frame(df: DataFrame) -> list[Check]:
    """Checks are contract metadata, a few rows per column of one table."""
    return [Check(**row.asDict()) for row in df.select(*CHECK_SCHEMA.names).collect()]


def _analysis_errors(df: DataFrame, checks: Sequence[Check]) -> dict[str, str]:
    """Error text per check that cannot be analysed; nothing is executed.

    All conditions are tried together first, so the usual case costs one call.
    """
    errors = {c.check_id: f"Column {c.column} not found" for c in checks
              if c.column is not None and c.column not in df.columns}
    open_ones = [c for c in checks if c.condition is not None and c.check_id not in errors]

    def attempt(some: Sequence[Check]) -> str | None:
        try:
            df.selectExpr(*[f"count_if({c.condition})" for c in some])
            return None
        except (AnalysisException, ParseException) as exc:
            return (exc.getMessage() or str(exc)).splitlines()[0]

    if open_ones and attempt(open_ones) is not None:
        for check in open_ones:
            error = attempt([check])
            if error is not None:
                errors[check.check_id] = error
    return errors


#: Error classes Spark names in its messages; a lost executor or a full disk has none.
_ERROR_CLASS = re.compile(r"\[[A-Z0-9_.]+\]")


def failing_checks(df: DataFrame, checks: Sequence[Check]) -> dict[str, str]:
    """Error text per check that fails while it runs.

    All run together; only if that fails are they run in halves, so one failing
    check of n costs about 2 log n runs.  What is no failure of an expression is raised.
    """
    if not checks:
        return {}
    try:
        df.agg(*[F.expr(f"count_if({c.condition})").alias(f"c{i}") for i, c in enumerate(checks)]).collect()
        return {}
    except Exception as exc:  # a failing expression reaches the driver as a Java error
        if not _ERROR_CLASS.search(str(exc)):
            raise
        if len(checks) == 1:
            return {checks[0].check_id: str(exc).splitlines()[0]}
    half = len(checks) // 2
    return failing_checks(df, checks[:half]) | failing_checks(df, checks[half:])


@dataclass(frozen=True)
class Measure:
    """Aggregates of a check: violating rows, rows it cannot decide (if there may be some); or why it cannot run."""

    count: Column | None
    undecided: Column | None = None
    error: str | None = None
    reason: str = "%d rows cannot be decided"


def measures(df: DataFrame, checks: Sequence[Check]) -> list[Measure]:
    """The aggregates of each check, none of which fails on a value.

    Conditions are taken in their ``try_`` forms.  Only those that may fail in
    other ways, such as functions of the user, are tried once beforehand.
    """
    known = [c for c in checks if c.check_type in ("sql", "row_count")]
    errors = _analysis_errors(df, known)
    out: list[Measure | None] = []
    for check in checks:
        out.append(Measure(None, reason=f"Unknown check type: {check.check_type}") if check not in known
                   else Measure(None, error=errors[check.check_id]) if check.check_id in errors
                   else Measure(F.count(F.lit(1))) if check.condition is None else _number_bound(df, check))
    open_ones = [i for i, m in enumerate(out) if m is None]
    tried = []
    for i, found in zip(open_ones, tolerant(df, *[checks[i].condition for i in open_ones]), strict=True):
        if isinstance(found, Unforeseen):
            tried.append(i)
        else:
            out[i] = Measure(found.violations, found.undecided)
    failing = failing_checks(df, [checks[i] for i in tried])
    for i in tried:
        error = failing.get(checks[i].check_id)
        out[i] = Measure(None if error else F.expr(f"count_if({checks[i].condition})"), error=error)
    return out


def _number_bound(df: DataFrame, check: Check) -> Measure | None:
    """A bound on a text column compares the numbers the type inference knows."""
    bounded = re.fullmatch(r".+ ([<>]) (-?[0-9.]+(?:[eE][+-]?[0-9]+)?)", check.condition)
    if check.kind not in ("min", "max") or not bounded or not isinstance(df.schema[check.column].dataType, T.StringType):
        return None
    c = F.col(quoted(check.column))
    number = F.when(P.is_number_text(c), F.trim(c).try_cast("double"))
    sign, bound = bounded.groups()
    outside = number < float(bound) if sign == "<" else number > float(bound)
    return Measure(F.count_if(outside), F.count_if(c.isNotNull() & number.isNull()), reason="%d values are not numeric")


def verdict(expected: Column, actual: Column, error: Column | None = None,
            check_type: Column | None = None) -> Column:
    """PASS, FAIL or ERROR from an expectation such as ``> 0``, ``< 5``, ``= 3``,
    ``0``, ``< 0.5`` or nothing.  Unknown check types pass."""
    sign = F.regexp_extract(expected, r"\A\s*([<>=]?)", 1)
    number = F.regexp_extract(expected, r"\A\s*[<>=]?\s*(-?[0-9]+(?:\.[0-9]+)?)\s*\z", 1).try_cast("decimal(38,9)")
    ok = (F.when(expected.isNull(), F.lit(True))
          .when(actual.isNull(), F.lit(False))
          .when(sign == ">", actual > number)
          .when(sign == "<", actual < number)
          .otherwise(actual == number))
    out = F.when(F.coalesce(ok, F.lit(False)), F.lit("PASS")).otherwise(F.lit("FAIL"))
    if error is not None:
        out = F.when(error.isNotNull(), F.lit("ERROR")).otherwise(out)
    if check_type is not None:
        out = F.when(~check_type.isin("sql", "row_count"), F.lit("PASS")).otherwise(out)
    return out


def run_checks(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: actual count, status and error text.

    A check that cannot be analysed (for example a missing column), or that cannot
    decide some row (a text that is no number or date, an overflow), is reported as
    ERROR and does not stop the others.  One aggregation runs them all, once.
    """
    rows = []
    for check, measure in zip(checks, measures(df, checks), strict=True):
        expected = check.expected
        if check.check_type == "row_count":
            expected = "> 0"
        details = "" if check.check_type in ("sql", "row_count") else measure.reason
        rows.append({
            "check_id": check.check_id, "description": check.description,
            "check_type": check.check_type, "severity": check.severity,
            "column": check.column or NULL_TEXT,
            "expected": expected if expected is not None else NULL_TEXT,
            "details": details,
            "_count": NULL_COUNT if measure.count is None else measure.count,
            "_undecided": NULL_COUNT if measure.undecided is None else measure.undecided,
            "_reason": measure.reason, "_error": measure.error or NULL_TEXT,
        })
    error = (F.when(F.col("_error").isNotNull(), F.col("_error"))
             .when(F.col("_undecided") > 0, F.replace("_reason", F.lit("%d"), F.col("_undecided").cast("string"))))
    actual = F.when(error.isNull(), F.col("_count"))
    return measure_rows(df, rows).select(
        "check_id", "description", "check_type", "severity", "column", "expected",
        actual.alias("actual"),
        verdict(F.col("expected"), actual, error, F.col("check_type")).alias("status"),
        "details", error.alias("error"))


def summary(results: DataFrame) -> DataFrame:
    """Totals and overall status: FAIL beats WARN (some check errored) beats PASS."""
    totals = results.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("status") == "PASS").alias("checks_passed"),
        F.count_if(F.col("status") == "FAIL").alias("checks_failed"),
        F.count_if(F.col("status") == "ERROR").alias("checks_errored"),
    )
    return totals.withColumn(
        "overall_status",
        F.when(F.col("checks_failed") > 0, "FAIL").when(F.col("checks_errored") > 0, "WARN")
        .otherwise("PASS"))


def failed(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "FAIL")


def errored(results: DataFrame) -> DataFrame:
    return results.filter(F.col("status") == "ERROR")


def critical_failures(results: DataFrame) -> DataFrame:
    return results.filter((F.col("status") == "FAIL") & (F.col("severity") == "critical"))


def source_table_candidates(output_table: str, source_table: str | None = None) -> list[str]:
    """Names under which the source of an output table is looked for, in order; a
    named source is the only one."""
    base = output_table.removesuffix("_clean")
    return [source_table] if source_table else [f"raw_{base}", f"raw_{output_table}", base]


def find_source(spark: SparkSession, output_table: str, source_table: str | None = None) -> DataFrame | None:
    for name in source_table_candidates(output_table, source_table):
        if spark.catalog.tableExists(name):
            return spark.table(name)
    return None


def report(results: DataFrame, output: DataFrame, source: DataFrame | None = None,
           name: str = "", output_table: str = "", source_rows: int | None = None) -> DataFrame:
    """One-row report: totals, source and output row counts, results as an array.

    The array holds one entry per check, so its size is that of the contract.
    Checks have no duration of their own, because one aggregation runs them all.
    """
    if source_rows is not None:
        source_count = F.lit(source_rows).cast("bigint")
    elif source is not None:
        source_count = source.agg(F.count(F.lit(1))).scalar()
    else:
        source_count = F.lit(None).cast("bigint")
    body = results.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if(F.col("status") == "PASS").alias("checks_passed"),
        F.count_if(F.col("status") == "FAIL").alias("checks_failed"),
        F.count_if(F.col("status") == "ERROR").alias("checks_errored"),
        F.sort_array(F.collect_list(F.struct(*results.columns))).alias("check_results"),
    )
    return body.select(
        F.lit(name).alias("name"), F.lit(output_table).alias("output_table"),
        F.current_timestamp().alias("executed_at"), "total_checks", "checks_passed", "checks_failed", "checks_errored",
        F.when(F.col("checks_failed") > 0, "FAIL").when(F.col("checks_errored") > 0, "WARN")
        .otherwise("PASS").alias("overall_status"),
        source_count.alias("source_row_count"),
        output.agg(F.count(F.lit(1))).scalar().alias("output_row_count"),
        "check_results")


def retarget(checks: Sequence[Check], table: str) -> list[Check]:
    return [replace(c, table=table) for c in checks]
