"""Validation of a cleaned frame against its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import TableContract
from tablepact.functions import predicates as P
from tablepact.functions.text import quoted
from tablepact.functions.types import contract_type_of, family
from tablepact.plans.shapes import NULL_COUNT, NULL_TEXT, Label, measure_rows, smallest_values


# Issue messages; {n} stands for the number of values.
MESSAGES = {
    "missing_column": "Column '{column}' missing from cleaned data",
    "extra_column": "Extra column '{column}' not in ideal schema",
    "null_values": "Column has {n} null values but is defined as NOT NULL",
    "type_mismatch": "Expected type '{expected}', got '{actual}'",
    "below_min": "{n} values below minimum {expected}",
    "above_max": "{n} values above maximum {expected}",
    "invalid_enum": "{n} values not in allowed enum: {expected}",
    "too_short": "{n} values shorter than minimum length {expected}",
    "too_long": "{n} values longer than maximum length {expected}",
    "invalid_email": "{n} values have invalid email format",
}


def _row(column, issue, hits, *, count=None, expected=None, actual=None, severity="high"):
    """One possible issue; ``hits`` above zero makes it an actual one."""
    message = MESSAGES[issue].format(n="{n}", column=column, expected=expected, actual=actual)
    return {"column": column, "issue": issue,
            "count": NULL_COUNT if count is None else count,
            "expected": NULL_TEXT if expected is None else str(expected),
            "actual": NULL_TEXT if actual is None else actual,
            "severity": severity, "message": message, "_hits": hits}


def _rules(df: DataFrame, contract: TableContract) -> list[dict]:
    one = Label("1L")
    rows = []
    for rule in contract.columns:
        if rule.name not in df.columns:
            rows.append(_row(rule.name, "missing_column", one))
            continue
        c = F.col(quoted(rule.name))
        dtype = df.schema[rule.name].dataType
        is_text = isinstance(dtype, T.StringType)

        def counted(issue, condition, rule=rule, **extra):
            n = F.count_if(condition)
            rows.append(_row(rule.name, issue, n, count=n, **extra))

        if not rule.nullable_in_checks:
            counted("null_values", c.isNull())
        actual = contract_type_of(dtype)
        if rule.type == "json" and is_text:
            rows.append(_row(rule.name, "type_mismatch", F.count_if(c.isNotNull() & ~P.is_valid_json(c)),
                             expected="json", actual="string"))
        elif actual != family(rule.type):
            rows.append(_row(rule.name, "type_mismatch", one, expected=rule.type, actual=actual))
        if family(rule.type) in ("integer", "float") and isinstance(dtype, T.NumericType):
            low, high = rule.bound("min"), rule.bound("max")
            if low is not None:
                counted("below_min", c < low, expected=low, actual=F.min(c).cast("double").cast("string"))
            if high is not None:
                counted("above_max", c > high, expected=high, actual=F.max(c).cast("double").cast("string"))
        if rule.enum is not None:
            counted("invalid_enum", ~c.isin(*rule.enum), expected=list(rule.enum))
        if family(rule.type) == "string" and is_text:
            low, high = rule.bound("min_length"), rule.bound("max_length")
            if low is not None:
                counted("too_short", F.length(c) < low, expected=low, severity="medium")
            if high is not None:
                counted("too_long", F.length(c) > high, expected=high, severity="medium")
        if rule.format == "email":
            counted("invalid_email", ~P.is_email_strict(c.cast("string")))
    named = set(contract.names)
    return rows + [_row(n, "extra_column", one) for n in df.columns if n not in named]


def frame_issues(df: DataFrame, contract: TableContract, examples: int = 5) -> DataFrame:
    """One row per issue found, counted in one aggregation.

    For value lists the smallest distinct bad values are added as examples, by one
    more scan for all of them.
    """
    rules = _rules(df, contract)
    number = F.coalesce(F.col("count").cast("string"), F.lit(""))
    found = measure_rows(df, rules).filter(F.col("_hits") > 0).drop("_hits").withColumn(
        "message", F.replace("message", F.lit("{n}"), number))
    listed = [r for r in contract.columns if r.enum is not None and r.name in df.columns]
    if not listed:
        return found.withColumn("examples", F.array().cast("array<string>"))
    bad = df.select(F.inline(F.array_compact(F.array(*[
        F.when(~F.col(quoted(r.name)).isin(*r.enum), F.struct(
            F.lit(r.name).alias("column"), F.col(quoted(r.name)).cast("string").alias("value")))
        for r in listed]))))
    samples = smallest_values(bad, ["column"], "value", examples, "examples").withColumn(
        "issue", F.lit("invalid_enum"))
    # At most one row per contract column on either side.
    return found.join(F.broadcast(samples), ["column", "issue"], "left").withColumn(
        "examples", F.coalesce("examples", F.array().cast("array<string>")))


def frame_summary(df: DataFrame, contract: TableContract) -> DataFrame:
    """Row count, number of issues and validity in one row."""
    rows = [{"issue": r["issue"], "_hits": r["_hits"]} for r in _rules(df, contract)]
    measured = measure_rows(df, [*rows, {"issue": "row_count", "_hits": F.count(F.lit(1))}])
    is_total = F.col("issue") == "row_count"
    return measured.agg(
        F.max(F.when(is_total, F.col("_hits"))).alias("row_count"),
        F.count_if(~is_total & (F.col("_hits") > 0)).alias("issue_count"),
    ).withColumn("is_valid", F.col("issue_count") == 0)


def column_statistics(df: DataFrame, contract: TableContract) -> DataFrame:
    """Contract type, frame type and null count of every contract column present."""
    return measure_rows(df, [
        {"column": r.name, "ideal_type": r.type,
         "actual_type": contract_type_of(df.schema[r.name].dataType),
         "null_count": F.count_if(F.col(quoted(r.name)).isNull())}
        for r in contract.columns if r.name in df.columns])


def columns_with_nulls(df: DataFrame) -> DataFrame:
    """The reduced validation: columns that still hold nulls."""
    return measure_rows(df, [
        {"column": n, "null_count": F.count_if(F.col(quoted(n)).isNull())} for n in df.columns
    ]).filter(F.col("null_count") > 0)


def contract_for_frame(df: DataFrame, contracts: dict[str, TableContract], table: str) -> TableContract | None:
    """The named contract, else the one whose column set equals the frame's."""
    if table in contracts:
        return contracts[table]
    for contract in contracts.values():
        if set(contract.names) == set(df.columns):
            return contract
    return None
