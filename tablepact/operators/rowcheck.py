"""Row-level check of a raw table against a contract, error by error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import ColumnRule, TableContract
from tablepact.functions import predicates as P
from tablepact.functions.text import quoted
from tablepact.functions.types import family
from tablepact.plans.shapes import count_with_samples

NUMERIC_TYPES = ("integer", "float")
ERROR_ARRAY = "array<struct<column:string,error:string,value:string,severity:string>>"


def _number_name(rule: ColumnRule) -> str:
    return f"_number_{rule.name}"


def _number(c: Column) -> Column:
    """The value as Python's float() reads it; null when it does not."""
    return F.when(P.is_float_text(c), F.replace(F.trim(c), F.lit("_"), F.lit("")).try_cast("double"))


def _text_column(df: DataFrame, rule: ColumnRule) -> Column:
    if rule.name not in df.columns:
        return F.lit(None).cast("string")
    c = F.col(quoted(rule.name))
    return c if isinstance(df.schema[rule.name].dataType, T.StringType) else c.cast("string")


def _prepare(df: DataFrame, contract: TableContract) -> DataFrame:
    """Add the parsed value of every numeric column, so that it is parsed once
    however many rules use it."""
    numeric = [r for r in contract.columns if family(r.type) in NUMERIC_TYPES]
    return df.select("*", *[_number(_text_column(df, r)).alias(_number_name(r)) for r in numeric])


def _column_errors(c: Column, rule: ColumnRule) -> Column:
    """Errors of one cell as an array; a blank cell has at most the null error."""
    none = F.array().cast(ERROR_ARRAY)

    def found(message: str, severity: str) -> Column:
        return F.array(F.struct(
            F.lit(rule.name).alias("column"), F.lit(message).alias("error"),
            c.alias("value"), F.lit(severity).alias("severity")))

    def error(condition: Column, message: str, severity: str) -> Column:
        return F.when(condition, found(message, severity)).otherwise(none)

    rules = []
    mismatch = f"Type mismatch: expected {rule.type}, got str"
    number = F.col(quoted(_number_name(rule)))
    kind = family(rule.type)
    if kind == "integer":
        rules.append(error(~P.is_int_parsable(c), mismatch, "high"))
    elif kind == "float":
        rules.append(error(number.isNull(), mismatch, "high"))
    elif rule.type == "date":
        rules.append(error(~P.is_date_text(c), mismatch, "high"))
    elif kind == "string" and rule.format == "email":
        rules.append(error(~P.is_email_basic(c), "Invalid email format", "medium"))
    if rule.enum is not None:
        rules.append(error(~c.isin(*rule.enum),
                           f"Value not in allowed enum: {list(rule.enum)}", "medium"))
    if kind in NUMERIC_TYPES:
        low, high = rule.bound("min"), rule.bound("max")
        if low is not None:
            rules.append(error(number < low, f"Value below minimum: {low}", "medium"))
        if high is not None:
            # Spark orders NaN above every number; as text it breaks no bound.
            rules.append(error((number > high) & ~F.isnan(number),
                               f"Value above maximum: {high}", "medium"))
    blank = none if rule.nullable_in_checks else found("NULL value not allowed", "high")
    if not rules:
        return F.when(P.is_blank(c), blank).otherwise(none)
    filled = rules[0] if len(rules) == 1 else F.concat(*rules)
    return F.when(P.is_blank(c), blank).otherwise(filled)


def _errors(df: DataFrame, contract: TableContract) -> Column:
    """All errors of a prepared row.  Concatenation compiles, unlike a
    higher-order filter over an array of candidates."""
    return F.concat(*[_column_errors(_text_column(df, r), r) for r in contract.columns])


def with_errors(df: DataFrame, contract: TableContract, name: str = "_errors") -> DataFrame:
    """Add all errors of a row as an array; empty when the row is fine."""
    prepared = _prepare(df, contract)
    return prepared.select(*[F.col(quoted(c)) for c in df.columns], _errors(df, contract).alias(name))


def check_rows(df: DataFrame, contract: TableContract, row_id: str) -> DataFrame:
    """One row per error: row id, column, message, value, severity.

    ``row_id`` is a key column, or the line number of ``files.with_line_numbers``.
    """
    return _prepare(df, contract).select(
        F.col(quoted(row_id)).alias("row"), F.inline(_errors(df, contract)))


def check_summary(df: DataFrame, contract: TableContract) -> DataFrame:
    """Total rows, total errors and errors per row (which can exceed one)."""
    counted = with_errors(df, contract).select(F.size("_errors").alias("n"))
    totals = counted.agg(F.count(F.lit(1)).alias("total_rows"),
                         F.coalesce(F.sum("n"), F.lit(0)).alias("total_errors"))
    return totals.withColumn(
        "error_rate", F.when(F.col("total_rows") > 0,
                             F.col("total_errors") / F.col("total_rows")).otherwise(0.0))


def first_errors(errors: DataFrame, n: int = 50) -> DataFrame:
    """The first errors by row; a bounded top-n, not a full sort."""
    return errors.orderBy("row", "column", "error").limit(n)


def root_causes(errors: DataFrame, samples: int = 5) -> DataFrame:
    """Column, issue, rows affected and sample values (the smallest distinct ones)."""
    return count_with_samples(errors, ["column", "error", "severity"], "value", samples,
                              count="rows_affected")


def split_by_errors(df: DataFrame, contract: TableContract) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with their errors)."""
    marked = with_errors(df, contract)
    good = marked.filter(F.size("_errors") == 0).drop("_errors")
    return good, marked.filter(F.size("_errors") > 0)
