"""Cleaning: a contract compiled to one projection.

Row count is unchanged and nothing shuffles; every output column is a single
native expression, so Spark runs the scan and the cleaning in one stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import ColumnRule, TableContract
from tablepact.functions import coerce as C
from tablepact.functions.text import json_default_text, quoted, sql_literal
from tablepact.functions.types import spark_type

TYPE_MISMATCH = "type_mismatch"
NULLS_FOUND = "null_values_found"
INTEGER_TYPES = ("integer", "int", "bigint")
FLOAT_TYPES = ("float", "double")
STRING_TYPES = ("string", "text")

# Fixed value: what an invalid e-mail becomes when the contract names no default.
DEFAULT_EMAIL = "unknown@example.com"


def _source_column(df: DataFrame, rule: ColumnRule, na_tokens: bool) -> tuple[Column, T.DataType]:
    dtype = df.schema[rule.name].dataType
    c = F.col(quoted(rule.name))
    # No missing-value token parses as a number or a date, so those need no test.
    parsed = rule.type in INTEGER_TYPES + FLOAT_TYPES + ("date", "datetime")
    if na_tokens and isinstance(dtype, T.StringType) and not parsed:
        c = C.na_to_null(c)
    return c, dtype


def _parse(c: Column, rule: ColumnRule, dtype: T.DataType,
           formats: tuple[str, ...] | None) -> Column:
    """Type coercion only; unparsable becomes null."""
    if rule.type in INTEGER_TYPES:
        return C.to_integer(c, dtype, spark_type(rule.type).simpleString())
    if rule.type in FLOAT_TYPES:
        return C.to_double(c, dtype)
    if rule.type == "date":
        return C.to_iso_date(c, dtype, formats, rule.day_first)
    if rule.type == "datetime":
        return C.to_timestamp(c, dtype)
    if rule.type in ("boolean", "bool"):
        return c if isinstance(dtype, T.BooleanType) else C.to_boolean(c)
    return c if isinstance(dtype, T.StringType) else c.cast("string")


def _typed_default(rule: ColumnRule) -> Column:
    if rule.type == "json":
        return F.lit(json_default_text(rule.default))
    return F.lit(rule.default).cast(spark_type(rule.type))


def _fill_mismatch(out: Column, c: Column, rule: ColumnRule,
                   issues: frozenset[str] | None) -> Column:
    """Fill by what the comparison found.

    With known issues: nulls of a column that must not hold any are filled, and
    a coerced numeric column is filled whole.  Without a comparison the rule is
    decided per value: blanks stay null only where the contract allows nulls.
    """
    if rule.default is None:
        return out
    numeric = rule.type in INTEGER_TYPES + FLOAT_TYPES
    if issues is None:
        if not rule.nullable_in_comparison:
            return F.coalesce(out, _typed_default(rule))
        if numeric:
            return F.when(~C.is_missing(c), F.coalesce(out, _typed_default(rule)))
        return out
    if NULLS_FOUND in issues or (TYPE_MISMATCH in issues and numeric):
        return F.coalesce(out, _typed_default(rule))
    return out


def clean_column(c: Column, rule: ColumnRule, dtype: T.DataType = T.StringType(),
                 issues: frozenset[str] | None = None,
                 formats: tuple[str, ...] | None = None) -> Column:
    """All rules of one column, in contract rule order: type branch, enum,
    string fill, lengths, pattern, e-mail, mismatch fill."""
    low, high = rule.bound("min"), rule.bound("max")
    bounded = bool(rule.constraints)
    if rule.type == "date":
        out = _parse(c, rule, dtype, formats)
        if rule.default is not None:
            out = F.coalesce(out, _typed_default(rule))
    elif rule.type in INTEGER_TYPES and bounded and rule.default is not None:
        out = C.clamped_integer(c, rule.default, low, high, dtype,
                                spark_type(rule.type).simpleString())
    elif rule.type in FLOAT_TYPES and bounded and rule.default is not None:
        out = C.clamped_double(c, rule.default, low, high, dtype)
    elif rule.type == "json":
        text = c if isinstance(dtype, T.StringType) else c.cast("string")
        out = C.clean_json(text, json_default_text(rule.default if rule.has_default else None))
    else:
        out = _parse(c, rule, dtype, formats)

    if rule.enum is not None:
        # A list of numbers over text holds their text; compared as numbers, any other text would fail.
        as_text = str if rule.type in ("string", "text") else lambda v: v
        default = rule.default if rule.default is None else as_text(rule.default)
        out = C.enforce_enum(out, [as_text(v) for v in rule.enum], default)
    if rule.type in STRING_TYPES:
        lengths = "min_length" in rule.constraints or "max_length" in rule.constraints
        if lengths:
            out = C.fill(out, rule.default)
        if "min_length" in rule.constraints:
            out = C.pad_to(out, rule.constraints["min_length"])
        if "max_length" in rule.constraints:
            out = C.truncate_to(out, rule.constraints["max_length"])
    if rule.pattern is not None:
        out = C.enforce_pattern(out, rule.pattern, rule.default if rule.has_default else "")
    if rule.format == "email":
        out = C.enforce_email(out, rule.default if rule.has_default else DEFAULT_EMAIL)
    return _fill_mismatch(out, c, rule, issues)


def basic_column(c: Column, rule: ColumnRule, dtype: T.DataType = T.StringType(),
                 issues: frozenset[str] | None = None,
                 formats: tuple[str, ...] | None = None) -> Column:
    """Coercion and null fill only: no clamp, enum, length or format rule."""
    out = _parse(c, rule, dtype, formats)
    if rule.default is None:
        return out
    if rule.type in INTEGER_TYPES + FLOAT_TYPES + ("date",):
        return F.coalesce(out, _typed_default(rule))
    return _fill_mismatch(out, c, rule, issues)


def clean(df: DataFrame, contract: TableContract, *, rules: str = "full",
          extra: str = "keep", na_tokens: bool = True,
          issues: Mapping[str, Sequence[str]] | None = None,
          date_formats: tuple[str, ...] | None = None) -> DataFrame:
    """Apply a contract to a raw table in one ``select``.

    ``rules``: ``"full"`` or ``"basic"`` (coerce and fill only).
    ``extra``: keep or drop columns the contract does not name.
    ``issues``: per column the issue names a schema comparison found (see
    ``compare.issues_by_column``); without it the fills are decided per value.
    ``date_formats``: only these, instead of every shape type inference knows.
    Columns come out in contract order, kept extra columns after them.
    """
    build = {"full": clean_column, "basic": basic_column}[rules]
    present = set(df.columns)
    out = []
    for rule in contract.columns:
        if rule.name in present:
            c, dtype = _source_column(df, rule, na_tokens)
            known = None if issues is None else frozenset(issues.get(rule.name, ()))
            out.append(build(c, rule, dtype, known, date_formats).alias(rule.name))
        else:
            out.append(_typed_default(rule).alias(rule.name))
    if extra == "keep":
        named = set(contract.names)
        out += [F.col(quoted(n)) for n in df.columns if n not in named]
    elif extra != "drop":
        raise ValueError(f"extra must be 'keep' or 'drop', not {extra!r}")
    return df.select(*out)


def null_coercion_report(contract: TableContract) -> list[str]:
    """Columns that stay null when coercion fails, because they have no default."""
    return [r.name for r in contract.columns
            if r.default is None and r.type in INTEGER_TYPES + FLOAT_TYPES + ("date",)]


def cleaning_expressions(contract: TableContract, issues: Mapping[str, Sequence[str]],
                         missing: Sequence[str] = ()) -> list[str]:
    """The SQL form of a cleaning: one expression per contract column, in order.

    A column with a null and a type issue gets one expression, the cast is a
    try-cast, and every column is named, so nothing depends on the order in
    which the issues were found.
    """
    out = []
    for rule in contract.columns:
        name, default = quoted(rule.name), sql_literal(rule.default)
        found = issues.get(rule.name, ())
        target = spark_type(rule.type).simpleString()
        if rule.name in missing:
            out.append(f"CAST({default} AS {target}) AS {name}")
        elif TYPE_MISMATCH in found:
            value = f"TRY_CAST({name} AS {target})"
            if target in ("int", "bigint"):
                value = f"TRY_CAST(TRY_CAST({name} AS DOUBLE) AS {target})"
            out.append(f"COALESCE({value}, CAST({default} AS {target})) AS {name}")
        elif NULLS_FOUND in found and not rule.nullable_in_checks and rule.default is not None:
            out.append(f"COALESCE({name}, {default}) AS {name}")
        else:
            out.append(name)
    return out


def clean_by_sql(df: DataFrame, contract: TableContract, issues: Mapping[str, Sequence[str]]) -> DataFrame:
    """Cleaning through SQL expressions; extra columns are dropped."""
    missing = [n for n in contract.names if n not in df.columns]
    return df.selectExpr(*cleaning_expressions(contract, issues, missing))


def cleaning_statement(contract: TableContract, issues: Mapping[str, Sequence[str]],
                       source_table: str, missing: Sequence[str] = ()) -> str:
    """INSERT … SELECT text of the SQL cleaning."""
    names = ", ".join(quoted(n) for n in contract.names)
    body = ",\n  ".join(cleaning_expressions(contract, issues, missing))
    return (f"INSERT INTO {contract.output_table} ({names})\n"
            f"SELECT\n  {body}\nFROM {source_table}")


def deduplicate(df: DataFrame, keys: Sequence[str], order_by: Sequence[str] = (),
                latest: bool = False) -> DataFrame:
    """One row per key: the smallest by ``order_by``, ties broken by the other columns;
    with ``latest`` the greatest.

    A min or max over a struct combines before the shuffle, so a key that holds a large
    share of the rows sends one row per task.
    """
    lead = list(order_by)
    rest = [c for c in df.columns if c not in keys and c not in lead]
    lead = [c for c in lead if c not in keys]
    if not lead + rest:
        return df.distinct()
    chosen = (F.max if latest else F.min)(F.struct(*[F.col(quoted(c)) for c in lead + rest])).alias("_row")
    grouped = df.groupBy(*[F.col(quoted(k)) for k in keys]).agg(chosen)
    return grouped.select(*[
        F.col(quoted(c)) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def widen(df: DataFrame, to_text: Sequence[str] = (), to_float: Sequence[str] = ()) -> DataFrame:
    """Widening casts: integer to text, integer to float."""
    changes = {c: F.col(quoted(c)).cast("string") for c in to_text}
    changes.update({c: F.col(quoted(c)).cast("double") for c in to_float})
    return df.withColumns(changes)
