"""Strict, all-or-nothing load into typed, NOT NULL, unique-key tables."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import TableContract
from tablepact.functions import predicates as P
from tablepact.functions.text import quoted
from tablepact.functions.types import spark_type
from tablepact.operators.consistency import duplicate_keys


# Text forms a strict load takes for a type: the engine's own cast also takes
# suffixes (5d), bare years and the like.
_FORMS = {
    T.IntegerType: r"\A\s*[+-]?[0-9]+\s*\z", T.LongType: r"\A\s*[+-]?[0-9]+\s*\z",
    T.DoubleType: P.NUMBER_TEXT_PATTERN,
    T.DateType: r"\A\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*\z",
    T.TimestampType: r"\A\s*[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?"
                     r"(?:Z|[+-][0-9]{2}:?[0-9]{2})?)?\s*\z",
}


def _typed(c: Column, rule) -> Column:
    """The value as the column's type; null where it is missing or does not fit."""
    target = spark_type(rule.type)
    text = c.cast("string")
    fits = ~P.is_blank(text)
    if type(target) in _FORMS:
        fits = fits & text.rlike(_FORMS[type(target)])
    return F.when(fits, F.trim(text).try_cast(target) if type(target) in _FORMS else c.try_cast(target))


def _converts(c: Column, rule) -> Column:
    """The text is missing or fits the column's type."""
    return P.is_blank(c.cast("string")) | _typed(c, rule).isNotNull()


def _required(rule) -> bool:
    """A key column must not be missing, whatever else is said of it."""
    return rule.primary_key or not rule.nullable_in_checks


def typed_projection(raw: DataFrame, contract: TableContract, created_at: Column | None = None) -> DataFrame:
    """Typed rows; running it fails on the first value that does not convert and
    on the first missing value of a NOT NULL column.

    Empty text is missing, as in the staging table.  The assertions sit in a
    filter over the raw rows, so they hold for every column whichever are read
    later, and whether or not the session uses ANSI casts.
    """
    checked = raw
    for rule in contract.columns:
        c = F.col(quoted(rule.name))
        name = f"{contract.name}.{rule.name}"
        checked = checked.filter(F.assert_true(
            _converts(c, rule), f"Conversion failed: {name} to {rule.type}").isNull())
        if _required(rule):
            checked = checked.filter(F.assert_true(
                ~P.is_blank(c.cast("string")), f"NOT NULL constraint failed: {name}").isNull())
    typed = [_typed(F.col(quoted(r.name)), r).alias(r.name) for r in contract.columns]
    stamp = F.current_timestamp() if created_at is None else created_at
    return checked.select(*typed, stamp.alias("created_at"))


def strict_load(raw: DataFrame, contract: TableContract, created_at: Column | None = None) -> DataFrame:
    """Typed rows, or a failing query: casts, NOT NULL and key uniqueness all hold.

    Key uniqueness is one aggregation on the typed key (combined before the shuffle);
    its single number guards the rows, which are not shuffled themselves.
    """
    typed = typed_projection(raw, contract, created_at)
    if not contract.key:
        return typed
    keys = raw.select(*[_typed(F.col(quoted(k)), contract.column(k)).alias(k) for k in contract.key])
    repeated = duplicate_keys(keys, contract.key).agg(F.count(F.lit(1))).scalar()
    message = f"PRIMARY KEY constraint failed: {contract.name} ({', '.join(contract.key)})"
    return typed.filter(F.assert_true(repeated == 0, message).isNull())


def strict_load_to(raw: DataFrame, contract: TableContract, path: str) -> int:
    """Load into a Parquet folder, all rows or none; rows loaded.

    Rows are written to a sibling folder first.  Only when every assertion held
    is the folder moved into place, so a failed load leaves the target as it was.
    """
    from tablepact.sources.sinks import counted_write, drop_folder, replace_folder
    staging = f"{path.rstrip('/')}__staging_{uuid.uuid4().hex}"
    try:
        rows = counted_write(strict_load(raw, contract), staging)
    except Exception:
        drop_folder(raw.sparkSession, staging)
        raise
    replace_folder(raw.sparkSession, staging, path)
    return rows


def strict_publish(raw: DataFrame, contract: TableContract, target: str) -> int:
    """As :func:`strict_load_to`, as a new version of a published table; for object stores."""
    from tablepact.sources.published import publish
    return publish(strict_load(raw, contract), target).rows


def breaks_load(raw: DataFrame, contract: TableContract) -> Column:
    """True for rows a strict load would refuse (key uniqueness aside)."""
    bad = F.lit(False)
    for rule in contract.columns:
        c = F.col(quoted(rule.name))
        bad = bad | ~_converts(c, rule)
        if _required(rule):
            bad = bad | P.is_blank(c.cast("string"))
    return bad


def reject_sample(raw: DataFrame, condition: Column, n: int = 5, order_by: Sequence[str] = ()) -> DataFrame:
    """A few of the rows that break the load."""
    bad = raw.filter(condition)
    return (bad.orderBy(*order_by) if order_by else bad).limit(n)


def split_rejects(raw: DataFrame, contract: TableContract) -> tuple[DataFrame, DataFrame]:
    """(loadable rows, rejected rows), all of them."""
    bad = F.coalesce(breaks_load(raw, contract), F.lit(True))
    return raw.filter(~bad), raw.filter(bad)
