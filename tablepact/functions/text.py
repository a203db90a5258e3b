"""Small text helpers."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

# Unit names of the human-readable size, in order.
SIZE_UNITS = ("B", "KB", "MB", "GB", "TB", "PB")


def human_size(size: Column) -> Column:
    """Bytes as ``12.3 KB``: divided by 1024 until below it, one decimal.

    Ties go to the even digit, which the format function alone would round up.
    """
    out = None
    for power in range(len(SIZE_UNITS) - 1, -1, -1):
        scaled = F.format_string("%.1f " + SIZE_UNITS[power], F.bround(
            size.cast("double") / F.lit(float(1024 ** power)), 1))
        if out is None:
            out = scaled
        else:
            out = F.when(size < F.lit(1024 ** (power + 1)), scaled).otherwise(out)
    return out


def normalise_error(c: Column) -> Column:
    """Lower case, runs of white space to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def json_default_text(default) -> str:
    """Default of a JSON column as text; objects and lists are serialised."""
    if default is None:
        return "{}"
    if isinstance(default, (dict, list)):
        return json.dumps(default)
    return str(default)


def sql_literal(value) -> str:
    """A Python value as SQL literal text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
