"""Column builders for cleaning: parse, fill, clamp, repair.

All builders take and return ``Column`` and never raise on bad input: text that
does not parse becomes null, and the caller decides what fills it.
``source`` is the type of the incoming column, so a column that is already
typed is not sent through text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.functions import predicates as P
from tablepact.functions.types import is_date_like, is_numeric

ISO_DATE = "yyyy-MM-dd"


def na_to_null(c: Column) -> Column:
    """Text the tabular reader treats as missing becomes null."""
    return F.when(~P.is_na_token(c), c)


def is_missing(c: Column) -> Column:
    return c.isNull() | P.is_na_token(c.cast("string"))


def to_double(c: Column, source: T.DataType = T.StringType()) -> Column:
    """Numeric coercion; NaN counts as missing."""
    if is_numeric(source):
        value = c.cast("double")
        floating = isinstance(source, (T.FloatType, T.DoubleType))
        return F.when(~F.isnan(value), value) if floating else value
    text = c if isinstance(source, T.StringType) else c.cast("string")
    # Spark's cast also takes Java suffixes and hex floats; the pattern does not.
    return F.when(P.is_number_text(text), F.trim(text).try_cast("double"))


def to_integer(c: Column, source: T.DataType = T.StringType(), target: str = "int") -> Column:
    """Numeric coercion, truncated towards zero; values that do not fit are null."""
    if isinstance(source, T.IntegralType):
        return c.try_cast(target)
    return to_double(c, source).try_cast(target)


def to_iso_date(c: Column, source: T.DataType = T.StringType(),
                formats: tuple[str, ...] | None = None, day_first: bool = False) -> Column:
    """Dates in any documented shape, or in the given formats only."""
    if is_date_like(source):
        return c.cast("date")
    text = c if isinstance(source, T.StringType) else c.cast("string")
    if formats is None:
        return P.parse_date(text, day_first)
    parsed = [
        F.when(text.rlike(P.ISO_DATE_PATTERN), text.try_cast("date"))
        if fmt == ISO_DATE else F.try_to_date(text, fmt)
        for fmt in formats
    ]
    return parsed[0] if len(parsed) == 1 else F.coalesce(*parsed)


def to_timestamp(c: Column, source: T.DataType = T.StringType()) -> Column:
    if is_date_like(source):
        return c.cast("timestamp")
    return c.cast("string").try_cast("timestamp")


def to_boolean(c: Column) -> Column:
    """Words for true are true, everything else (null included) is false."""
    return F.coalesce(c.cast("string").isin(*P.TRUE_WORDS), F.lit(False))


def clamp(c: Column, low=None, high=None) -> Column:
    """Clip to the bounds; null stays null (least/greatest would skip it)."""
    out = c
    if low is not None:
        out = F.when(c < F.lit(low), F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(c > F.lit(high), F.lit(high)).otherwise(out)
    return out


def clip(c: Column, low=None, high=None) -> Column:
    """Clip a column that holds no nulls; reads its input once."""
    out = c if low is None else F.greatest(c, F.lit(low))
    return out if high is None else F.least(out, F.lit(high))


def fill(c: Column, default) -> Column:
    return c if default is None else F.coalesce(c, F.lit(default))


def clamped_integer(c: Column, default, low=None, high=None,
                    source: T.DataType = T.StringType(), target: str = "int") -> Column:
    """Parse, fill, clip and truncate.

    Clipping happens in double so that values beyond the integer range reach
    the bound instead of being lost; with whole bounds the result is the same
    as clipping after truncation.  What still does not fit takes the default.
    """
    if isinstance(source, T.IntegralType):
        wide = fill(c.cast("bigint"), int(default))
        bounded = clip(wide, low, high)
    else:
        bounded = clip(F.coalesce(to_double(c, source), F.lit(float(default))),
                        None if low is None else float(low),
                        None if high is None else float(high))
    return F.coalesce(bounded.try_cast(target), F.lit(int(default)).cast(target))


def clamped_double(c: Column, default, low=None, high=None,
                   source: T.DataType = T.StringType()) -> Column:
    return clip(F.coalesce(to_double(c, source), F.lit(float(default))),
                None if low is None else float(low),
                None if high is None else float(high))


def clean_json(c: Column, default_text: str = "{}") -> Column:
    """Blank or unparsable text becomes the default; the rest is re-serialised
    compactly in source order."""
    text = F.trim(c)
    compact = F.when(P.is_bracketed(c), F.get_json_object(text, "$")).otherwise(text)
    return F.coalesce(F.when(~P.is_blank(c) & P.is_valid_json(c), compact), F.lit(default_text))


def enforce_enum(c: Column, values, default=None) -> Column:
    """Values outside the list, null included, take the default (or the first value)."""
    values = list(values)
    replacement = default if default is not None else (values[0] if values else None)
    return F.when(c.isin(*values), c).otherwise(F.lit(replacement))


def pad_to(c: Column, length: int) -> Column:
    """Right-pad with blanks; longer text is kept whole."""
    return F.when(F.length(c) < length, F.rpad(c, length, " ")).otherwise(c)


def truncate_to(c: Column, length: int) -> Column:
    return F.substring(c, 1, length)


def enforce_pattern(c: Column, pattern: str, default) -> Column:
    return F.when(P.matches_prefix(c, pattern), c).otherwise(F.lit(default))


def enforce_email(c: Column, default: str) -> Column:
    return F.when(P.is_email_strict(c), c).otherwise(F.lit(default))


def repair_email_like(c: Column, default: str) -> Column:
    return F.when(P.is_blank(c) | ~c.like(P.EMAIL_LOOSE_LIKE_PATTERN), F.lit(default)).otherwise(c)


def repair_email_domain(c: Column, default: str, suffix: str = ".com") -> Column:
    """Append a top-level domain where only that is missing, else the default."""
    stripped = F.trim(c)
    has_dot = F.substring_index(stripped, "@", -1).contains(".")
    completed = F.when(has_dot, stripped).otherwise(F.concat(stripped, F.lit(suffix)))
    return (F.when(P.is_email_strict(c), c)
            .when(stripped.contains("@") & P.is_email_strict(completed), completed)
            .otherwise(F.lit(default)))
