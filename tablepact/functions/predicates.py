"""Boolean column predicates.

Every predicate is a native Spark expression, so it stays inside whole-stage
code generation.  The three e-mail definitions are deliberately separate:
cleaning and frame validation use the strict form, generated checks use the
LIKE form and the row-level check uses the basic form.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
EMAIL_STRICT_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
EMAIL_LIKE_PATTERN = "%_@_%._%"
EMAIL_LOOSE_LIKE_PATTERN = "%@%.%"
DASHED_DATE_LIKE_PATTERN = "%-%-%"
LITERAL_BRACKET_DIGIT_LIKE_PATTERN = "%[0-9]%"
INVALID_LITERAL = "INVALID"
TRUE_WORDS = ("true", "1", "yes")
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)
# ----------------------------------------------------------------------------

INTEGER_TEXT_PATTERN = r"\A-*[0-9]+\z"

# Python's float() grammar; underscores are allowed between digits only.
_DIGITS_LOOSE = r"[0-9](?:_?[0-9])*"
_FLOAT = r"\A\s*[+-]?(?:(?:{d}(?:\.(?:{d})?)?|\.{d})(?:[eE][+-]?{d})?|(?i:{words}))\s*\z"
FLOAT_TEXT_PATTERN = _FLOAT.replace("{d}", _DIGITS_LOOSE).replace("{words}", "inf(?:inity)?|nan")
# What a numeric coercion turns into a value: no underscores, and NaN counts as missing.
NUMBER_TEXT_PATTERN = _FLOAT.replace("{d}", "[0-9]+").replace("{words}", "inf(?:inity)?")
# int() grammar: optional sign, optional surrounding blanks.
INT_PARSE_PATTERN = r"\A\s*[+-]?" + _DIGITS_LOOSE + r"\s*\z"

ISO_DATE_PATTERN = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"

COMPACT_DATE = "yyyyMMdd"

# Shape -> datetime pattern.  This is the documented subset of free-form dates
# that type inference recognises; the shape test keeps the formatter (whose
# failures are costly) away from text that cannot match.
DATE_SHAPES = (
    (r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "yyyy-M-d"),
    (r"[0-9]{4}/[0-9]{1,2}/[0-9]{1,2}", "yyyy/M/d"),
    (r"[0-9]{4}\.[0-9]{1,2}\.[0-9]{1,2}", "yyyy.M.d"),
    (r"[0-9]{8}", COMPACT_DATE),
    (r"[0-9]{4}-[0-9]{1,2}", "yyyy-M"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "M/d/yyyy"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}", "d/M/yyyy"),
    (r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "M-d-yyyy"),
    (r"[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "d-M-yyyy"),
    (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "M.d.yyyy"),
    (r"[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4}", "d.M.yyyy"),
    (r"[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}", "MMM d[,] yyyy"),
    (r"[A-Za-z]{3,9} [0-9]{1,2},? [0-9]{4}", "MMMM d[,] yyyy"),
    (r"[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}", "d MMM yyyy"),
    (r"[0-9]{1,2} [A-Za-z]{3,9} [0-9]{4}", "d MMMM yyyy"),
    (r"[0-9]{1,2}-[A-Za-z]{3,9}-[0-9]{4}", "d-MMM-yyyy"),
    (r"[0-9]{1,2}-[A-Za-z]{3,9}-[0-9]{4}", "d-MMMM-yyyy"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "M/d/yy"),
    (r"[0-9]{1,2}/[0-9]{1,2}/[0-9]{2}", "d/M/yy"),
)
# A weekday before a date and a time behind it, which do not change the day.
WEEKDAY = r"(?i:mon|tue|tues|wed|wednes|thu|thur|thurs|fri|sat|satur|sun)(?i:day)?,? "
TIME_OF_DAY = (r"(?:,? |T)(?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:\.[0-9]{1,9})?)?(?: ?(?i:[AP]M))?")
# Years of two digits from here on are of the century before.
CENTURY_BREAK = 69
DATETIME_SHAPE = (
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}(?::[0-9]{2}(?:\.[0-9]{1,9})?)?"
    r"(?:Z|[+-][0-9]{2}:?[0-9]{2})?"
)


def _whole(pattern: str) -> str:
    """Anchored once in front, so that the matcher tries the first position only."""
    return r"\A(?:" + pattern + r")\z"


def is_blank(c: Column) -> Column:
    """Null or empty text; CSV readers differ on which of the two they give."""
    return c.isNull() | (c == F.lit(""))


def is_na_token(c: Column) -> Column:
    return c.isin(*NA_TOKENS)


def is_integer_text(c: Column) -> Column:
    """Digits after any number of leading minus signs; a plus sign is refused."""
    return c.rlike(INTEGER_TEXT_PATTERN)


def is_float_text(c: Column) -> Column:
    return c.rlike(FLOAT_TEXT_PATTERN)


def parse_date(c: Column, day_first: bool = False) -> Column:
    """The date a text of one of the documented shapes stands for, else null.

    The only date parser: inference, row check, typed read and cleaning share it.
    Where a shape does not tell day from month, the month comes first unless
    ``day_first``; the other order is taken where the first gives no date.  Of a
    date-time the day is taken as written.

    One CASE, so a value is parsed only by the formats of the first shape it has;
    the common ISO form and text of no shape at all need one or two tests.
    """
    text = F.trim(c)
    by_shape: dict[str, list[str]] = {}
    for shape, fmt in DATE_SHAPES:
        by_shape.setdefault(shape, []).append(fmt)
    dates = "|".join(by_shape)
    any_shape = _whole("|".join([DATETIME_SHAPE, dates, f"(?:{WEEKDAY})?(?:{dates})(?:{TIME_OF_DAY})?"]))
    written_day = F.when(F.try_to_timestamp(text).isNotNull(), F.substring(text, 1, 10).try_cast("date"))
    out = (F.when(text.rlike(ISO_DATE_PATTERN), text.try_cast("date"))
           .when(~text.rlike(any_shape), F.lit(None).cast("date"))
           .when(text.rlike(_whole(DATETIME_SHAPE)), written_day))
    for shape, formats in by_shape.items():
        out = out.when(text.rlike(_whole(shape)), F.coalesce(*[_to_date(text, f) for f in _in_order(formats, day_first)]))
    # With a weekday or a time around it; rare, so the formats are tried without a test of the shape each.
    bare = F.regexp_replace(F.regexp_replace(text, r"\A" + WEEKDAY, ""), TIME_OF_DAY + r"\z", "")
    formats = [f for own in by_shape.values() for f in _in_order(own, day_first)]
    return out.otherwise(F.coalesce(*[_to_date(bare, f) for f in formats]))


def _in_order(formats: list[str], day_first: bool) -> list[str]:
    return sorted(formats, key=lambda f: f.startswith("M")) if day_first else formats


def _to_date(text: Column, fmt: str) -> Column:
    out = F.try_to_date(text, fmt)
    if fmt.endswith("yyyy") or not fmt.endswith("yy"):
        return out
    return F.when(F.year(out) % 100 >= CENTURY_BREAK, F.add_months(out, -1200)).otherwise(out)


#: Two numbers of which one is the day and one the month, and a year.
UNORDERED_DATE = r"\A\s*([0-9]{1,2})([/.-])([0-9]{1,2})\2(?:[0-9]{4}|[0-9]{2})\b"


def date_parts(c: Column) -> tuple[Column, Column]:
    """The two leading numbers of a date whose shape does not tell day from month; else null."""
    unordered = c.rlike(UNORDERED_DATE)
    return tuple(F.when(unordered, F.regexp_extract(c, UNORDERED_DATE, i).try_cast("int")) for i in (1, 3))


def is_date_text(c: Column) -> Column:
    """True when the text parses to a date; null text is no date."""
    return parse_date(c).isNotNull()


def is_bracketed(c: Column) -> Column:
    t = F.trim(c)
    return (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))


def is_valid_json(c: Column) -> Column:
    """The whole text is exactly one JSON value.

    Spark's JSON functions stop at the end of the first value, so trailing text
    would pass.  Read as the only element of an array the rest of the text must
    be empty or start with ``]``; read as the only member of an object it must
    be empty or start with ``}``; both together leave only the empty rest.  The
    second reading is skipped for text without any ``]``.  Single-quoted strings,
    which those functions also tolerate, are sent through the strict variant
    parser.
    """
    one_element = F.json_array_length(F.concat(F.lit("["), c, F.lit("]"))) == 1
    one_member = F.size(F.json_object_keys(F.concat(F.lit('{"v":'), c, F.lit("}")))) == 1
    no_rest = ~c.contains("]") | one_member
    strict_quotes = ~c.contains("'") | F.try_parse_json(c).isNotNull()
    return F.coalesce(one_element & no_rest & strict_quotes, F.lit(False))


def is_json_text(c: Column) -> Column:
    """Bracketed object or array text that parses."""
    return is_bracketed(c) & is_valid_json(c)


# Bits of ``type_flags``.
INTEGER_FLAG, FLOAT_FLAG, DATE_FLAG, JSON_FLAG = 1, 2, 4, 8
ALL_FLAGS = 15


def type_flags(c: Column, with_json: bool = True) -> Column:
    """Which of integer, float, date and JSON the text can be, as bits.

    Empty text can be anything, null has no flags.  The tests run in order and
    stop at the first that holds; what an integer or float can be besides is
    decided by cheaper means than the full tests (of the date shapes only the
    compact one is an integer and none is a float; only a doubled sign keeps an
    integer from being a float).
    """
    as_float = F.when(c.startswith("--"), 0).otherwise(FLOAT_FLAG)
    as_date = F.when((F.length(c) == 8) & F.try_to_date(c, COMPACT_DATE).isNotNull(), DATE_FLAG).otherwise(0)
    out = (F.when(c.isNull(), F.lit(None).cast("int")).when(c == "", ALL_FLAGS)
           .when(is_integer_text(c), F.lit(INTEGER_FLAG) + as_float + as_date)
           .when(is_float_text(c), FLOAT_FLAG).when(is_date_text(c), DATE_FLAG))
    if with_json:
        out = out.when(is_json_text(c), JSON_FLAG)
    return out.otherwise(0)


def is_email_strict(c: Column) -> Column:
    return c.rlike(EMAIL_STRICT_PATTERN)


def is_email_like(c: Column) -> Column:
    return c.like(EMAIL_LIKE_PATTERN)


def is_email_basic(c: Column) -> Column:
    """An ``@`` somewhere and a dot after the last one."""
    return c.contains("@") & F.substring_index(c, "@", -1).contains(".")


def is_int_parsable(c: Column) -> Column:
    return c.rlike(INT_PARSE_PATTERN)


def is_number_text(c: Column) -> Column:
    return c.rlike(NUMBER_TEXT_PATTERN)


def matches_prefix(c: Column, pattern: str) -> Column:
    """Regular expression anchored at the start only."""
    return c.rlike(r"\A(?:" + pattern + ")")


def in_values(c: Column, values: Iterable) -> Column:
    return c.isin(*list(values))


def is_not_a_number(c: Column) -> Column:
    """Null, NaN or positive infinity."""
    d = c.cast("double")
    return d.isNull() | F.isnan(d) | (d == F.lit(float("inf")))


def is_negative_text(c: Column) -> Column:
    """Starts with a minus sign, or parses to a number below zero."""
    value = F.when(c.rlike(NUMBER_TEXT_PATTERN), c.try_cast("double"))
    return F.coalesce(c.startswith("-") | (value < 0), F.lit(False))


def lacks_digit(c: Column, literal_brackets: bool = False) -> Column:
    """No digit in the text.

    ``literal_brackets=True`` reproduces the LIKE form, in which the brackets
    are ordinary characters, so nearly every non-null value counts.
    """
    if literal_brackets:
        return ~c.like(LITERAL_BRACKET_DIGIT_LIKE_PATTERN)
    return ~c.rlike("[0-9]")


def is_not_dashed_date(c: Column) -> Column:
    return ~c.like(DASHED_DATE_LIKE_PATTERN)
