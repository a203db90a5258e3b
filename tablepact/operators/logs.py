"""Log analytics: levels, recent errors, error classes."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values -----------------------------------------------------------
STAMP_PATTERN = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
STAMP_FORMAT = "yyyy-MM-dd HH:mm:ss"
ERROR_WORDS = ("ERROR", "error")
WARNING_WORDS = ("WARN", "warning")
ERROR_CLASSES = (
    ("ConversionException", "type mismatch"),
    ("NOT NULL constraint", "null in required field"),
    ("UNIQUE constraint", "duplicate values"),
    ("File not found", "missing source file"),
    ("Connection refused", "connection issue"),
)
OTHER_CLASS = "other"
# ----------------------------------------------------------------------------


def _has_any(line: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | line.contains(w)
    return out


def log_level(line: Column) -> Column:
    """ERROR, WARNING or null, by the words in the line."""
    return F.when(_has_any(line, ERROR_WORDS), "ERROR").when(_has_any(line, WARNING_WORDS), "WARNING")


def parse_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """Stamped lines with level; lines without a valid time stamp are dropped.

    Works on batch and streaming frames.
    """
    text = F.regexp_extract(column, STAMP_PATTERN, 1)
    stamp = F.when(text != "", F.try_to_timestamp(text, F.lit(STAMP_FORMAT)))
    return lines.select(
        stamp.alias("event_time"), text.alias("timestamp"),
        log_level(F.col(column)).alias("level"), F.trim(F.col(column)).alias("message"),
    ).filter(F.col("event_time").isNotNull())


def recent_errors(lines: DataFrame, hours: float = 24, as_of: str | None = None,
                  column: str = "line") -> DataFrame:
    """Errors and warnings of the last hours before ``as_of`` (now by default)."""
    now = F.current_timestamp() if as_of is None else F.lit(as_of).cast("timestamp")
    cutoff = now - F.lit(timedelta(hours=hours))
    parsed = parse_lines(lines, column)
    return parsed.filter((F.col("event_time") >= cutoff) & F.col("level").isNotNull()).select(
        "timestamp", "level", "message")


def error_count(errors: DataFrame) -> DataFrame:
    """Number of entries, warnings included."""
    return errors.agg(F.count(F.lit(1)).alias("error_count"))


def error_class(message: Column) -> Column:
    """Likely cause by the first known phrase in the message."""
    out = None
    for phrase, cause in ERROR_CLASSES:
        hit = message.contains(phrase)
        out = F.when(hit, cause) if out is None else out.when(hit, cause)
    return out.otherwise(OTHER_CLASS)


def error_classes(errors: DataFrame, column: str = "message") -> DataFrame:
    return errors.groupBy(error_class(F.col(column)).alias("error_class")).agg(
        F.count(F.lit(1)).alias("error_count"))


def windowed_levels(lines: DataFrame, column: str = "line", width: str = "10 minutes") -> DataFrame:
    """Errors and warnings per time window and level."""
    parsed = parse_lines(lines, column).filter(F.col("level").isNotNull())
    return parsed.groupBy(F.window("event_time", width), "level").agg(
        F.count(F.lit(1)).alias("line_count")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
        "level", "line_count")
