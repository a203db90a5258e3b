"""Log queries, batch and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepact import faults
from tablepact.catalogue.registry import query, scratch
from tablepact.operators import logs
from tablepact.streaming import logs as live

LINES = faults.sql("log_lines")
AS_OF = "2024-01-30 12:00:00"
LEVEL = """CASE WHEN contains(line, 'ERROR') OR contains(line, 'error') THEN 'ERROR'
  WHEN contains(line, 'WARN') OR contains(line, 'warning') THEN 'WARNING' END"""
PARSED = f"""(SELECT regexp_extract(line, '(\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}})', 1) AS timestamp,
  {LEVEL} AS level, trim(line) AS message FROM {LINES})"""
RECENT = f"""SELECT timestamp, level, message FROM {PARSED}
WHERE try_cast(timestamp AS TIMESTAMP) >= TIMESTAMP '{AS_OF}' - INTERVAL 24 HOUR AND level IS NOT NULL"""


@query("recent_errors", "L1", RECENT)
def recent_errors(spark, sf_dir):
    return logs.recent_errors(faults.table(spark, sf_dir, "log_lines"), 24, AS_OF)


@query("recent_error_count", "L1", f"SELECT count(*) AS error_count FROM ({RECENT})")
def recent_error_count(spark, sf_dir):
    return logs.error_count(recent_errors(spark, sf_dir))


@query("error_classes", "L2", f"""
SELECT CASE WHEN contains(message, 'ConversionException') THEN 'type mismatch'
  WHEN contains(message, 'NOT NULL constraint') THEN 'null in required field'
  WHEN contains(message, 'UNIQUE constraint') THEN 'duplicate values'
  WHEN contains(message, 'File not found') THEN 'missing source file'
  WHEN contains(message, 'Connection refused') THEN 'connection issue' ELSE 'other' END AS error_class,
  count(*) AS error_count FROM {PARSED} WHERE level IS NOT NULL GROUP BY 1""")
def error_classes(spark, sf_dir):
    parsed = logs.parse_lines(faults.table(spark, sf_dir, "log_lines")).filter(F.col("level").isNotNull())
    return logs.error_classes(parsed)


WINDOWS = f"""
SELECT CAST(time_bucket(INTERVAL 10 MINUTE, CAST(timestamp AS TIMESTAMP)) AS VARCHAR) AS window_start,
  CAST(time_bucket(INTERVAL 10 MINUTE, CAST(timestamp AS TIMESTAMP)) + INTERVAL 10 MINUTE AS VARCHAR) AS window_end,
  level, count(*) AS line_count FROM {PARSED} WHERE level IS NOT NULL GROUP BY ALL"""


def _as_text(windows):
    return windows.withColumns({c: F.col(c).cast("string") for c in ("window_start", "window_end")})


@query("log_level_windows", "L3", WINDOWS)
def log_level_windows(spark, sf_dir):
    return _as_text(logs.windowed_levels(faults.table(spark, sf_dir, "log_lines")))


@query("streamed_log_windows", "L3", WINDOWS)
def streamed_log_windows(spark, sf_dir):
    """The same counts from a stream over the log folder."""
    folder, out = scratch(spark, "log-stream"), scratch(spark, "windows")
    faults.table(spark, sf_dir, "log_lines").select("line").write.text(folder)
    windows = live.level_windows(live.stream_lines(spark, folder))
    live.write_windows(windows, out, scratch(spark, "stream-state")).awaitTermination()
    return _as_text(live.latest_windows(spark, out))


@query("watched_log_windows", "L3", f"""
WITH p AS (SELECT CAST(timestamp AS TIMESTAMP) AS t, level, event_id FROM (SELECT event_id, regexp_extract(line,
    '(\\d{{4}}-\\d{{2}}-\\d{{2}} \\d{{2}}:\\d{{2}}:\\d{{2}})', 1) AS timestamp, {LEVEL} AS level FROM {LINES}) WHERE level IS NOT NULL),
m AS (SELECT max(t) AS latest FROM p WHERE event_id % 3 <> 0),
w AS (SELECT time_bucket(INTERVAL 10 MINUTE, t) AS s, level,
  event_id % 3 = 0 AND time_bucket(INTERVAL 10 MINUTE, t) + INTERVAL 10 MINUTE <= latest - INTERVAL 1 HOUR AS late FROM p, m)
SELECT CASE WHEN late THEN 'late' ELSE 'counted' END AS kind, CAST(s AS VARCHAR) AS window_start, level, count(*) AS line_count
FROM w GROUP BY ALL""")
def watched_log_windows(spark, sf_dir):
    """A third of the lines comes after all others: lines of closed windows are kept as late ones."""
    folder, out, state = scratch(spark, "log-stream"), scratch(spark, "watched"), scratch(spark, "watch-state")
    lines = faults.table(spark, sf_dir, "log_lines")
    for late in (False, True):
        lines.where((F.col("event_id") % 3 == 0) == F.lit(late)).select("line").write.mode("append").text(folder)
        live.watch_windows(live.stream_lines(spark, folder), out, state).awaitTermination()
    counted = live.closed_windows(spark, out).unionByName(live.open_windows(spark, out)).select(
        F.lit("counted").alias("kind"), F.col("window_start").cast("string"), "level", "line_count")
    late = live.late_lines_of(spark, out).groupBy(F.window("event_time", "10 minutes")["start"].cast("string").alias("window_start"), "level")
    kept = late.agg(F.count(F.lit(1)).alias("line_count")).select(F.lit("late").alias("kind"), "window_start", "level", "line_count")
    return counted.unionByName(kept).groupBy("kind", "window_start", "level").agg(F.sum("line_count").alias("line_count"))
