"""Attempt-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablepact import faults
from tablepact.catalogue.registry import query, scratch
from tablepact.operators import attempts as A
from tablepact.streaming import attempts as live

LOG = faults.sql("attempt_log")
HISTORY = f"""
SELECT seq, pipeline, type, error,
  count(*) FILTER (WHERE type = 'regeneration') OVER p AS regeneration_attempts,
  count(*) FILTER (WHERE type = 'execution') OVER p AS execution_attempts,
  count(*) OVER pt AS attempt_num, count(*) OVER (ORDER BY seq) AS total_attempts,
  (SELECT count(*) FROM (SELECT min(seq) AS first_seq FROM {LOG} GROUP BY pipeline) WHERE first_seq <= a.seq) AS total_pipelines,
  last_value(error IGNORE NULLS) OVER (PARTITION BY pipeline ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS last_error
FROM {LOG} a WINDOW p AS (PARTITION BY pipeline ORDER BY seq), pt AS (PARTITION BY pipeline, type ORDER BY seq)"""

# Limits that large logs reach at different places.
LIMITS = A.Limits(max_regenerations=30, max_executions=20, max_pipelines=2, max_total_attempts=150)


def history(spark, sf_dir):
    return A.attempt_history(faults.table(spark, sf_dir, "attempt_log"), ["seq"])


@query("attempt_counters", "A1", HISTORY)
def attempt_counters(spark, sf_dir):
    return history(spark, sf_dir)


@query("attempt_verdicts", "A2", f"""
SELECT seq, NOT (attempt_num > CASE WHEN type = 'regeneration' THEN 30 ELSE 20 END OR total_pipelines > 2
  OR total_attempts > 150) AS allowed FROM ({HISTORY})""")
def attempt_verdicts(spark, sf_dir):
    return history(spark, sf_dir).select("seq", A.is_allowed(LIMITS).alias("allowed"))


@query("attempt_limit_messages", "A3", f"""
SELECT seq, CASE WHEN m <> '' THEN m ELSE concat('Within limits for ', pipeline) END AS message FROM (
  SELECT seq, pipeline, concat_ws(' | ',
    CASE WHEN regeneration_attempts > 30 THEN concat('Max regenerations (30) exceeded for ', pipeline, ': ', regeneration_attempts, ' attempts') END,
    CASE WHEN execution_attempts > 20 THEN concat('Max executions (20) exceeded for ', pipeline, ': ', execution_attempts, ' attempts') END,
    CASE WHEN total_attempts > 150 THEN concat('Max total attempts (150) exceeded: ', total_attempts, ' attempts') END,
    CASE WHEN total_pipelines > 2 THEN concat('Max pipelines (2) exceeded: ', total_pipelines, ' pipelines') END) AS m
  FROM ({HISTORY}))""")
def attempt_limit_messages(spark, sf_dir):
    return history(spark, sf_dir).select("seq", A.limit_message(LIMITS).alias("message"))


@query("repeated_errors", "A4", f"""
SELECT seq, coalesce(last_error <> '' AND trim(regexp_replace(lower(coalesce(error, '')), '\\s+', ' ', 'g'))
  = trim(regexp_replace(lower(last_error), '\\s+', ' ', 'g')), false) AS repeated FROM ({HISTORY})""")
def repeated_errors(spark, sf_dir):
    return history(spark, sf_dir).select("seq", A.is_repeated_error().alias("repeated"))


@query("attempt_backoff", "A5", f"""
SELECT seq, least(1.0::DOUBLE * pow(2, attempt_num - 1), 5.0::DOUBLE) AS delay_seconds FROM ({HISTORY})""")
def attempt_backoff(spark, sf_dir):
    return history(spark, sf_dir).select("seq", A.backoff_seconds(F.col("attempt_num")).alias("delay_seconds"))


@query("attempt_error_history", "A6", f"""
SELECT seq, pipeline, type, attempt_num, error FROM ({HISTORY}) WHERE error IS NOT NULL AND pipeline = 'p1'""")
def attempt_error_history(spark, sf_dir):
    return A.error_history(history(spark, sf_dir), "p1")


@query("attempt_totals", "A1", f"""
SELECT pipeline, count(*) FILTER (WHERE type = 'regeneration') AS regeneration_attempts,
  count(*) FILTER (WHERE type = 'execution') AS execution_attempts, count(*) AS attempts FROM {LOG} GROUP BY pipeline""")
def attempt_totals(spark, sf_dir):
    return A.pipeline_totals(faults.table(spark, sf_dir, "attempt_log"))


def watched(spark, sf_dir, batches=3):
    """The attempt log in parts that appear one after the other; the stream is started anew for each."""
    path, out, state = scratch(spark, "attempt-stream"), scratch(spark, "verdicts"), scratch(spark, "attempt-state")
    log = faults.table(spark, sf_dir, "attempt_log")
    step = (log.agg(F.max("seq")).first()[0] or 0) // batches + 1
    for i in range(batches):
        log.where((F.col("seq") >= i * step) & (F.col("seq") < (i + 1) * step)).write.mode("append").parquet(path)
        live.watch(spark.readStream.schema(log.schema).parquet(path), out, state, limits=LIMITS).awaitTermination()
    return out


@query("streamed_attempt_verdicts", "A1 A2 A4 A5", f"""
SELECT seq, attempt_num, total_attempts, total_pipelines, last_error,
  NOT (attempt_num > CASE WHEN type = 'regeneration' THEN 30 ELSE 20 END OR total_pipelines > 2 OR total_attempts > 150) AS allowed,
  coalesce(last_error <> '' AND trim(regexp_replace(lower(coalesce(error, '')), '\\s+', ' ', 'g'))
    = trim(regexp_replace(lower(last_error), '\\s+', ' ', 'g')), false) AS repeated,
  least(1.0::DOUBLE * pow(2, attempt_num - 1), 5.0::DOUBLE) AS delay_seconds FROM ({HISTORY})""")
def streamed_attempt_verdicts(spark, sf_dir):
    """The verdicts of a stream that is stopped and started again in between."""
    return live.verdicts(spark, watched(spark, sf_dir)).select(
        "seq", "attempt_num", "total_attempts", "total_pipelines", "last_error", "allowed", "repeated", "delay_seconds")


@query("streamed_attempt_totals", "A1", f"""
SELECT pipeline, count(*) FILTER (WHERE type = 'regeneration') AS regeneration_attempts,
  count(*) FILTER (WHERE type = 'execution') AS execution_attempts, count(*) AS attempts FROM {LOG} GROUP BY pipeline""")
def streamed_attempt_totals(spark, sf_dir):
    """Counters as of the end of a stream."""
    return live.totals(spark, watched(spark, sf_dir, 2)).drop("last_error")
