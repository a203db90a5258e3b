"""Attempt-log analytics: running counters, limits, repeated errors, back-off."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.functions.text import normalise_error
from tablepact.plans.ordered import range_window, with_earlier, with_ranges


@dataclass(frozen=True)
class Limits:
    """Default limits and back-off settings."""

    max_regenerations: int = 3
    max_executions: int = 2
    max_pipelines: int = 3
    max_total_attempts: int = 18
    backoff_base_seconds: float = 1.0
    backoff_max_seconds: float = 5.0


ATTEMPT_TYPES = ("regeneration", "execution")


def attempt_history(log: DataFrame, order_by: Sequence[str] = ("seq",),
                    ranges: int | None = None, prior: DataFrame | None = None) -> DataFrame:
    """Running counters and the previous error of every attempt, in log order.

    Adds, as of each attempt: ``regeneration_attempts`` and ``execution_attempts``
    of its pipeline, ``attempt_num`` (the one of its type), ``total_attempts`` and
    ``total_pipelines`` over the whole log, and ``last_error``, the latest
    non-empty error of the pipeline before it.  Successes do not reset it.
    An attempt of another type makes the query fail.
    ``prior`` holds what came before this log: ``pipeline``, ``regeneration_attempts``,
    ``execution_attempts``, ``attempts`` and ``last_error``, one row for each pipeline.
    The ranges of the log are written to the checkpoint folder when this is called.
    """
    order = list(order_by)
    has_error = F.col("error").isNotNull() & (F.col("error") != "")
    error = F.when(has_error, F.col("error"))
    regeneration = F.col("type") == "regeneration"
    execution = F.col("type") == "execution"
    known = F.coalesce(F.col("type").isin(*ATTEMPT_TYPES), F.lit(False))
    log = log.filter(F.assert_true(known, "Unknown attempt type").isNull())
    ranged = with_ranges(log, order, ranges)

    per_pipeline = with_earlier(
        ranged, ["pipeline"],
        {"_reg": F.count_if(regeneration), "_exe": F.count_if(execution),
         "_err": F.max_by(error, F.when(has_error, F.struct(*order))), "_n": F.count(F.lit(1))},
        {"_reg_before": F.sum("_reg"), "_exe_before": F.sum("_exe"),
         "_err_before": F.last("_err", ignorenulls=True), "_n_before": F.sum("_n")})
    rows_prior, pipelines_prior = F.lit(0), F.lit(0)
    if prior is not None:
        per_pipeline = _after(per_pipeline, prior)
        known = prior.agg(F.coalesce(F.sum("attempts"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("p")).first()
        rows_prior, pipelines_prior = F.lit(known["n"]), F.lit(known["p"])
    per_pipeline = per_pipeline.checkpoint()
    # Ranges are few, so accumulating over them fits one task.
    whole_log = with_earlier(
        per_pipeline, [], {"_rows": F.sum("_n"), "_new": F.count_if(F.col("_n_before").isNull())},
        {"_rows_before": F.sum("_rows"), "_new_before": F.sum("_new")}).drop("_rows", "_new")

    # One shuffle on the range serves both windows: no task holds a pipeline whole.
    local = range_window(["pipeline"], order)
    in_range = range_window([], order).rowsBetween(Window.unboundedPreceding, 0)
    up_to_here = local.rowsBetween(Window.unboundedPreceding, 0)
    before_here = local.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0)
    earlier = per_pipeline.select(
        F.col("_range").alias("_r"), F.col("pipeline").alias("_p"), "_reg_before", "_exe_before",
        "_err_before", "_n_before")
    counted = (ranged.repartition("_range")
               .join(earlier, (F.col("_range") == F.col("_r")) & F.col("pipeline").eqNullSafe(F.col("_p")))
               .select(
        *log.columns, "_range",
        (F.coalesce("_reg_before", zero) + F.count_if(regeneration).over(up_to_here))
        .alias("regeneration_attempts"),
        (F.coalesce("_exe_before", zero) + F.count_if(execution).over(up_to_here))
        .alias("execution_attempts"),
        F.coalesce(F.last(error, ignorenulls=True).over(before_here), "_err_before")
        .alias("last_error"),
        (F.col("_n_before").isNull() & (F.row_number().over(local) == 1)).alias("_is_new")))
    return counted.join(F.broadcast(whole_log), "_range").select(
        *log.columns, "regeneration_attempts", "execution_attempts",
        F.when(regeneration, F.col("regeneration_attempts"))
        .otherwise(F.col("execution_attempts")).alias("attempt_num"),
        (rows_prior + F.coalesce("_rows_before", zero) + F.count(F.lit(1)).over(in_range)).alias("total_attempts"),
        (pipelines_prior + F.coalesce("_new_before", zero) + F.count_if(F.col("_is_new")).over(in_range))
        .alias("total_pipelines"),
        "last_error")


def _after(per_pipeline: DataFrame, prior: DataFrame) -> DataFrame:
    """What came before each range, with what came before the log."""
    known = prior.select(F.col("pipeline").alias("_known"), F.col("regeneration_attempts").alias("_k_reg"),
                         F.col("execution_attempts").alias("_k_exe"), F.col("last_error").alias("_k_err"),
                         F.col("attempts").alias("_k_n"))

    def added(name: str, more: str):
        return F.when(F.col(name).isNotNull() | F.col(more).isNotNull(),
                      F.coalesce(name, F.lit(0)) + F.coalesce(more, F.lit(0))).alias(name)

    changed = {"_reg_before": added("_reg_before", "_k_reg"), "_exe_before": added("_exe_before", "_k_exe"),
               "_n_before": added("_n_before", "_k_n"), "_err_before": F.coalesce("_err_before", "_k_err").alias("_err_before")}
    joined = per_pipeline.join(known, F.col("pipeline").eqNullSafe(F.col("_known")), "left")
    return joined.select(*[changed.get(c, F.col(c)) for c in per_pipeline.columns])


def is_allowed(limits: Limits = Limits()) -> Column:
    """False once the counter of the attempt's type, the pipelines or the total exceed a limit."""
    own_limit = F.when(F.col("type") == "regeneration", limits.max_regenerations).otherwise(
        limits.max_executions)
    return ~((F.col("attempt_num") > own_limit)
             | (F.col("total_pipelines") > limits.max_pipelines)
             | (F.col("total_attempts") > limits.max_total_attempts))


def limit_message(limits: Limits = Limits()) -> Column:
    """All exceeded limits joined by `` | ``, or that the attempt is within limits."""
    name = F.col("pipeline")

    def exceeded(counter: str, limit: int, text: str, *args) -> Column:
        return F.when(F.col(counter) > limit, F.format_string(text, *args))

    parts = [
        exceeded("regeneration_attempts", limits.max_regenerations,
                 f"Max regenerations ({limits.max_regenerations}) exceeded for %s: %d attempts",
                 name, F.col("regeneration_attempts")),
        exceeded("execution_attempts", limits.max_executions,
                 f"Max executions ({limits.max_executions}) exceeded for %s: %d attempts",
                 name, F.col("execution_attempts")),
        exceeded("total_attempts", limits.max_total_attempts,
                 f"Max total attempts ({limits.max_total_attempts}) exceeded: %d attempts",
                 F.col("total_attempts")),
        exceeded("total_pipelines", limits.max_pipelines,
                 f"Max pipelines ({limits.max_pipelines}) exceeded: %d pipelines",
                 F.col("total_pipelines")),
    ]
    message = F.concat_ws(" | ", *parts)
    return F.when(message != "", message).otherwise(F.concat(F.lit("Within limits for "), name))


def is_repeated_error() -> Column:
    """The attempt's error equals the previous one up to case and white space."""
    known = F.col("last_error").isNotNull() & (F.col("last_error") != "")
    same = normalise_error(F.coalesce("error", F.lit(""))) == normalise_error(F.col("last_error"))
    return F.coalesce(known & same, F.lit(False))


def backoff_seconds(attempt_num: Column, limits: Limits = Limits()) -> Column:
    """Doubling from the base at the first attempt, up to the maximum."""
    return F.least(F.lit(limits.backoff_base_seconds) * F.pow(F.lit(2.0), attempt_num - 1),
                   F.lit(limits.backoff_max_seconds))


def error_history(history: DataFrame, pipeline: str | None = None) -> DataFrame:
    """Errors with the attempt number they belong to, of one pipeline or all."""
    rows = history.filter(F.col("error").isNotNull() & (F.col("error") != ""))
    if pipeline is not None:
        rows = rows.filter(F.col("pipeline") == pipeline)
    extra = [c for c in history.columns if c in ("seq", "timestamp")]
    return rows.select(*extra, "pipeline", "type", "attempt_num", "error")


def pipeline_totals(log: DataFrame) -> DataFrame:
    """Final counters per pipeline."""
    return log.groupBy("pipeline").agg(
        F.count_if(F.col("type") == "regeneration").alias("regeneration_attempts"),
        F.count_if(F.col("type") == "execution").alias("execution_attempts"),
        F.count(F.lit(1)).alias("attempts"))
