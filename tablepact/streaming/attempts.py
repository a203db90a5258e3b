"""Attempt limits as they happen: the counters of the attempt log over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tablepact.operators import attempts as A
from tablepact.streaming.versions import Versions, each_batch

STATE = "pipeline string, regeneration_attempts long, execution_attempts long, attempts long, last_error string"


def totals_after(prior: DataFrame, log: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Counters and latest error of every pipeline: those of before and those of new attempts."""
    has_error = F.col("error").isNotNull() & (F.col("error") != "")
    new = log.groupBy("pipeline").agg(
        F.count_if(F.col("type") == "regeneration").alias("regeneration_attempts"),
        F.count_if(F.col("type") == "execution").alias("execution_attempts"),
        F.count(F.lit(1)).alias("attempts"),
        F.max_by(F.when(has_error, F.col("error")), F.when(has_error, F.struct(*order_by))).alias("last_error"))
    both = prior.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    counters = [F.sum(c).alias(c) for c in ("regeneration_attempts", "execution_attempts", "attempts")]
    # At most one row of before and one of now for each pipeline.
    latest = F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("_new"))).alias("last_error")
    return both.groupBy("pipeline").agg(*counters, latest)


def watch(log: DataFrame, path: str, checkpoint: str, order_by: Sequence[str] = ("seq",),
          limits: A.Limits = A.Limits()) -> StreamingQuery:
    """Counters, last error, verdict, message and delay of every attempt of a stream.

    Attempts are counted in the order of ``order_by`` within a micro-batch, and
    batch after batch.  The state is one row for each pipeline, written with each
    batch, so restarts neither lose nor repeat an attempt.  ``verdicts`` reads the result.
    """
    spark = log.sparkSession
    state = Versions(spark, f"{path}/state", STATE)

    def work(batch: DataFrame, number: int) -> None:
        prior = state.before(number)
        found = A.attempt_history(batch, order_by, prior=prior).select(
            "*", A.is_allowed(limits).alias("allowed"), A.limit_message(limits).alias("message"),
            A.is_repeated_error().alias("repeated"),
            A.backoff_seconds(F.col("attempt_num"), limits).alias("delay_seconds"))
        found.write.mode("overwrite").parquet(f"{path}/verdicts/batch={number}")
        state.write(totals_after(prior, batch, order_by), number)

    return each_batch(log, work, checkpoint)


def verdicts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/verdicts")


def totals(spark: SparkSession, path: str) -> DataFrame:
    """Counters of every pipeline as of now."""
    return Versions(spark, f"{path}/state", STATE).last()
