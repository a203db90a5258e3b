"""End-to-end flows: strict ingestion, clean-and-validate, output validation."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.contract import TableContract
from tablepact.operators import checks as K
from tablepact.operators.clean import clean
from tablepact.sources import files, sinks, strict


@dataclass(frozen=True)
class LoadOutcome:
    loaded: bool
    rows: int
    error: str | None
    rejects: DataFrame | None


def ingest_strict(spark: SparkSession, path: str, contract: TableContract, target: str) -> LoadOutcome:
    """Validate the file (or the files of a folder), stage it as text and load it all or not at all.

    A refused load comes back with the error and the rows that break it.
    """
    files.validate_sources(spark, path)
    staged = files.stage_csv(spark, path)
    try:
        return LoadOutcome(True, strict.strict_load_to(staged, contract, target), None, None)
    except Exception as exc:  # a failing assertion reaches the driver as a Java error
        bad = strict.reject_sample(staged, strict.breaks_load(staged, contract))
        return LoadOutcome(False, 0, str(exc).splitlines()[0], bad)


def clean_and_check(raw: DataFrame, contract: TableContract, output_table: str | None = None) -> DataFrame:
    """Clean and run all generated checks on the result in one scan."""
    cleaned = clean(raw, contract)
    return K.run_checks(cleaned, K.generate_checks(contract, output_table or contract.output_table))


def clean_check_and_write(raw: DataFrame, contract: TableContract, path: str) -> tuple[DataFrame, int]:
    """Clean, count violations while writing, and return (check results, rows).

    The raw table is read once and the written one not at all.  A check that cannot
    run, or cannot decide some row, is an ERROR, as in ``checks.run_checks``.
    """
    cleaned = clean(raw, contract)
    checks = K.generate_checks(contract, contract.output_table)
    found = K.measures(cleaned, checks)
    metrics = {"rows": F.count(F.lit(1))}
    for i, own in enumerate(found):
        metrics |= {f"{kind}{i}": c for kind, c in (("c", own.count), ("u", own.undecided)) if c is not None}
    seen = sinks.observed_write(cleaned, path, metrics)
    rows = []
    for i, (check, own) in enumerate(zip(checks, found, strict=True)):
        undecided = seen.get(f"u{i}")
        error = own.error or (own.reason.replace("%d", str(undecided)) if undecided else None)
        rows.append((check.check_id, None if error else seen.get(f"c{i}"), error))
    spark = raw.sparkSession
    counted = K.checks_frame(spark, checks).join(
        F.broadcast(spark.createDataFrame(rows, "check_id string, actual bigint, error string")), "check_id")
    results = counted.select(
        "check_id", "description", "check_type", "severity", "column", "expected", "actual",
        K.verdict(F.col("expected"), F.col("actual"), F.col("error")).alias("status"))
    return results, seen["rows"]


def measured_write(df: DataFrame, path: str, query_count: int = 1) -> DataFrame:
    """Write and return one row of run metrics for ``consistency.throughput_status``.

    The rows are counted by the write itself.
    """
    start = time.perf_counter()
    rows = sinks.counted_write(df, path)
    return df.sparkSession.createDataFrame(
        [(rows, time.perf_counter() - start, query_count)], "rows long, seconds double, query_count int")


def validate_output(spark: SparkSession, contract: TableContract, output: DataFrame,
                    checks_folder: str, source: DataFrame | None = None,
                    output_table: str | None = None, name: str = "") -> DataFrame:
    """Stored or generated checks, run and rolled up into a one-row report."""
    table = output_table or contract.output_table
    checks = sinks.cached_checks(spark, contract, checks_folder, table)
    results = K.run_checks(output, checks)
    if source is None:
        source = K.find_source(spark, table)
    return K.report(results, output, source, name=name or contract.name, output_table=table)
