"""Writing tables, checks, reports and attempt logs."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import TableContract
from tablepact.operators.checks import (
    CHECK_SCHEMA,
    Check,
    checks_frame,
    checks_from_frame,
    generate_checks,
)
from tablepact.sources.files import path_exists

# Layout of the attempt log.
ATTEMPT_SCHEMA = T.StructType([
    T.StructField("timestamp", T.StringType()),
    T.StructField("pipeline", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("success", T.BooleanType()),
    T.StructField("error", T.StringType()),
    T.StructField("total_attempts", T.LongType()),
])


def observed_write(df: DataFrame, path: str, metrics: Mapping[str, Column], *,
                   file_format: str = "parquet", mode: str = "overwrite",
                   partition_by: Sequence[str] = ()) -> dict:
    """Write and return aggregates computed during that same write."""
    seen = Observation()
    watched = df.observe(seen, *[c.alias(n) for n, c in metrics.items()])
    writer = watched.write.mode(mode).format(file_format)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return seen.get


def counted_write(df: DataFrame, path: str, **options) -> int:
    """Write and return the number of rows written, without a second scan."""
    return observed_write(df, path, {"rows": F.count(F.lit(1))}, **options)["rows"]


def save_clean(df: DataFrame, table: str, file_format: str = "parquet") -> int:
    """Replace a catalog table; rows written."""
    seen = Observation()
    (df.observe(seen, F.count(F.lit(1)).alias("rows"))
     .write.mode("overwrite").format(file_format).saveAsTable(table))
    return seen.get["rows"]


def replace_folder(spark: SparkSession, source: str, target: str) -> None:
    """Move a finished folder into place; the old one is kept until that worked.

    On file systems a move is a rename.  Object stores copy instead, so there a
    table format with its own commits is the better target.
    """
    path_class = spark._jvm.org.apache.hadoop.fs.Path
    src, dst = path_class(source), path_class(target)
    old = path_class(f"{target.rstrip('/')}__old_{uuid.uuid4().hex}")
    fs = dst.getFileSystem(spark._jsc.hadoopConfiguration())
    replaced = fs.exists(dst)
    if replaced and not fs.rename(dst, old):
        raise OSError(f"Could not move {target} aside")
    if not fs.rename(src, dst):
        if replaced:
            fs.rename(old, dst)
        raise OSError(f"Could not move {source} to {target}")
    if replaced:
        fs.delete(old, True)


def drop_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def save_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def load_report(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def save_checks(spark: SparkSession, checks: Sequence[Check], path: str) -> None:
    checks_frame(spark, checks).coalesce(1).write.mode("overwrite").json(path)


def load_checks(spark: SparkSession, path: str) -> list[Check]:
    return checks_from_frame(spark.read.schema(CHECK_SCHEMA).json(path))


def cached_checks(spark: SparkSession, contract: TableContract, folder: str,
                  output_table: str | None = None) -> list[Check]:
    """The stored checks of an output table, generated and stored on first use."""
    table = output_table or contract.output_table or contract.name
    path = f"{folder.rstrip('/')}/{table}_checks"
    if path_exists(spark, path):
        return load_checks(spark, path)
    checks = generate_checks(contract, table)
    save_checks(spark, checks, path)
    return checks


def attempt_rows(df: DataFrame, max_error_length: int | None = None) -> DataFrame:
    """Attempts in log layout; errors are kept whole unless a length is given."""
    error = F.col("error") if max_error_length is None else F.substring("error", 1, max_error_length)
    return df.select(
        F.col("timestamp").cast("string").alias("timestamp"), "pipeline", "type", "success",
        error.alias("error"),
        F.col("total_attempts").cast("bigint").alias("total_attempts"))


def append_attempts(df: DataFrame, path: str, max_error_length: int | None = None) -> None:
    attempt_rows(df, max_error_length).write.mode("append").json(path)


def read_attempts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ATTEMPT_SCHEMA).json(path)
