"""Comparing an inferred schema with a contract."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.contract import TableContract
from tablepact.operators.profile import infer_schema


def _issue(kind: str, expected: Column | None = None, actual: Column | None = None,
           count: Column | None = None, percentage: Column | None = None) -> Column:
    def or_null(c, type_name):
        return F.lit(None).cast(type_name) if c is None else c.cast(type_name)

    return F.struct(
        F.lit(kind).alias("type"),
        or_null(expected, "string").alias("expected"),
        or_null(actual, "string").alias("actual"),
        F.lit("high").alias("severity"),
        or_null(count, "bigint").alias("count"),
        or_null(percentage, "double").alias("percentage"))


def compare_profile(profile: DataFrame, contract: TableContract, merged: bool = False) -> DataFrame:
    """Join a profile with the contract; one row per column of either side.

    ``status`` is match, mismatch, missing (contract only) or extra (source
    only).  Types are compared by name, so integer against float is a mismatch.
    ``merged=True`` gives one ``coalesce`` recommendation kind for both null
    issues instead of ``coalesce`` and ``fill_nulls``.
    """
    spark = profile.sparkSession
    expected = contract.as_frame(spark)
    source = profile.select(
        "column", F.col("type").alias("source_type"), F.col("nullable").alias("source_nullable"),
        "null_count", "null_percentage", "sample_values", F.col("position").alias("source_position"))
    both = source.join(expected, "column", "full_outer")
    in_source = F.col("source_position").isNotNull()
    in_contract = F.col("position").isNotNull()
    common = in_source & in_contract
    forbidden = common & ~F.col("expected_nullable")
    raw_issues = F.array(
        F.when(common & (F.col("source_type") != F.col("expected_type")),
               _issue("type_mismatch", F.col("expected_type"), F.col("source_type"))),
        F.when(forbidden & F.col("source_nullable"),
               _issue("nullability_mismatch", F.lit("NOT NULL"), F.lit("NULL allowed"),
                      F.col("null_count"))),
        F.when(forbidden & (F.col("null_count") > 0),
               _issue("null_values_found", count=F.col("null_count"),
                      percentage=F.col("null_percentage"))))
    issues = F.filter(raw_issues, lambda i: i.isNotNull())
    with_issues = both.withColumn("issues", issues)
    status = (F.when(~in_source, "missing").when(~in_contract, "extra")
              .when(F.size("issues") > 0, "mismatch").otherwise("match"))
    return with_issues.select(
        F.coalesce("position", F.lit(len(contract.columns)) + F.col("source_position")).alias("position"),
        "column", status.alias("status"), "source_type", "expected_type", "issues",
        _recommendations(contract, merged).alias("recommendations"), "sample_values")


def compare_schema(df: DataFrame, contract: TableContract, sample_size: int | None = None,
                   order_by: Sequence[str | Column] = (), merged: bool = False) -> DataFrame:
    """Profile a raw table and compare it with the contract."""
    return compare_profile(infer_schema(df, sample_size, order_by), contract, merged)


def _recommendations(contract: TableContract, merged: bool) -> Column:
    defaults = {c.name: json.dumps(c.default) for c in contract.columns if c.default is not None}
    pairs = [F.lit(x) for kv in defaults.items() for x in kv]
    default_code = F.element_at(F.create_map(*pairs), F.col("column")) if pairs else F.lit(None).cast("string")

    def recommend(issue: Column) -> Column:
        is_cast = issue["type"] == "type_mismatch"
        name = F.col("column")
        code = F.when(is_cast, F.format_string(
            "COALESCE(CAST(%s AS %s), %s)", name, F.upper(issue["expected"]),
            F.coalesce(default_code, F.lit("NULL")))).otherwise(
            F.format_string("COALESCE(%s, %s)", name, default_code))
        fill = F.lit("coalesce") if merged else F.when(
            issue["type"] == "nullability_mismatch", "coalesce").otherwise("fill_nulls")
        return F.when(is_cast | default_code.isNotNull(), F.struct(
            F.when(is_cast, "cast").otherwise(fill).alias("action"),
            F.when(is_cast, issue["actual"]).alias("from"),
            F.when(is_cast, issue["expected"]).alias("to"),
            default_code.alias("default"),
            F.when(~is_cast, issue["count"]).alias("count"),
            code.alias("code")))

    return F.filter(F.transform("issues", recommend), lambda r: r.isNotNull())


def explode_issues(comparison: DataFrame) -> DataFrame:
    """One row per column and issue."""
    return comparison.select("column", F.inline("issues"))


def explode_recommendations(comparison: DataFrame) -> DataFrame:
    return comparison.select("column", F.inline("recommendations"))


def missing_columns(profile: DataFrame, contract: TableContract) -> DataFrame:
    """Contract columns the source does not have."""
    return contract.as_frame(profile.sparkSession).join(
        profile.select("column"), "column", "left_anti").select("column")


def extra_columns(profile: DataFrame, contract: TableContract) -> DataFrame:
    """Source columns the contract does not name."""
    return profile.join(contract.as_frame(profile.sparkSession).select("column"),
                        "column", "left_anti").select("column")


def issues_by_column(comparison: DataFrame) -> dict[str, list[str]]:
    """Issue names per column for ``clean``; one row per column is collected."""
    rows = comparison.filter(F.size("issues") > 0).select(
        "column", F.transform("issues", lambda i: i["type"]).alias("types")).collect()
    return {r["column"]: list(r["types"]) for r in rows}
