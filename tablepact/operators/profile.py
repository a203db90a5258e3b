"""Profiling: type inference, null counts, quality report, ad-hoc counters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablepact.contract import TableContract
from tablepact.functions import predicates as P
from tablepact.functions.text import quoted
from tablepact.plans.shapes import measure_rows, row_digest


def flags_type(flags: Column) -> Column:
    """Aggregate over ``predicates.type_flags``: the first of integer, float,
    date, json that fits all values.

    No values at all give ``unknown``; only empty text gives ``integer``,
    because every test holds vacuously.
    """
    common = F.bit_and(flags)
    out = F.when(common.isNull(), F.lit("unknown"))
    for flag, name in ((P.INTEGER_FLAG, "integer"), (P.FLOAT_FLAG, "float"), (P.DATE_FLAG, "date"),
                       (P.JSON_FLAG, "json")):
        out = out.when(common.bitwiseAND(F.lit(flag)) != 0, F.lit(name))
    return out.otherwise(F.lit("string"))


def inferred_type(c: Column, with_json: bool = True) -> Column:
    """Aggregate: the type of one text column."""
    return flags_type(P.type_flags(c, with_json))


def _text(name: str) -> Column:
    return F.col(quoted(name)).cast("string")


def infer_types(df: DataFrame, with_json: bool = True) -> DataFrame:
    """Type of every column over all rows of ``df``, in one aggregation."""
    # The flags are a projection of their own: it compiles, and the aggregate
    # above it stays a row of small integers.
    flagged = df.select(*[P.type_flags(_text(n), with_json).alias(f"_f{i}")
                          for i, n in enumerate(df.columns)])
    return measure_rows(flagged, [
        {"position": i, "column": n, "type": flags_type(F.col(f"_f{i}"))}
        for i, n in enumerate(df.columns)])


def infer_schema(df: DataFrame, sample_size: int | None = None,
                 order_by: Sequence[str | Column] = (), with_json: bool = True,
                 sample_values: int = 5) -> DataFrame:
    """One row per column: type, null count and share, nullability, samples.

    Types, null counts and sample values cover the whole table; the samples are
    the first filled values in ``order_by`` order (any without an order).  With
    ``sample_size`` types and samples come from the first so many rows only.
    """
    names = list(enumerate(df.columns))
    blanks = [P.is_blank(_text(n)).alias(f"_b{i}") for i, n in names]
    flags = [P.type_flags(_text(n), with_json).alias(f"_f{i}") for i, n in names]
    from_all_rows = sample_size is None
    marked = df.select(*blanks, *(flags if from_all_rows else []))
    whole = measure_rows(marked, [
        {"position": i, "column": n, "row_count": F.count(F.lit(1)),
         "null_count": F.count_if(F.col(f"_b{i}")),
         **({"type": flags_type(F.col(f"_f{i}"))} if from_all_rows else {})}
        for i, n in names])

    if from_all_rows:
        sampled = _first_filled(df, order_by, sample_values)
        return _profile_rows(whole, sampled)
    head = df.orderBy(*order_by) if order_by else df
    # After the limit the rows are few and in order; the id keeps that order.
    head = head.limit(sample_size).select(
        F.monotonically_increasing_id().alias("_i"),
        *[_text(n).alias(f"_v{i}") for i, n in names], *flags)

    def first_values(i: int) -> Column:
        value = F.col(f"_v{i}")
        held = F.collect_list(F.when(value.isNotNull(), F.struct("_i", value.alias("v"))))
        return F.slice(F.transform(F.array_sort(held), lambda x: x["v"]), 1, sample_values)

    sampled = measure_rows(head, [
        {"column": n, "sample_values": first_values(i), "type": flags_type(F.col(f"_f{i}"))}
        for i, n in names])
    return _profile_rows(whole, sampled)


def _first_filled(df: DataFrame, order_by: Sequence[str | Column], n: int) -> DataFrame:
    """The first filled values of every column.

    Each column is read on its own, beside the columns of the order: with an order
    a task keeps its first ``n`` values only, and without one it stops after ``n``.
    Nothing is sorted, and ``n`` rows per task and column are moved.
    """
    order = [F.col(quoted(c)) if isinstance(c, str) else c for c in order_by]

    def first(name: str) -> DataFrame:
        filled = df.select(*[c.alias(f"_o{i}") for i, c in enumerate(order)], _text(name).alias("value")).where("value is not null")
        keys = [f"_o{i}" for i in range(len(order))]
        few = (filled.orderBy(*keys) if order else filled).limit(n)
        held = F.collect_list(F.struct(*keys, "value")) if order else F.collect_list("value")
        values = F.transform(F.array_sort(held), lambda x: x["value"]) if order else held
        return few.agg(F.lit(name).alias("column"), values.alias("sample_values"))

    return reduce(DataFrame.unionAll, map(first, df.columns))


def _profile_rows(whole: DataFrame, sampled: DataFrame) -> DataFrame:
    # Both sides have one row per column of the table.
    joined = whole.join(F.broadcast(sampled), "column", "left").withColumn(
        "sample_values", F.coalesce("sample_values", F.array().cast("array<string>")))
    share = F.when(F.col("row_count") > 0, F.col("null_count") / F.col("row_count")).otherwise(0.0)
    return joined.select(
        "position", "column", "type", "row_count", "null_count",
        share.alias("null_percentage"), (F.col("null_count") > 0).alias("nullable"),
        "sample_values")


def date_orders(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per text column, in which order its dates have day and month, from all its values.

    A first number above 12 is a day, and so is a second one; one aggregation
    counts both, and the values that could be read either way.  ``order`` is
    ``day_first`` or ``month_first`` if all evidence agrees, ``mixed`` if it does
    not, and ``unknown`` without any.
    """
    rows = []
    for i, name in enumerate(columns):
        first, second = P.date_parts(_text(name))
        rows.append({
            "position": i, "column": name, "day_first_values": F.count_if((first > 12) & (second <= 12)),
            "month_first_values": F.count_if((second > 12) & (first <= 12)),
            "undecidable_values": F.count_if((first <= 12) & (second <= 12) & (first != second))})
    day, month = F.col("day_first_values") > 0, F.col("month_first_values") > 0
    return measure_rows(df, rows).withColumn("order", F.when(day & month, "mixed").when(day, "day_first")
                                             .when(month, "month_first").otherwise("unknown"))


def with_date_orders(df: DataFrame, contract: TableContract) -> TableContract:
    """The contract with the order its text dates have in the table, where the table shows one.

    One row per date column comes back.  Without evidence, or with contradicting
    evidence, the contract's own order stays.
    """
    dates = [c.name for c in contract.columns
             if c.type == "date" and c.name in df.columns and isinstance(df.schema[c.name].dataType, T.StringType)]
    if not dates:
        return contract
    found = {r["column"]: r["order"] for r in date_orders(df, dates).collect()}
    known = {"day_first": True, "month_first": False}
    return replace(contract, columns=tuple(
        replace(c, day_first=known.get(found.get(c.name), c.day_first)) for c in contract.columns))


def _percentage(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 2)).otherwise(F.lit(0.0))


def _value_statistics(df: DataFrame, position: int, name: str) -> DataFrame:
    """Total, distinct and null count of one column from its value frequencies.

    Reads one column; repeated values combine before the shuffle.
    """
    frequency = df.groupBy(F.col(quoted(name)).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return frequency.agg(
        F.lit(position).alias("position"), F.lit(name).alias("column"),
        F.lit(df.schema[name].dataType.simpleString()).alias("type"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count("v").alias("distinct_count"),
        F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("null_count"),
        F.min("v").cast("string").alias("min_value"), F.max("v").cast("string").alias("max_value"))


def _distinct_digests(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """``position`` and ``distinct_count`` of every column, in one scan and one shuffle.

    Each filled cell becomes its column's number and 128 bits of digest; equal ones
    combine before the shuffle, which moves 20 bytes for each.
    """
    cells = F.array(*[F.when(F.col(quoted(n)).isNotNull(), F.struct(
        F.lit(i).alias("position"), row_digest(df, [n]).alias("d0"), row_digest(df, [n], 1).alias("d1")))
        for i, n in enumerate(names)])
    each = df.select(F.explode(cells).alias("_c")).where("_c is not null").select("_c.position", "_c.d0", "_c.d1")
    return each.distinct().groupBy("position").agg(F.count(F.lit(1)).alias("distinct_count"))


def quality_report(df: DataFrame, columns: Sequence[str] | None = None,
                   distinct: str = "exact") -> DataFrame:
    """Per column: type, total, distinct values, nulls and their share, min, max.

    ``exact``: each column is aggregated to its value frequencies on its own, so
    a columnar scan reads every column once and no row is expanded by the number
    of columns.  ``digest``: all columns in one aggregation, and their distinct
    values in one more, by 128 bits of digest: two scans however many columns
    there are, the choice for CSV and other row-oriented sources and for long
    text, which is not shuffled.  ``approx``: one aggregation over all columns
    without a shuffle of values.
    """
    chosen = list(columns or df.columns)
    if distinct == "exact":
        report = reduce(DataFrame.unionAll, [_value_statistics(df, i, n) for i, n in enumerate(chosen)])
        return report.withColumn("null_percentage", _percentage(F.col("null_count"), F.col("total")))
    if distinct not in ("approx", "digest"):
        raise ValueError(f"distinct must be 'exact', 'digest' or 'approx', not {distinct!r}")
    rows = []
    for i, n in enumerate(chosen):
        c = F.col(quoted(n))
        rows.append({
            "position": i, "column": n, "type": df.schema[n].dataType.simpleString(), "total": F.count(F.lit(1)),
            **({"distinct_count": F.approx_count_distinct(c)} if distinct == "approx" else {}),
            "null_count": F.count_if(c.isNull()),
            "min_value": F.min(c).cast("string"), "max_value": F.max(c).cast("string")})
    report = measure_rows(df, rows)
    if distinct == "digest":  # a row per column on either side
        report = report.join(F.broadcast(_distinct_digests(df, chosen)), "position", "left").withColumn(
            "distinct_count", F.coalesce("distinct_count", F.lit(0)))
    return report.select("position", "column", "type", "total", "distinct_count", "null_count", "min_value", "max_value",
                         _percentage(F.col("null_count"), F.col("total")).alias("null_percentage"))


def quality_issues(report: DataFrame) -> DataFrame:
    """Columns with nulls; more than half of the rows is high, else medium."""
    share = F.col("null_count") / F.col("total")
    return report.filter(F.col("null_count") > 0).select(
        F.lit("null_values").alias("type"), "column", F.col("null_count").alias("count"),
        F.when(share > 0.5, "high").otherwise("medium").alias("severity"))


def count_matching(df: DataFrame, conditions: Mapping[str, Column],
                   with_total: bool = False) -> DataFrame:
    """One row with one counter per condition, all in one pass."""
    aggregates = [F.count(F.lit(1)).alias("total_rows")] if with_total else []
    aggregates += [F.count_if(cond).alias(name) for name, cond in conditions.items()]
    return df.agg(*aggregates)


def blank_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return count_matching(df, {f"null_{n}": P.is_blank(F.col(quoted(n))) for n in columns},
                          with_total=True)


def value_histogram(df: DataFrame, column: str, where: Column | None = None) -> DataFrame:
    """Frequency of each value (with its type), most frequent first."""
    source = df if where is None else df.filter(where)
    c = F.col(quoted(column))
    return (source.groupBy(c.alias("value"))
            .agg(F.count(F.lit(1)).alias("value_count"))
            .withColumn("value_type", F.typeof("value"))
            .orderBy(F.desc("value_count"), "value"))


def numeric_profile(df: DataFrame, column: str, group_by: Sequence[str] = ()) -> DataFrame:
    c = F.col(quoted(column))
    return df.groupBy(*group_by).agg(
        F.min(c).alias(f"min_{column}"), F.max(c).alias(f"max_{column}"),
        F.avg(c).alias(f"avg_{column}"))


def order_counters(df: DataFrame, text: Sequence[str], amount: str, date: str) -> DataFrame:
    """Counters of an order-like staging table: blanks, negative amounts, date shape."""
    conditions = {f"blank_{n}": P.is_blank(F.col(quoted(n))) for n in text}
    conditions[f"negative_{amount}"] = P.is_negative_text(F.col(quoted(amount)))
    conditions[f"undashed_{date}"] = P.is_not_dashed_date(F.col(quoted(date)))
    return count_matching(df, conditions)
