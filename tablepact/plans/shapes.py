"""Reusable plan shapes.

* many measures in one aggregation, then turned into rows;
* the k smallest values per group without collecting the group;
* comparing two tables as multisets in one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablepact.functions.text import quoted, sql_literal


@dataclass(frozen=True)
class Label:
    """A constant of a measured row, as SQL text."""

    sql: str


NULL_TEXT = Label("CAST(NULL AS STRING)")
NULL_COUNT = Label("CAST(NULL AS BIGINT)")


def measure_rows(df: DataFrame, rows: Sequence[dict[str, Column | object]],
                 group_by: Sequence[str] = ()) -> DataFrame:
    """Evaluate many measures in one pass and return one row per entry.

    Every entry maps output names to an aggregate ``Column`` (evaluated over
    ``df``), a plain value or a ``Label``.  The whole list becomes a single
    partial/final aggregation, unpivoted by ``inline``; the table is read once
    however many measures there are.
    """
    aggregates, structs = [], []
    for row in rows:
        fields = []
        for name, value in row.items():
            if isinstance(value, Column):
                slot = f"_m{len(aggregates)}"
                aggregates.append(value.alias(slot))
                text = slot
            else:
                text = value.sql if isinstance(value, Label) else sql_literal(value)
            fields.append(f"{sql_literal(name)}, {text}")
        structs.append(f"named_struct({', '.join(fields)})")
    if not aggregates and not group_by:
        folded = df.sparkSession.range(0, 1, 1, 1)
    elif group_by:
        folded = df.groupBy(*group_by).agg(*aggregates)
    else:
        folded = df.agg(*aggregates)
    # One expression text: a contract of n columns costs one call, not dozens per row.
    return folded.select(*group_by, F.expr(f"inline(array({', '.join(structs)}))"))


def smallest_values(df: DataFrame, keys: Sequence[str], value: str, k: int,
                    out: str = "sample_values") -> DataFrame:
    """Per group the ``k`` smallest distinct values as a sorted array.

    Duplicates collapse map-side, the rank filter is pushed below the shuffle
    as a per-task limit, and only ``k`` values per group reach the collect.
    """
    return _smallest(df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        F.count(F.lit(1)).alias("_n")), keys, value, k, out)


def _smallest(frequencies: DataFrame, keys, value, k, out) -> DataFrame:
    order = F.col(value).asc_nulls_last()
    top = frequencies.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*keys).orderBy(order))).filter(F.col("_rank") <= k)
    held = F.collect_list(F.when(F.col(value).isNotNull(), F.struct(value, "_n")))
    return top.groupBy(*keys).agg(
        F.transform(F.array_sort(held), lambda x: x[value]).alias(out))


def count_with_samples(df: DataFrame, keys: Sequence[str], value: str, k: int,
                       count: str = "row_count", out: str = "sample_values") -> DataFrame:
    """Row count and ``k`` smallest distinct values per group.

    Both come from the same value frequencies, whose shuffle Spark runs once, so
    ``df`` is evaluated once.  Groups are few; their values may be many.
    """
    frequencies = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    counts = frequencies.groupBy(*keys).agg(F.sum("_n").alias(count))
    return counts.join(_smallest(frequencies, keys, value, k, out), list(keys))


def row_digest(df: DataFrame, names: Sequence[str], seed: int = 0) -> Column:
    """64 bits of a row's values; nulls count by their place, and both zeros are one value."""
    columns = [F.col(quoted(n)) for n in names]
    plain = [c + F.lit(0.0).cast(df.schema[n].dataType) if df.schema[n].dataType.typeName() in ("float", "double") else c
             for c, n in zip(columns, names, strict=True)]
    return F.xxhash64(F.lit(seed), *plain, *[c.isNull() for c in columns])


def bucket_sums(df: DataFrame, buckets: int) -> DataFrame:
    """Per bucket of rows their number and the sums of two digests: equal for equal multisets, whatever the order.

    A row of five numbers per bucket and task is shuffled, however many rows there are.
    """
    low = F.lit(0xFFFFFFFF)
    halves = {}
    for i, digest in enumerate([row_digest(df, df.columns), row_digest(df, df.columns, 1)]):
        halves |= {f"low{i}": digest.bitwiseAND(low), f"high{i}": F.shiftrightunsigned(digest, 32)}
    digested = df.select(F.pmod(row_digest(df, df.columns), F.lit(buckets)).cast("int").alias("bucket"),
                         *[c.alias(n) for n, c in halves.items()])
    return digested.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), *[F.sum(n).alias(n) for n in halves])


#: Buckets whose digests are compared first; at most this many numbers are broadcast.
DIGEST_BUCKETS = 1 << 16


def multiset_difference(left: DataFrame, right: DataFrame, buckets: int = 0) -> DataFrame:
    """Rows whose multiplicity differs, with ``left_count`` and ``right_count``.

    One shuffle with map-side combine instead of two ``exceptAll`` passes.  With
    ``buckets``, sums of digests are compared first, and only rows in buckets that
    differ are shuffled: of equal tables none.  Both tables are then read a second
    time where they differ.
    """
    right = right.select(*[F.col(quoted(c)) for c in left.columns])
    if buckets:
        a, b = bucket_sums(left, buckets), bucket_sums(right, buckets)
        sums = [c for c in a.columns if c != "bucket"]
        both = a.alias("a").join(b.alias("b"), "bucket", "full_outer")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in sums]
        differing = F.broadcast(both.where(~reduce(Column.__and__, same)).select(F.col("bucket").alias("_bucket")))

        def open_rows(df: DataFrame) -> DataFrame:
            bucket = F.pmod(row_digest(df, df.columns), F.lit(buckets)).cast("int")
            return df.withColumn("_bucket", bucket).join(differing, "_bucket", "left_semi").drop("_bucket")

        left, right = open_rows(left), open_rows(right)
    columns = [F.col(quoted(c)) for c in left.columns]
    tagged = (left.select(*columns, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
              .unionAll(right.select(*columns, F.lit(0).alias("_l"), F.lit(1).alias("_r"))))
    return (tagged.groupBy(*columns)
            .agg(F.sum("_l").alias("left_count"), F.sum("_r").alias("right_count"))
            .filter(F.col("left_count") != F.col("right_count")))


def differing_digests(left: DataFrame, right: DataFrame) -> DataFrame:
    """One row for each different row whose multiplicity differs: its 128-bit digest, and how many more ``left`` has.

    Each table is read once, and two digests and a count are shuffled for a row,
    however long it is and however many rows differ.
    """
    columns = [F.col(quoted(c)) for c in left.columns]
    tagged = left.select(*columns, F.lit(1).alias("_more")).unionAll(right.select(*columns, F.lit(-1).alias("_more")))
    digests = [row_digest(tagged, left.columns, seed).alias(f"_d{seed}") for seed in range(2)]
    return (tagged.select(*digests, "_more").groupBy("_d0", "_d1").agg(F.sum("_more").alias("_more"))
            .where(F.col("_more") != 0))


#: Words of the filter of repeated digests (64 bits each), which is broadcast whole.
FILTER_WORDS = 1 << 19


def repeated_only(df: DataFrame, names: Sequence[str], words: int = FILTER_WORDS) -> DataFrame:
    """Rows whose values may occur more than once, and all rows whose values do.

    Rows are counted by 128 bits of digest.  The digests that repeat set three
    bits each in one word of a filter of fixed size, and where the rows are read
    again, those whose bits are not set are dropped.  However many digests repeat,
    the filter does not grow; it only lets more of the other rows through.
    """
    first, second = row_digest(df, names), row_digest(df, names, 1)
    digests = df.select(first.alias("_d0"), second.alias("_d1"))
    repeated = digests.groupBy("_d0", "_d1").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")

    def word(d0: Column) -> Column:
        return F.pmod(d0, F.lit(words)).cast("int")

    def bits(d1: Column) -> Column:
        places = [F.shiftrightunsigned(d1, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(3)]
        return reduce(Column.bitwiseOR, [F.call_function("shiftleft", F.lit(1).cast("long"), p) for p in places])

    filled = repeated.groupBy(word(F.col("_d0")).alias("_word")).agg(F.bit_or(bits(F.col("_d1"))).alias("_set"))
    marked = df.withColumns({"_word": word(first), "_bits": bits(second)}).join(F.broadcast(filled), "_word")
    return marked.where(F.col("_set").bitwiseAND(F.col("_bits")) == F.col("_bits")).select(
        *[F.col(quoted(c)) for c in df.columns])


def status_when(condition: Column, yes: str = "FAIL", no: str = "PASS") -> Column:
    return F.when(condition, F.lit(yes)).otherwise(F.lit(no))
