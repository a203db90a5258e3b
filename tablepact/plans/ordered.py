"""Running values over a whole ordered table, without one task seeing it all.

A window without a partition key, or with one key that holds most of the rows,
would run in a single task.  Here the table is range-partitioned by its order,
each range is reduced to a few rows, those are accumulated, and every row adds
what came before its range to what came before it inside the range.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage.

    The cluster names it in ``spark.checkpoint.dir``.  Only in local mode, where
    executors and driver share one disk, is a temporary folder used instead.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(named)
        return named
    current = context.getCheckpointDir()
    if current is not None:
        return current
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("Set spark.checkpoint.dir to a folder all executors can reach")
    folder = tempfile.mkdtemp(prefix="tablepact-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def with_ranges(df: DataFrame, order_by: Sequence[str], ranges: int | None = None,
                name: str = "_range") -> DataFrame:
    """Number consecutive ranges of the order, so that later ranges come later.

    Range limits are sampled, so the result is written out once: every later use
    sees the same limits, also when an executor is lost.  The order columns
    should identify a row; equal ones always share a range.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    # As many ranges as the input has partitions at least, so that they do not grow with it.
    count = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.rdd.getNumPartitions())
    ranged = df.repartitionByRange(count, *order_by).withColumn(name, F.spark_partition_id())
    return ranged.checkpoint()


def with_earlier(ranged: DataFrame, keys: Sequence[str], partials: dict[str, Column],
                 totals: dict[str, Column], name: str = "_range") -> DataFrame:
    """One row per range and key: its own ``partials`` and the ``totals`` of all
    earlier ranges of that key.

    ``partials`` are aggregates over rows, ``totals`` are aggregates over the
    partials.  The windows see one row per range.
    """
    reduced = ranged.groupBy(name, *keys).agg(*[c.alias(n) for n, c in partials.items()])
    earlier = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    return reduced.select("*", *[c.over(earlier).alias(n) for n, c in totals.items()])


def range_window(keys: Sequence[str], order_by: Sequence[str], name: str = "_range"):
    """Window over one key inside one range, in order."""
    return Window.partitionBy(name, *keys).orderBy(*order_by)
