"""Helpers shared by the text operators: tables, scratch folders, Arrow batches."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.plans.ordered import checkpoint_dir

#: Rows turned into Python objects at once.
SLICE_ROWS = 256
#: What a worker process keeps from task to task.
_KEPT: list[dict] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared area named by ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tablepact-{label}-{uuid.uuid4().hex}"


def written_to(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """Write to a new folder of the shared area; the table read back, and the folder."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back."""
    return written_to(df, label)[0]


def columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def free(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that the table has no column of, in whatever case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: Column) -> Column:
    """Rows whose crc32 of the id as text is a multiple of five; a null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[dict[str, list]]:
    """Python columns of a bounded number of rows at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield {name: part.column(i).to_pylist() for i, name in enumerate(part.schema.names)}


def kept() -> dict:
    """A table that lives as long as the worker process, or until an operator that does not need it begins."""
    _KEPT.append({})
    return _KEPT[-1]


def let_go() -> None:
    """Empty the tables that operators keep in this worker, and give free memory back to the system.

    Workers are shared by all operators of a session, next to an executor that
    needs its memory.
    """
    for held in _KEPT:
        held.clear()
    give_back()


def give_back() -> None:
    """Give free memory back to the system: Arrow and the C library hold on to what was freed."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
    """The same task on batches, in a worker that keeps nothing of other operators before and nothing behind it."""
    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        yield from run(batches)
        let_go()
    return tidied


def ordered_text(docs: DataFrame, n: int | None = None) -> DataFrame:
    """``doc_id`` and ``text`` ranged and sorted by id, null ids first, ties by text.

    The ranges follow one another in the order of their partition numbers.  Only
    these two columns are shuffled, once.
    """
    n = n or partitions(docs.sparkSession)
    return (columns(docs, "doc_id", "text")
            .select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
            .repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text"))
