"""Integer vectors: a stated set of query rows against all rows, in tiles.

Every row with a usable vector gets a number of its own when the vectors are
written once to the shared folder.  Queries are dealt into groups that fit a
task's memory and candidates into groups of their own; one task works on one
pair of groups, keeps its queries and reads its candidates block by block.  What
a task hands on is bounded by its queries, never by its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.llm.common import partitions

#: Components are multiplied by this before they are rounded down.
SCALE = 256.0
#: Vector components of the queries one task keeps.
QUERY_VALUES = 1 << 22
#: Rows of either side that are multiplied at once.
BLOCK_ROWS = 2048
#: Candidates of a tile, once there are tiles enough for all tasks.
TILE_ROWS = 1 << 20

_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(vector: Column) -> Column:
    """A vector without null components whose scaled components are all finite."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(
        F.abs(x.cast("double") * SCALE) < float("inf"), F.lit(False))), F.lit(False))


def scaled(vectors: pa.Array, dims: int) -> np.ndarray:
    """``floor(256 * x)`` of every component; short vectors are filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    values = np.floor(SCALE * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
    if len(lengths) and (lengths == dims).all():
        return values.reshape(len(lengths), dims)
    out = np.zeros((len(lengths), dims))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with all rows of ``b``.

    In single or double precision while every sum is a whole number those hold,
    otherwise in Python's integers.
    """
    bound = a.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.float64)
    if bound < 1 << 53:
        return a @ b.T
    whole = np.frompyfunc(int, 1, 1)
    return whole(a) @ whole(b).T


def as_longs(scores: np.ndarray) -> np.ndarray:
    """Scores as 64-bit integers; larger ones are held at the ends of the range."""
    if scores.dtype == object:
        return np.array([min(max(int(s), _LEAST), _MOST) for s in scores.ravel()], np.int64).reshape(scores.shape)
    return scores.astype(np.int64)


@dataclass
class Block:
    """Rows of one side: numbers, ids, scaled vectors and other columns."""

    uid: np.ndarray
    id: np.ndarray
    no_id: np.ndarray
    x: np.ndarray
    rest: pa.RecordBatch

    @classmethod
    def of(cls, batch: pa.RecordBatch, dims: int) -> "Block":
        ids = batch.column("id")
        return cls(batch.column("uid").to_numpy(), pc.fill_null(ids, 0).to_numpy(zero_copy_only=False),
                   pc.is_null(ids).to_numpy(zero_copy_only=False), scaled(batch.column("vector"), dims), batch)

    def __len__(self) -> int:
        return len(self.uid)

    def rows(self, which: np.ndarray) -> "Block":
        return Block(self.uid[which], self.id[which], self.no_id[which], self.x[which],
                     self.rest.take(pa.array(which)))

    def parts(self, rows: int) -> Iterator[tuple[np.ndarray, "Block"]]:
        """Blocks of bounded size; rows whose products leave double precision stand apart."""
        narrow = np.abs(self.x).max(axis=1, initial=0) <= isqrt((1 << 53) // (self.x.shape[1] + 1))
        for which in (np.flatnonzero(narrow), np.flatnonzero(~narrow)):
            for start in range(0, len(which), rows):
                yield (part := which[start:start + rows]), self.rows(part)


class Best:
    """The first ``k`` entries of every query by score, then id, then row number."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query, self.score, self.id, self.uid = (np.zeros(0, np.int64) for _ in range(4))
        self.no_id = np.zeros(0, bool)
        self.least = np.full(queries, _LEAST, np.int64)  # scores below this cannot be among the first k

    def add(self, query: np.ndarray, score: np.ndarray, block: Block, row: np.ndarray) -> None:
        """Entries of rows met for the first time; each pair of a query and a row once."""
        if not len(query):
            return
        query = np.concatenate([self.query, query])
        score = np.concatenate([self.score, score])
        ids = np.concatenate([self.id, block.id[row]])
        no_id = np.concatenate([self.no_id, block.no_id[row]])
        uid = np.concatenate([self.uid, block.uid[row]])
        # ~score turns the order round without leaving 64 bits.
        order = np.lexsort((uid, ids, no_id, ~score, query))
        sorted_query = query[order]
        new = np.concatenate([[True], sorted_query[1:] != sorted_query[:-1]])
        begin = np.flatnonzero(new)[np.cumsum(new) - 1]
        place = np.arange(len(order)) - begin
        keep = order[place < self.k]
        self.query, self.score, self.id, self.no_id, self.uid = query[keep], score[keep], ids[keep], no_id[keep], uid[keep]
        last = order[place == self.k - 1]
        self.least[query[last]] = score[last]

    def batch(self, names: dict[str, np.ndarray | pa.Array]) -> pa.RecordBatch:
        """Row number, id and score of the entries beside the given columns."""
        ids = pa.array(self.id, mask=self.no_id)
        return pa.RecordBatch.from_pydict({**names, "uid": self.uid, "id": ids, "score": self.score})


def tiled(queries: DataFrame, candidates: DataFrame, n_queries: int, n_candidates: int, dims: int) -> DataFrame:
    """All pairs of groups, one partition each: the queries first (``side`` 0), then the candidates.

    Both tables need ``uid``, ``id`` and ``vector``; a column only one of them has is null in the other's rows.
    """
    query_groups = max(1, -(-n_queries * dims // QUERY_VALUES))
    wanted = min(partitions(queries.sparkSession), -(-n_candidates // BLOCK_ROWS)) // query_groups
    groups = max(1, wanted, -(-n_candidates // TILE_ROWS))

    def dealt(df: DataFrame, side: int, own: Column, others: int, tile) -> DataFrame:
        return (df.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
                .withColumn("_tile", tile.cast("int")).withColumn("side", F.lit(side)).drop("_own", "_other"))

    def group(n: int) -> Column:
        return F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")

    both = dealt(queries, 0, group(query_groups), groups, F.col("_own") * groups + F.col("_other")).unionByName(
        dealt(candidates, 1, group(groups), query_groups, F.col("_other") * groups + F.col("_own")),
        allowMissingColumns=True)
    return both.repartitionById(query_groups * groups, F.col("_tile")).sortWithinPartitions("side").drop("_tile")


def sides(batches: Iterator[pa.RecordBatch]) -> tuple[pa.RecordBatch | None, Iterator[pa.RecordBatch]]:
    """The queries of a tile as one batch, and its candidates batch by batch."""
    kept, first = [], None
    for batch in batches:
        n = int((batch.column("side").to_numpy() == 0).sum())
        if n:
            kept.append(batch.slice(0, n))
        if n < batch.num_rows:
            first = batch.slice(n)
            break
    if not kept:
        return None, iter(())
    whole = pa.Table.from_batches(kept).combine_chunks().to_batches()[0]

    def rest() -> Iterator[pa.RecordBatch]:
        if first is not None:
            yield first
            yield from batches
    return whole, rest()


def pieces(batches: Iterator[pa.RecordBatch], rows: int = BLOCK_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
