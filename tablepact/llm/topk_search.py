"""Exact top-k search by inner product with a three-phase uniform threshold.

The components of a vector are dealt into a few lists; a pair's score is the sum
of its partial scores, one for each list.

1. Every list of every block gathers its ``k`` best partial scores for each
   query.  The whole scores of these entries give a cutoff for each query: the
   ``k``-th best of them, which no result can be below.
2. The cutoff goes out with the queries.  A row that reaches the cutoff reaches
   an equal share of it in one list at least, so each list collects the entries
   at or above that share, and no result is among the others.
3. The partial scores that are missing for the collected entries are added, and
   the ``k`` best of those that reach the cutoff are the result.

The lists of a block lie in one task, so that the third phase looks up what is
missing where it is; the shuffles move vectors once for each pair of groups and
``k`` entries for each query and group (see :mod:`tablepact.llm.vectors`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepact.llm.common import columns, table, written
from tablepact.llm.vectors import BLOCK_ROWS, SCALE, Best, Block, as_longs, pieces, product, sides, tiled, usable

#: Lists the components are dealt into.
LISTS = 2
#: Entries taken for their whole scores at once.
PAIRS = 1 << 18

_FOUND = "query_uid long, query_id long, uid long, id long, score long"


def partial_scores(c: np.ndarray, q: np.ndarray, lists: int) -> list[np.ndarray]:
    """Scores of all pairs, one matrix for each list of components."""
    edges = np.linspace(0, c.shape[1], min(lists, c.shape[1]) + 1).astype(int)
    return [product(c[:, a:b], q[:, a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def gathered(parts: list[np.ndarray], own: np.ndarray, k: int) -> np.ndarray:
    """Pairs among the ``k`` best of some list, as rows of (query, candidate), each once."""
    found = []
    for part in parts:
        part = part.copy()
        part[own] = -np.inf
        if len(part) <= k:
            rows = np.repeat(np.arange(len(part))[:, None], part.shape[1], axis=1)
        elif part.dtype == object:
            rows = np.argsort(part, axis=0, kind="stable")[-k:]
        else:
            rows = np.argpartition(part, len(part) - k, axis=0)[-k:]
        found.append(np.stack([np.repeat(np.arange(part.shape[1])[None], len(rows), axis=0), rows], axis=-1).reshape(-1, 2))
    pairs = np.unique(np.concatenate(found), axis=0)
    return pairs[~own[pairs[:, 1], pairs[:, 0]]]


def collected(parts: list[np.ndarray], own: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Pairs at or above the query's share of the cutoff in some list."""
    reached = np.zeros(own.shape, bool)
    for part in parts:
        reached |= part >= share[None, :]
    reached &= ~own
    rows, queries = np.nonzero(reached)
    return np.stack([queries, rows], axis=-1)


def _phase(tiles: DataFrame, k: int, dims: int, lists: int, last: bool) -> DataFrame:
    """The ``k`` best of each tile among gathered (or, at ``last``, collected) entries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rows, others = sides(batches)
        if own_rows is None:
            return
        queries = Block.of(own_rows, dims)
        best = Best(len(queries), k)
        # Without a cutoff there are fewer than k other rows (or scores held at the end), and every entry is needed.
        cutoff = [-(1 << 63) if c is None else c for c in own_rows.column("cutoff").to_pylist()] if last else []
        floor = np.array(cutoff, np.int64)
        parts_of_queries = list(queries.parts(BLOCK_ROWS))
        for piece in pieces(others):
            for _, block in Block.of(piece, dims).parts(BLOCK_ROWS):
                for which, part in parts_of_queries:
                    scores = partial_scores(block.x, part.x, lists)
                    own = block.uid[:, None] == part.uid[None, :]
                    if last:
                        share = np.array([-np.inf if cutoff[i] == -(1 << 63) else -(-cutoff[i] // len(scores)) for i in which],
                                         scores[0].dtype)
                        pairs = collected(scores, own, share)
                    else:
                        pairs = gathered(scores, own, k)
                    for start in range(0, len(pairs), PAIRS):
                        query, row = pairs[start:start + PAIRS].T
                        total = as_longs(sum(s[row, query] for s in scores))
                        query = which[query]
                        keep = total >= best.least[query]
                        if last:
                            keep &= total >= floor[query]
                        best.add(query[keep], total[keep], block, row[keep])
        ids = own_rows.column("id").take(pa.array(best.query))
        yield best.batch({"query_uid": queries.uid[best.query], "query_id": ids})

    return tiles.mapInArrow(run, _FOUND)


def best_of(found: DataFrame, by: list[str], k: int) -> DataFrame:
    """The first ``k`` entries of each group with their ``rank``; only ``k`` of a group leave a task."""
    order = Window.partitionBy(*by).orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(vectors: DataFrame, is_query, k: int = 5, lists: int = LISTS, id_column: str = "vec_id",
           vector_column: str = "embedding") -> DataFrame:
    """For every row that ``is_query`` (a function of the id column) holds for, its
    ``k`` best other rows: ``query_id, rank, vec_id, score``.

    Rows without a vector, or with a null or non-finite (scaled) component, take
    no part.  A null id is no query and comes last among equal scores; rows of
    the same id are told apart, each a query and a candidate of its own.  Vectors
    of different lengths meet as if filled up with zeros.  Scores beyond 64 bits
    are held at the ends of the range.  Fewer than ``k`` other rows are all
    returned; an empty table gives no rows; other columns are ignored.
    """
    rows = written(columns(vectors, id_column, vector_column).select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_column}`").cast("long").alias("id"),
        F.col(f"`{vector_column}`").alias("vector")).where(usable(F.col("vector"))), "vectors")
    query = F.coalesce(is_query(F.col("id")), F.lit(False))
    n, n_queries, dims = rows.agg(F.count("*"), F.count_if(query), F.max(F.size("vector"))).first()
    dims = max(1, dims or 1)
    queries = rows.where(query)

    first = _phase(tiled(queries, rows, n_queries, n, dims), k, dims, lists, False)
    cutoffs = written(best_of(first, ["query_uid"], k).where(F.col("rank") == k)
                      .select(F.col("query_uid").alias("uid"), F.col("score").alias("cutoff")), "cutoffs")
    # Phase one's scores are those of real rows: the k-th best of them is a lower bound of the k-th best of all.
    sent = queries.join(cutoffs, "uid", "left")
    found = _phase(tiled(sent, rows, n_queries, n, dims), k, dims, lists, True)
    return best_of(found, ["query_uid"], k).select(
        "query_id", "rank", F.col("id").alias("vec_id"), "score")


def op13_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best other rows of every row whose id is divisible by 50; see :func:`search`."""
    return search(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT q.uid, q.vec_id AS query_id, c.vec_id, c.uid AS other,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM rows q JOIN rows c ON q.uid <> c.uid
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST, other) AS rank FROM scored)
WHERE rank <= 5
"""
