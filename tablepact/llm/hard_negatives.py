"""Hard negatives by segment summaries.

A vector is cut into segments, and the mean and the deviation of each are stored
beside it.  Over a segment of ``L`` components the product of two vectors is
``L`` times the product of their means, plus or minus at most ``L`` times the
product of their deviations, so the summaries bound every score from both sides.
Pairs whose bounds already leave the scores asked for are dropped with the few
wide segments, the rest with the narrow ones these are made of, and what is left
is scored exactly.

Two searches use this: the best rows of the same label (the positives), and for
each positive the best rows of other labels whose scores lie in a share of the
positive's.  Both keep a bounded number of rows for each anchor in each tile
(see :mod:`tablepact.llm.vectors`).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import table, written
from tablepact.llm.topk_search import best_of
from tablepact.llm.vectors import BLOCK_ROWS, SCALE, Best, Block, as_longs, pieces, product, scaled, sides, tiled, usable

#: Segments of each level; every level's segments are made of the next one's.
LEVELS = (2, 8)
#: Below this share of pairs left, they are looked at one by one instead of as matrices.
SPARSE = 1 / 16
#: Pairs looked at one by one together.
PAIRS = 1 << 16

_WIDEST = 1 << 62


def edges(dims: int, segments: int) -> np.ndarray:
    return np.linspace(0, dims, min(segments, dims) + 1).astype(int)


def summary(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of each segment of each row."""
    at = edges(x.shape[1], segments)
    size = np.diff(at)
    mean = np.add.reduceat(x, at[:-1], axis=1) / size
    spread = x - np.repeat(mean, size, axis=1)
    return mean, np.sqrt(np.add.reduceat(spread * spread, at[:-1], axis=1) / size)


def coarser(mean: np.ndarray, deviation: np.ndarray, size: np.ndarray, segments: int):
    """Summary and sizes of fewer segments from those of the segments they are made of."""
    at = edges(len(size), segments)[:-1]
    total = np.add.reduceat(size, at)
    wide = np.add.reduceat(mean * size, at, axis=1) / total
    square = np.add.reduceat((deviation ** 2 + mean ** 2) * size, at, axis=1) / total
    return wide, np.sqrt(np.maximum(square - wide ** 2, 0)), total


@dataclass
class Summary:
    """Means and deviations of a block for each level, times the roots of the sizes."""

    levels: list[tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, batch: pa.RecordBatch, dims: int, levels: tuple[int, ...] = LEVELS) -> "Summary":
        finest = len(edges(dims, levels[-1])) - 1
        mean, deviation = (np.asarray(batch.column(c).flatten().to_numpy(zero_copy_only=False)).reshape(-1, finest)
                           for c in ("means", "deviations"))
        size = np.diff(edges(dims, levels[-1]))
        out = []
        for n in levels:
            m, d, s = (mean, deviation, size) if n >= finest else coarser(mean, deviation, size, n)
            out.append((m * np.sqrt(s), d * np.sqrt(s)))
        return cls(out)


def _between(middle: np.ndarray, reach: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether bounds meet the scores asked for, with room for rounding."""
    room = reach + 0.5 + 1e-9 * (np.abs(middle) + reach)
    return (middle + room >= low) & (middle - room <= high)


def survivors(c: Summary, q: Summary, wanted: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Pairs, as rows of (candidate, query), whose score may lie from ``low`` to ``high`` of the query.

    Starts with the pairs ``wanted`` and takes the levels from wide to narrow segments.
    """
    for (cm, cd), (qm, qd) in zip(c.levels, q.levels, strict=True):
        if wanted.sum() > SPARSE * wanted.size:
            wanted = wanted & _between(cm @ qm.T, cd @ qd.T, low[None, :], high[None, :])
            continue
        pairs = np.argwhere(wanted)
        wanted = np.zeros_like(wanted)
        for start in range(0, len(pairs), PAIRS):
            i, j = pairs[start:start + PAIRS].T
            keep = _between((cm[i] * qm[j]).sum(axis=1), (cd[i] * qd[j]).sum(axis=1), low[j], high[j])
            wanted[i[keep], j[keep]] = True
    return np.argwhere(wanted)


def exact(c: np.ndarray, q: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Scores of the given pairs: as a matrix where many are left, else pair by pair."""
    if len(pairs) > SPARSE * len(c) * len(q):
        return as_longs(product(c, q)[pairs[:, 0], pairs[:, 1]])
    out = np.zeros(len(pairs), np.int64)
    for start in range(0, len(pairs), PAIRS):
        i, j = pairs[start:start + PAIRS].T
        a, b = c[i], q[j]
        if c.shape[1] * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) < 1 << 53:
            out[start:start + PAIRS] = np.einsum("ij,ij->i", a, b).astype(np.int64)
        else:
            whole = np.frompyfunc(int, 1, 1)
            out[start:start + PAIRS] = as_longs((whole(a) * whole(b)).sum(axis=1))
    return out


def _positives(tiles: DataFrame, k: int, dims: int, levels: tuple[int, ...]) -> DataFrame:
    """The first ``k`` other rows of the anchor's label in each tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rows, others = sides(batches)
        if own_rows is None:
            return
        anchors = Block.of(own_rows, dims)
        parts = [(which, part, Summary.of(part.rest, dims, levels)) for which, part in anchors.parts(BLOCK_ROWS)]
        best = Best(len(anchors), k)
        for piece in pieces(others):
            for _, block in Block.of(piece, dims).parts(BLOCK_ROWS):
                known, label = Summary.of(block.rest, dims, levels), block.rest.column("label").to_numpy()
                for which, part, marks in parts:
                    wanted = label[:, None] == part.rest.column("label").to_numpy()[None, :]
                    wanted &= block.uid[:, None] != part.uid[None, :]
                    low = best.least[which].astype(float)
                    pairs = survivors(known, marks, wanted, low, np.full(len(which), np.inf))
                    score, query = exact(block.x, part.x, pairs), which[pairs[:, 1]]
                    keep = score >= best.least[query]
                    best.add(query[keep], score[keep], block, pairs[keep, 0])
        yield best.batch({"anchor_uid": anchors.uid[best.query]})

    return tiles.mapInArrow(run, "anchor_uid long, uid long, id long, score long")


def share_bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and the greatest ``n`` with ``low * score <= 100 * n <= high * score``."""
    return -(-low * score // 100), high * score // 100


def _negatives(tiles: DataFrame, k: int, low: int, high: int, dims: int, levels: tuple[int, ...]) -> DataFrame:
    """For each anchor and positive, the first ``k`` rows of other labels in its share, in each tile."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_rows, others = sides(batches)
        if own_rows is None:
            return
        anchors = Block.of(own_rows, dims)
        parts = [(which, part, Summary.of(part.rest, dims, levels)) for which, part in anchors.parts(BLOCK_ROWS)]
        # One search for each positive: which anchor it belongs to, and its share.
        positives = own_rows.column("positives").to_pylist()
        width = max((len(p) for p in positives), default=0)
        least = np.full((len(anchors), width), _WIDEST, np.int64)
        most = np.full((len(anchors), width), -_WIDEST, np.int64)
        for i, found in enumerate(positives):
            for j, p in enumerate(found):
                a, b = share_bounds(p["score"], low, high)
                least[i, j], most[i, j] = max(a, -_WIDEST), min(b, _WIDEST)
        best = Best(len(anchors) * width, k)
        for piece in pieces(others) if width else ():
            for _, block in Block.of(piece, dims).parts(BLOCK_ROWS):
                known, label = Summary.of(block.rest, dims, levels), block.rest.column("label").to_numpy()
                for which, part, marks in parts:
                    wanted = label[:, None] != part.rest.column("label").to_numpy()[None, :]
                    now = np.maximum(least, best.least.reshape(least.shape))[which]
                    cap = most[which]
                    open_ = now <= cap
                    lowest = np.where(open_, now, _WIDEST).min(axis=1).astype(float)
                    highest = np.where(open_, cap, -_WIDEST).max(axis=1).astype(float)
                    wanted &= open_.any(axis=1)[None, :]
                    pairs = survivors(known, marks, wanted, lowest, highest)
                    score = exact(block.x, part.x, pairs)
                    for j in range(width):
                        local = pairs[:, 1]
                        keep = np.flatnonzero((score >= now[local, j]) & (score <= cap[local, j]))
                        best.add(which[local[keep]] * width + j, score[keep], block, pairs[keep, 0])
        if len(best.query):
            anchor, place = np.divmod(best.query, width)
            yield best.batch({"anchor_uid": anchors.uid[anchor], "place": place})

    return tiles.mapInArrow(run, "anchor_uid long, place long, uid long, id long, score long")


def _stored(rows: DataFrame, dims: int, segments: int) -> DataFrame:
    """The rows with the summaries of their finest segments."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces([batch], 4 * BLOCK_ROWS):
                mean, deviation = summary(scaled(piece.column("vector"), dims), segments)
                named = {n: piece.column(n) for n in piece.schema.names}
                yield pa.RecordBatch.from_pydict(named | {"means": list(mean), "deviations": list(deviation)})

    return rows.mapInArrow(run, fields + ", means array<double>, deviations array<double>")


def mine(vectors: DataFrame, is_anchor, label: Column, positives: int = 5, negatives: int = 10, low: int = 30,
         high: int = 90, levels: tuple[int, ...] = LEVELS, id_column: str = "vec_id",
         vector_column: str = "embedding") -> DataFrame:
    """Hard negatives of every row that ``is_anchor`` (a function of the id column) holds for.

    An anchor's positives are its first ``positives`` other rows of its ``label``;
    for each, the first ``negatives`` rows of other labels are returned whose
    score lies from ``low`` to ``high`` percent of the positive's.  Higher scores
    come first, equal ones by id, then by row.

    Rows with a null label, without a vector, or with a null or non-finite
    (scaled) component take no part.  A null id is no anchor and comes last among
    equal scores; rows of the same id are told apart.  Vectors of different
    lengths meet as if filled up with zeros.  Scores beyond 64 bits are held at
    the ends of the range.  An anchor without positives, or a positive without
    rows in its share, gives no rows; so does an empty table.  Other columns are
    ignored, whatever their names.
    """
    rows = vectors.select(
        F.monotonically_increasing_id().alias("uid"), F.col(f"`{id_column}`").cast("long").alias("id"),
        label.cast("long").alias("label"), F.col(f"`{vector_column}`").alias("vector"))
    rows = rows.where(usable(F.col("vector")) & F.col("label").isNotNull())
    anchor = F.coalesce(is_anchor(F.col("id")), F.lit(False))
    n, n_anchors, dims = rows.agg(F.count("*"), F.count_if(anchor), F.max(F.size("vector"))).first()
    dims = max(1, dims or 1)
    rows = written(_stored(rows, dims, levels[-1]), "summaries")
    anchors = rows.where(anchor)

    found = best_of(_positives(tiled(anchors, rows, n_anchors, n, dims), positives, dims, levels), ["anchor_uid"], positives)
    positive = F.sort_array(F.collect_list(F.struct("rank", "id", "score")))  # a few for each anchor
    pairs = written(found.groupBy("anchor_uid").agg(positive.alias("positives")).withColumnRenamed("anchor_uid", "uid"),
                    "positives")
    named = anchors.join(pairs, "uid")
    tiles = tiled(named, rows, n_anchors, n, dims)
    best = best_of(_negatives(tiles, negatives, low, high, dims, levels), ["anchor_uid", "place"], negatives)
    chosen = F.get("positives", F.col("place").cast("int"))
    return (best.withColumnsRenamed({"id": "negative_id", "score": "negative_score", "uid": "_uid"})
            .join(named.select(F.col("uid").alias("anchor_uid"), F.col("id").alias("anchor_id"), "positives"), "anchor_uid")
            .select("anchor_id", chosen["id"].alias("positive_id"), "rank", "negative_id",
                    chosen["score"].alias("positive_score"), "negative_score"))


#: Some labels of the table are wrong: those of every seventh row.
def damaged_label() -> Column:
    label = F.col("label").cast("long")
    return F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten hard negatives for each of five positives of every row whose id is divisible by 100; see :func:`mine`."""
    return mine(table(spark, sf_dir, "embeddings"), lambda i: i % 100 == 0, damaged_label())


SQL = f"""
WITH rows AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0
), scored AS (
  SELECT a.uid, a.vec_id AS anchor_id, c.vec_id, c.uid AS other, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) AS BIGINT) AS score
  FROM rows a JOIN rows c ON a.uid <> c.uid
  WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY uid ORDER BY score DESC, vec_id NULLS LAST, other) <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM (
  SELECT p.anchor_id, p.vec_id AS positive_id, n.vec_id AS negative_id, p.score AS positive_score,
         n.score AS negative_score,
         row_number() OVER (PARTITION BY p.uid, p.other ORDER BY n.score DESC, n.vec_id NULLS LAST, n.other) AS rank
  FROM positives p JOIN scored n ON n.uid = p.uid AND NOT n.same
  WHERE 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
)
WHERE rank <= 10
"""
