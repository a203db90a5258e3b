"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through regions and racks to a shard.  On every
level each child draws ``-ln(u) / weight`` with ``u`` from a hash of the row's
key and the child's name, and the least draw wins.  A draw depends on nothing
but the key, the child and the child's weight, so a changed weight moves rows
only into or out of that child, and below a child nothing changes that was not
changed there: movement is confined to the subtrees whose weights change.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepact.llm.common import columns, partitions, table


@dataclass(frozen=True)
class Node:
    """A region, rack or shard; ``shard`` is set on leaves only."""

    name: str
    weight: float = 1.0
    children: tuple["Node", ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return sum(c.total for c in self.children) if self.children else self.weight


#: Racks of a region and shards of a rack in the default layout.
RACKS, SHARDS = 2, 2


def layout(shards: int, racks: int = RACKS, per_rack: int = SHARDS) -> Node:
    """A tree of equal shards: racks of ``per_rack``, regions of ``racks``, filled in order.

    A shard beyond full regions opens a region of its own, so only that region
    gains weight and takes rows.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    regions = []
    for first in range(0, shards, racks * per_rack):
        here = range(first, min(shards, first + racks * per_rack))
        regions.append(Node(f"region{len(regions)}", children=tuple(
            Node(f"rack{start}", children=tuple(
                Node(f"shard{s}", shard=s) for s in here if start <= s < start + per_rack))
            for start in range(here.start, here.stop, per_rack))))
    return Node("root", children=tuple(regions))


def _draw(key: Column, node: Node) -> Column:
    """Exponential with the node's weight as rate; 53 bits of the hash, never 0 or 1."""
    if node.total <= 0:
        return F.lit(math.inf)
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double")
    return -F.log((bits + 0.5) * F.lit(2.0 ** -53)) / F.lit(float(node.total))


def shard_of(key: Column, tree: Node) -> Column:
    """The shard a key falls to: one least draw for each level on the way down."""
    if tree.shard is not None:
        return F.lit(tree.shard)
    below = [shard_of(key, c) for c in tree.children]
    if len(below) == 1:
        return below[0]
    draws = F.array(*[_draw(key, c) for c in tree.children])
    chosen = F.array_position(draws, F.array_min(draws))
    return reduce(lambda rest, i: F.when(chosen == i + 1, below[i]).otherwise(rest),
                  range(len(below) - 1), below[-1])


def with_shard(df: DataFrame, key: Sequence[str], tree: Node, name: str = "shard") -> DataFrame:
    """Add the shard of each row.

    Nulls are keys like any other value (all rows with a null key share a
    shard), equal keys share a shard, and an empty table stays empty.
    """
    packed = F.to_json(F.struct(*[F.col(f"`{k}`").cast("string").alias(k) for k in key]),
                       {"ignoreNullFields": "false"})
    return df.withColumn(name, shard_of(packed, tree).cast("int"))


def with_slots(df: DataFrame, group: str, spread: Sequence[str], order: Sequence[str],
               parts: int | None = None, name: str = "slot") -> DataFrame:
    """Number the rows of each group from 0 without gaps.

    A group may hold most of the rows, so it is spread over buckets by a hash of
    ``spread``; rows are numbered inside a bucket, and every bucket starts where
    the buckets before it end.
    """
    parts = parts or partitions(df.sparkSession)
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(*spread), F.lit(parts)).cast("int"))
    sizes = bucketed.groupBy(group, "_bucket").agg(F.count("*").alias("_size"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_bucket", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy(group, "_bucket").orderBy(*order)
    numbered = bucketed.withColumn("_row", F.row_number().over(inside))
    return (numbered.join(starts, [group, "_bucket"])
            .withColumn(name, (F.col("_start") + F.col("_row") - 1).cast("long"))
            .drop("_bucket", "_start", "_row"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of a tree of two regions of two racks.

    ``grown_shard`` is the shard after a ninth one was added in a new region.
    A null text has size 1 and the crc of no bytes.  Only ids, sizes and
    checksums are shuffled, never texts.
    """
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    thin = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"))
    placed = with_shard(with_shard(thin, ["doc_id"], layout(8)), ["doc_id"], layout(9), "grown_shard")
    keys = ["doc_id", "size", "text_crc32"]
    out = with_slots(placed, "shard", keys, keys)
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
