"""Near-duplicates: a Jaccard join on word n-grams along chosen paths.

Texts with the same words are copies and are joined first.  Each different text
is embedded as a fixed number of minimum hashes of its set of word n-grams; two
texts agree on a share of them that estimates their Jaccard similarity.

The join follows paths.  In every run the root samples coordinates, and each
text goes to one child per coordinate, together with the texts that hold the
same token there, its minimum hash.  A child that is small enough is compared by
brute force.  A larger one is first compared with one of its texts, the leader,
and then splits again on sampled coordinates, where only texts that are not yet
known to belong together are of interest; where these are few, they are compared
with all texts of the child instead.  The deepest children are compared by
brute force whatever their size, in pairs of blocks.  Runs are repeated until
the chance to miss a pair at the threshold is below ``MISS``.

What is found are candidates for groups.  Inside each candidate group the exact
sets are compared, again in pairs of blocks, so the links of every text to all
others of its group are counted exactly, but never listed: only a spanning
forest of them leaves a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import SLICE_ROWS, columns, free, let_go, partitions, slices, table, tidy, written, written_to
from tablepact.sources.sinks import drop_folder

#: Words of an n-gram and the least similarity of a link.
WORDS = 5
THRESHOLD = 0.8
#: Minimum hashes of an embedding.
COORDINATES = 64
#: A node samples each coordinate with probability 1 / (RATE * COORDINATES).
RATE = 0.7
#: Chance to miss a pair at the threshold that ends the repetition of runs, and levels of the tree.
MISS = 1e-3
DEPTH = 4
#: Texts of a bucket compared by brute force, and of a block in the exact comparison.
LIMIT = 128
BLOCK = 256
#: Texts of a node that are looked at together where a few are compared with all.
PART = 4096
#: Standard deviations below the threshold from which an estimate is no candidate.
DEVIATIONS = 5.0
#: Rows of a table that is broadcast at most (about 40 bytes each); larger ones are shuffled.
BROADCAST_ROWS = 500_000
#: Pairs (some 100 bytes each) whose components one task finds.
FEW_EDGES = 250_000
#: Words whose hashes a worker keeps, and columns of a block of the exact comparison.
CACHE_WORDS = 400_000
DENSE = 4096

_ODD = np.uint64(0x9E3779B97F4A7C15)


def runs(threshold: float = THRESHOLD, rate: float = RATE, depth: int = DEPTH, miss: float = MISS) -> int:
    """Runs until a pair at the threshold shares a deepest node but for the chance ``miss``.

    A node passes the pair on to a number of children that is about Poisson with
    mean ``threshold / rate``.
    """
    lost = 0.0
    for _ in range(depth):
        lost = math.exp(-threshold / rate * (1 - lost))
    return max(1, math.ceil(math.log(miss) / math.log(lost)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Hashes of the word n-grams of a text; keeps the hashes of words."""

    def __init__(self, words: int = WORDS):
        self.n = words
        self.cache: dict[bytes, int] = {}
        self.factors = _mixed(np.arange(1, words + 1, dtype=np.uint64) * _ODD) | np.uint64(1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """The distinct n-gram hashes, ascending.

        A text of fewer words has one n-gram, all of its words; none without words.
        """
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        found = [*map(self.cache.get, words)]
        if None in found:
            for i, value in enumerate(found):
                if value is None:
                    found[i] = self.cache[words[i]] = xxhash.xxh64_intdigest(words[i])
        w = np.asarray(found, np.uint64)
        width = min(self.n, len(words))
        total = np.full(len(w) - width + 1, width, np.uint64)
        for i in range(width):
            total += w[i:len(w) - width + 1 + i] * self.factors[i]
        return np.unique(_mixed(total))


def _seeds() -> np.ndarray:
    return _mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * _ODD)


_SEEDS = _seeds()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The minimum hash of every coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint32).max, np.uint32)
    for start in range(0, len(hashes), 2048):
        x = hashes[start:start + 2048, None] ^ _SEEDS[None, :]
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        x *= _ODD
        least = np.minimum(least, (x >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return least


_SIGNED = "doc_id long, digest binary, n_grams int, sketch binary"


def signatures(docs: DataFrame) -> DataFrame:
    """Digest of the words, number of n-grams and embedding of every text."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in slices(batches):
            split = [(t or b"").split() for t in part["text"]]
            sets = [shingler.hashes(w) for w in split]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["doc_id"], pa.int64()),
                 pa.array([_digest(w) for w in split], pa.binary()),
                 pa.array(map(len, sets), pa.int32()),
                 pa.array([sketch(s).tobytes() for s in sets], pa.binary())],
                names=["doc_id", "digest", "n_grams", "sketch"])
    return columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(run, _SIGNED)


def _digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


# --- paths -------------------------------------------------------------------------

def children(paths: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and their child paths: for each coordinate the row's node samples, the
    hash of path, coordinate and token."""
    draws = _mixed(paths[:, None] ^ _SEEDS[None, :])
    limit = np.uint64(int(2.0 ** 64 / (RATE * COORDINATES)))
    row, coordinate = np.nonzero(draws < limit)
    token = sketches[row, coordinate].astype(np.uint64) + np.uint64(1)
    return row, _mixed(draws[row, coordinate] + token * _ODD)


def roots(number: int) -> np.ndarray:
    return _mixed(np.arange(1, number + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def _sketches(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), np.uint32).reshape(len(values), COORDINATES)


def first_level(texts: DataFrame, start: np.ndarray) -> DataFrame:
    """``path``, ``digest`` and a ``mark`` of the tag, for the children of the given roots."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            held = _sketches(part["sketch"])
            marks = np.frombuffer(b"".join(t[:8] for t in part["tag"]), np.int64)
            for root in start:
                row, path = children(np.full(len(held), root), held)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(path.view(np.int64)), pa.array(part["digest"], pa.binary()).take(pa.array(row)),
                     pa.array(marks[row])],
                    names=["path", "digest", "mark"])
    return texts.select("digest", "tag", "sketch").mapInArrow(run, "path long, digest binary, mark long")


def next_level(rows: DataFrame) -> DataFrame:
    """Children of the rows' nodes; each keeps its ``digest``, ``tag`` and ``sketch``."""
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1024):
            row, path = children(np.asarray(part["path"], np.int64).view(np.uint64), _sketches(part["sketch"]))
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(path.view(np.int64)), *[pa.array(part[c], pa.binary()).take(take)
                                                 for c in ("digest", "tag", "sketch")]],
                names=["path", "digest", "tag", "sketch"])
    return rows.select("path", "digest", "tag", "sketch").mapInArrow(
        run, "path long, digest binary, tag binary, sketch binary")


def least_estimate() -> float:
    deviation = math.sqrt(THRESHOLD * (1 - THRESHOLD) / COORDINATES)
    return THRESHOLD - DEVIATIONS * deviation


# --- comparing groups of rows --------------------------------------------------------

class Forest:
    """Union-find that tells which pairs join two trees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.top(a), self.top(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """Rows sorted by keys, in portions that hold whole groups only."""
    rest: dict[str, list] | None = None
    for part in slices(batches, 4096):
        if rest:
            part = {c: rest[c] + part[c] for c in part}
        marks = list(zip(*[part[k] for k in keys], strict=True))
        cut = len(marks)
        while cut and marks[cut - 1] == marks[-1]:
            cut -= 1
        if cut:
            yield {c: v[:cut] for c, v in part.items()}
        rest = {c: v[cut:] for c, v in part.items()}
    if rest and rest[keys[0]]:
        yield rest


def _group_numbers(part: dict[str, list], keys: list[str]) -> np.ndarray:
    marks = list(zip(*[part[k] for k in keys], strict=True))
    new = np.fromiter((i > 0 and marks[i] != marks[i - 1] for i in range(len(marks))), bool, len(marks))
    return np.cumsum(new)


def in_blocks(rows: DataFrame, key: str, size: str, name: str, limit: int) -> DataFrame:
    """Add ``_i`` and ``_j``: rows of a group larger than ``limit`` are dealt to blocks,
    and each row goes to all pairs of blocks its own belongs to."""
    count = F.ceil(F.col(size) / limit).cast("int")
    own = F.pmod(F.xxhash64(name, F.lit(17)), count).cast("int")
    return (rows.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), count - 1)))
            .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
            .drop("_other"))


def similar_pairs(rows: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` of similar embeddings that connect all there are in each ``path``.

    Texts of the same ``tag`` are connected already, so of each comparison only
    pairs are returned that join different tags: as many as there are tags, at most.
    """
    least = least_estimate() * COORDINATES
    keys = ["path", "_i", "_j"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, keys):
            group, held = _group_numbers(part, keys), _sketches(part["sketch"])
            sizes = np.bincount(group)
            hits = []
            for apart in range(1, int(sizes.max())):
                low = np.flatnonzero(group[apart:] == group[:-apart])
                for at in range(0, len(low), 8192):
                    a = low[at:at + 8192]
                    same = (held[a] == held[a + apart]).sum(axis=1)
                    a = a[same >= least]
                    hits += zip(a.tolist(), (a + apart).tolist(), strict=True)
            forest, tagged = Forest(), {}
            for k, mark in enumerate(zip(group.tolist(), part["tag"], strict=True)):
                forest.join(tagged.setdefault(mark, k), k)
            found = [(a, b) for a, b in hits if part["digest"][a] != part["digest"][b] and forest.join(a, b)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part["digest"][a] for a, _ in found], pa.binary()),
                     pa.array([part["digest"][b] for _, b in found], pa.binary())], names=["a", "b"])

    blocked = in_blocks(rows, "path", "n", "digest", LIMIT).select(*keys, "digest", "tag", "sketch")
    return (blocked.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a binary, b binary"))


def near_leader(rows: DataFrame) -> DataFrame:
    """Replace the tag of the rows that resemble the leader of their path by the leader."""
    least = least_estimate() * COORDINATES

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 4096):
            near = (_sketches(part["sketch"]) == _sketches(part["lead_sketch"])).sum(axis=1) >= least
            tags = [lead if close else own for lead, own, close in zip(
                part["leader"], part["tag"], near.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["path"], pa.int64()), pa.array(part["digest"], pa.binary()),
                 pa.array(tags, pa.binary()), pa.array(part["sketch"], pa.binary()),
                 pa.array(part["leader"], pa.binary()), pa.array(near)],
                names=["path", "digest", "tag", "sketch", "leader", "near"])

    leads = rows.where("digest = leader").select("path", F.col("sketch").alias("lead_sketch"))
    return rows.join(leads, "path").select(
        "path", "digest", "tag", "sketch", "leader", "lead_sketch").mapInArrow(
        run, "path long, digest binary, tag binary, sketch binary, leader binary, near boolean")


def few_against_many(rows: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` for nodes whose texts are connected but for a few: these are compared with all.

    ``main`` is the tag of most texts of a node; in rows of other tags it may be null.
    These others, ``LIMIT`` at most, go to every part of the node, so that a node of any
    size is many tasks' work.
    """
    least = least_estimate() * COORDINATES
    keys = ["path", "_part"]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, keys):
            group, held = _group_numbers(part, keys), _sketches(part["sketch"])
            edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            found = []
            for low, high in zip(edges, edges[1:], strict=False):
                few = [k for k in range(low, high) if part["few"][k]]
                forest, tagged = Forest(), {}
                for k in range(low, high):
                    forest.join(tagged.setdefault(part["tag"][k], k), k)
                for k in few:
                    near = (held[low:high] == held[k]).sum(axis=1) >= least
                    found += [(k, x) for x in (np.flatnonzero(near) + low).tolist()
                              if part["digest"][x] != part["digest"][k] and forest.join(k, x)]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part["digest"][a] for a, _ in found], pa.binary()),
                     pa.array([part["digest"][b] for _, b in found], pa.binary())], names=["a", "b"])

    count = F.ceil(F.col("n") / PART).cast("int")
    few = ~F.col("tag").eqNullSafe(F.col("main"))
    own = F.pmod(F.xxhash64("digest", F.lit(23)), count).cast("int")
    dealt = rows.withColumn("few", few).withColumn("_part", F.explode(
        F.when(few, F.sequence(F.lit(0), count - 1)).otherwise(F.array(own)))).select(*keys, "few", "digest", "tag", "sketch")
    return (dealt.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
            .mapInArrow(run, "a binary, b binary"))


def candidates(texts: DataFrame, number: int | None = None) -> DataFrame:
    """Pairs ``a``, ``b`` that connect all texts whose embeddings met and were alike.

    ``texts`` has ``digest`` and ``sketch``, one row each.  The first runs find most
    of what there is; in the others, nodes whose texts are all connected by then
    are done with.
    """
    start = roots(number or runs())
    few = max(1, len(start) // 6)
    found = follow(texts.withColumn("tag", F.col("digest")), start[:few])
    if len(start) > few:
        known = components(found).select(F.col("node").alias("digest"), F.col("least").alias("tag"))
        tagged = texts.select("digest", "sketch").join(known, "digest", "left").withColumn(
            "tag", F.coalesce("tag", "digest"))
        found = written(found.union(follow(written(tagged, "tagged"), start[few:])).distinct(), "pairs")
    return found


def follow(texts: DataFrame, start: np.ndarray) -> DataFrame:
    """Pairs met on the paths from the given roots by texts of different ``tag``."""
    paths = first_level(texts, start)
    found = None
    for level in range(1, DEPTH + 1):
        tag = F.col("mark") if level == 1 else F.col("tag")
        # What there is of each tag comes first: so the node's main tag is known, and no task counts a large node alone.
        nodes = (paths.groupBy("path", tag.alias("_tag")).agg(F.count("*").alias("_c"), F.min("digest").alias("leader"))
                 .groupBy("path").agg(F.sum("_c").alias("n"), F.count("*").alias("_tags"), F.min("leader").alias("leader"),
                                      F.max(F.struct("_c", "_tag")).alias("_main"))
                 .where("_tags > 1").select("path", "n", "leader", F.col("_main._tag").alias("_main"),
                                            (F.col("n") - F.col("_main._c")).alias("_rest")))
        rows = paths.join(nodes, "path").withColumn("_most", tag == F.col("_main"))
        if level == 1:
            rows = rows.join(texts.select("digest", "tag", "sketch"), "digest")
        rows = written(rows.select("path", "n", "_rest", "leader", F.when(F.col("_most"), F.col("tag")).alias("main"), "digest", "tag", "sketch"), f"paths{level}")
        pairs = similar_pairs(rows.where(F.col("n") <= LIMIT))
        split = rows.where(F.col("n") > LIMIT)
        if not split.isEmpty():
            # Nodes whose texts are connected but for a few are done with at once.
            pairs = pairs.union(few_against_many(split.where(F.col("_rest") <= LIMIT)))
            wide = split.where(F.col("_rest") > LIMIT)
            if wide.isEmpty():
                level = DEPTH
            else:
                led = written(near_leader(wide), f"leaders{level}")
                pairs = pairs.union(led.where("near and digest <> leader").select("leader", "digest"))
                if level < DEPTH:
                    paths = written(next_level(led), f"children{level}")
                else:  # compared whatever their size, but for those the leader has connected
                    apart = (led.groupBy("path").agg(F.count("*").alias("n"), F.min("tag").alias("_low"), F.max("tag").alias("_high"))
                             .where("_low < _high").select("path", "n"))
                    pairs = pairs.union(similar_pairs(led.join(apart, "path").select("path", "n", "digest", "tag", "sketch")))
        else:
            level = DEPTH
        found = pairs if found is None else found.union(pairs)
        if level == DEPTH:
            break
    return written(found.distinct(), "pairs")


# --- groups ------------------------------------------------------------------------

def components(pairs: DataFrame) -> DataFrame:
    """``node`` and ``least``, the least node of its component, from pairs ``a``, ``b``.

    Up to ``FEW_EDGES`` pairs are joined by one task; more by alternating stars: every node sends its greater neighbours, then its smaller
    ones, to the least neighbour it knows, until nothing changes.  Only minima
    are grouped, so a node with very many neighbours is no single task's work.
    """
    def mark(edges: DataFrame) -> tuple:
        return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    @tidy
    def few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[bytes, int] = {}
        ends = [(names.setdefault(a, len(names)), names.setdefault(b, len(names)))
                for part in slices(batches, 4096) for a, b in zip(part["a"], part["b"], strict=True)]
        if not ends:
            return
        order = {old: new for new, old in enumerate(sorted(range(len(names)), key=list(names).__getitem__))}
        forest, known = Forest(), sorted(names)
        for a, b in ends:
            forest.join(order[a], order[b])
        yield pa.RecordBatch.from_arrays(
            [pa.array(known, pa.binary()), pa.array([known[forest.top(i)] for i in range(len(known))], pa.binary())],
            names=["node", "least"])

    edges, folder = written_to(pairs.select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before = mark(edges)
    if before[0] <= FEW_EDGES:
        return edges.coalesce(1).mapInArrow(few, "node binary, least binary")
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        old = folder
        edges, folder = written_to(small.union(least.select("a", "m")).select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
        drop_folder(pairs.sparkSession, old)
        now = mark(edges)
        if now == before:
            break
        before = now
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("least"))
    return stars.union(edges.select(F.col("b").alias("node"), F.col("b").alias("least")).distinct())


def sized_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """Broadcast the right side if it has few rows, else shuffle both."""
    small = right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return left.join(F.broadcast(right) if small else right, on, how)


def exact_links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links inside candidate groups by their exact sets.

    ``members`` has ``doc_id``, ``digest``, ``least`` and ``n``, the size of the
    group.  Rows ``a``, ``b``, ``links``: either a pair of the spanning forest
    (``links`` is null) or a number of links of ``a`` (``b`` is null).
    """
    @tidy
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for part in slices(batches):
            rows = []
            for text, digest, least, n in zip(*[part[c] for c in ("text", "digest", "least", "n")], strict=True):
                words = (text or b"").split()
                if _digest(words) == digest:  # an id may stand for several texts
                    rows.append((digest, least, n, shingler.hashes(words).tobytes()))
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(
                    ("digest", "least", "n", "grams"), map(list, zip(*rows, strict=True)), strict=True)),
                    schema=pa.schema([("digest", pa.binary()), ("least", pa.binary()), ("n", pa.int64()),
                                      ("grams", pa.binary())]))

    keys = ["least", "_i", "_j"]

    @tidy
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in grouped(batches, keys):
            group = _group_numbers(part, keys)
            edges = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(group)]
            out = []
            for low, high in zip(edges, edges[1:], strict=False):
                rows = [k for k in range(low, high) if k == low or part["digest"][k] != part["digest"][k - 1]]
                grams = [np.frombuffer(part["grams"][k], np.uint64) for k in rows]
                near = np.triu(similar(grams), 1)
                if part["_i"][low] != part["_j"][low]:
                    own = np.asarray([part["_own"][k] for k in rows])
                    near &= own[:, None] != own[None, :]
                names = [part["digest"][k] for k in rows]
                links = near.sum(axis=0) + near.sum(axis=1)
                out += [(names[k], None, int(links[k])) for k in np.flatnonzero(links)]
                forest = Forest()
                out += [(names[a], names[b], None) for a, b in zip(*(x.tolist() for x in np.nonzero(near)), strict=True)
                        if forest.join(a, b)]
            if out:
                yield pa.RecordBatch.from_pydict(
                    dict(zip("abn", map(list, zip(*out, strict=True)), strict=True)),
                    schema=pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])).rename_columns(
                    ["a", "b", "links"])

    texts = columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    held = (sized_join(texts.withColumn("_id", F.coalesce("doc_id", F.lit(-1 << 63))).drop("doc_id"),
                       members.select(F.coalesce("doc_id", F.lit(-1 << 63)).alias("_id"), "digest", "least", "n"), "_id")
            .select("text", "digest", "least", "n").mapInArrow(sets, "digest binary, least binary, n long, grams binary"))
    blocked = in_blocks(held, "least", "n", "digest", BLOCK).select(*keys, "_own", "digest", "grams")
    return (blocked.repartition(partitions(docs.sparkSession), *keys).sortWithinPartitions(*keys, "digest")
            .mapInArrow(compare, "a binary, b binary, links long"))


def similar(grams: list[np.ndarray], threshold: float = THRESHOLD) -> np.ndarray:
    """Which pairs of sets have at least the Jaccard similarity; the diagonal does."""
    sizes = np.asarray([len(g) for g in grams], np.float64)
    count = len(grams)
    owner = np.repeat(np.arange(count), sizes.astype(np.int64))
    _, token, times = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
    shared = times[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    owner = owner[shared]
    common = np.zeros((count, count))
    if token.size:
        order = np.argsort(token, kind="stable")
        token, owner = token[order], owner[order]
        for low in range(0, int(token[-1]) + 1, DENSE):
            a, b = np.searchsorted(token, [low, low + DENSE])
            dense = np.zeros((count, min(DENSE, int(token[-1]) + 1 - low)), np.float32)
            dense[owner[a:b], token[a:b] - low] = 1
            common += dense @ dense.T
    np.fill_diagonal(common, sizes)
    union = sizes[:, None] + sizes[None, :] - common
    return common >= threshold * union - 1e-9


def classed(docs: DataFrame, number: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The signatures of all rows, and the different texts with words: ``digest``, its
    least ``doc_id`` (null if it has none), ``n_copies``, ``least`` (the class) and ``n_links``."""
    signed = written(signatures(docs), "signatures")
    texts = written(signed.where("n_grams > 0").groupBy("digest").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), F.first("sketch").alias("sketch")), "texts")
    groups = written(components(candidates(texts, number)), "groups")
    sizes = groups.groupBy("least").agg(F.count("*").alias("n"))
    members = (groups.join(sizes, "least").withColumnRenamed("node", "digest")
               .join(texts.select("digest", "doc_id"), "digest"))
    links = written(exact_links(docs, members), "links")
    linked = links.where("b is null").groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("n_links"))
    final = components(links.where("b is not null").select("a", "b")).withColumnRenamed("node", "digest")
    named = texts.select("digest", "doc_id", "n_copies").join(final, "digest", "left").join(linked, "digest", "left")
    return signed, named.withColumn("least", F.coalesce("least", "digest"))


def classes(docs: DataFrame, number: int | None = None) -> DataFrame:
    """``doc_id``, ``class_id``, ``n_links`` and ``n_copies`` of every document.

    Documents are in one class if a chain of links or copies connects them;
    ``class_id`` is the least id of the class.  ``n_links`` counts the different
    texts linked, ``n_copies`` the documents of the same words, itself included.
    A text without words, null or empty, has no links and is a class of its own.
    Repeated rows are copies; a null id never names a class unless it is all
    there is; an empty table gives no rows; other columns are ignored.
    """
    signed, named = classed(docs, number)
    ids = named.groupBy("least").agg(F.min("doc_id").alias("class_id"))
    by_text = named.join(ids, "least").select("digest", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return (signed.where("n_grams > 0").select("doc_id", "digest").join(by_text, "digest")
            .select("doc_id", "class_id", "n_links", "n_copies")
            .unionByName(signed.where("n_grams = 0").select(
                "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"),
                F.lit(1).cast("long").alias("n_copies"))))


def document_key(digest: Column, doc_id: Column) -> Column:
    """Digest and id in one; a null id equals only itself."""
    return F.concat(digest, F.coalesce(doc_id.cast("long").cast("string"), F.lit("")).cast("binary"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near-duplicates: of each class the one with the least id.

    A document is an id and the words of its text, so an id that stands for
    several texts is several documents.  A null id comes after all others.  Of
    several rows of the kept document one stays.  Texts without words stay, one
    row for each id and text.  Other columns stay as they are.
    """
    @F.arrow_udf("binary")
    def digests(texts: pa.Array) -> pa.Array:
        found = [_digest((t or b"").split()) for start in range(0, len(texts), SLICE_ROWS)
                 for t in texts.slice(start, SLICE_ROWS).to_pylist()]
        let_go()
        return pa.array(found, pa.binary())

    signed, named = classed(docs)
    named = written(named.select("digest", "doc_id", "least"), "named")
    first = named.groupBy("least").agg(F.min(F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    stays = named.join(first, "least").select(
        "digest", document_key(F.col("first.digest"), F.col("first.doc_id")).alias("_stays"))
    keys = signed.select("digest", "n_grams", document_key(F.col("digest"), F.col("doc_id")).alias("_key"))
    gone = written(keys.where("n_grams > 0").join(stays, "digest").where("_key <> _stays").select("_key").distinct(), "gone")
    again = written(keys.groupBy("_key").agg(F.count("*").alias("n")).where("n > 1").select("_key")
                    .join(gone, "_key", "left_anti"), "again")
    key, bare = free(docs, "_key", "_bare")  # the documents may have columns of any names
    gone, again = gone.withColumnRenamed("_key", key), again.withColumnRenamed("_key", key)
    own = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, document_key(digests(F.col("text").cast("binary")), F.col("doc_id")))
    kept = sized_join(keyed, gone, key, "left_anti")
    if again.isEmpty():
        return kept.select(*own)
    once = sized_join(kept, again, key, "left_anti")
    wordless = F.substring(key, 1, 16) == F.lit(_digest([]))
    repeated = sized_join(kept, again, key, "left_semi").withColumn(bare, F.when(wordless, F.col("text")))
    return once.unionByName(repeated.dropDuplicates([key, bare]).drop(bare)).select(*own)


def op9_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents; see :func:`classes`."""
    return classes(table(spark, sf_dir, "documents"))
