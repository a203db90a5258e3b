"""Token-id output as Re-Pair grammars, with random access to single documents.

Documents are encoded in order and their ids are written in blocks of about
``BLOCK_IDS`` ids.  The ids of a block are cut into segments, and each segment
gets its own grammar: in rounds, the most frequent pairs of neighbouring symbols
become new symbols, until no pair is frequent enough to pay for its rule.  A segment stores its
rules, the expansion length of every new symbol and the rest sequence; a block
adds the ids and lengths of its documents.  To read one document, the symbols
that cover it are found by their summed expansion lengths and only those are
expanded.

Blocks are rows with a binary column in Parquet, so any store Spark can write to
will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepact.llm.common import ordered_text, scratch, slices, table
from tablepact.llm.tokens import default_tokenizer, text_parts, worker_tokenizer

#: Ids after which a block ends with the document at hand, and ids of a segment.
BLOCK_IDS = 1 << 20
SEGMENT_IDS = 1 << 20
#: A pair becomes a rule if it is replaced this often: a rule takes 12 bytes, each use saves 4.
MIN_PAIRS = 4
#: Buckets in which pairs are counted, at most.
_PAIR_BITS = 20
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MAGIC = 0x52505231


def _bucket(code: np.ndarray, bits: int, turn: int) -> np.ndarray:
    """Hashes of so many bits, by another odd factor at each turn."""
    mixed = code.view(np.uint64) * np.uint64(pow(int(_MIX), 2 * turn + 1, 1 << 64))
    mixed >>= np.uint64(64 - bits)
    return mixed.view(np.int64)


def _alternating(at: np.ndarray) -> np.ndarray:
    """Which of ascending positions are the first, third, ... of a run of neighbours, whose pairs overlap."""
    out = np.ones(at.size, bool)
    beside = np.flatnonzero(at[1:] == at[:-1] + 1) + 1
    if beside.size:
        order = np.arange(beside.size)
        start = np.maximum.accumulate(np.where(np.r_[True, beside[1:] != beside[:-1] + 1], order, 0))
        out[beside[(order - start) % 2 == 0]] = False
    return out


def _one_by_one(at: np.ndarray, which: np.ndarray, counts: np.ndarray, min_pairs: int,
                size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions and pairs to replace, the most frequent pair first; and positions of pairs that cannot be replaced
    often enough although nothing is in their way."""
    order = np.argsort(which, kind="stable")
    groups = np.split(at[order], np.flatnonzero(np.diff(which[order])) + 1)
    names = which[order][np.cumsum([0, *map(len, groups[:-1])])]
    taken = np.zeros(size + 1, bool)
    chosen, kind, never = [at[:0]], [which[:0]], [at[:0]]
    for i in np.argsort(-counts[names], kind="stable"):
        places = groups[i]
        free = places[~(taken[places] | taken[places + 1])]
        own = free[_alternating(free)]
        if len(own) >= min_pairs:
            taken[own] = taken[own + 1] = True
            chosen.append(own)
            kind.append(np.full(len(own), names[i]))
        elif len(free) == len(places):
            never.append(places)
    found, kinds = np.concatenate(chosen), np.concatenate(kind)
    order = np.argsort(found)
    return found[order], kinds[order], np.concatenate(never)


def compress(ids: np.ndarray, base: int, min_pairs: int = MIN_PAIRS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols), symbols per round and the rest sequence.

    Symbol ``base + i`` stands for the pair ``rules[i]``; a rule refers to ids
    and to symbols of earlier rounds only.  In each round every pair is replaced
    that is no rarer than the pairs it overlaps, where that happens ``min_pairs``
    times at least.  A pair that was too rare stays so until one of its symbols
    changes, so later rounds look at frequent pairs and beside new symbols only.
    They end when no pair is left that can be replaced so often.
    """
    seq = ids.astype(np.uint32)  # as a block stores them
    active = np.ones(seq.size, bool)
    rules: list[np.ndarray] = []
    per_round: list[int] = []
    total = 0
    while True:
        active[-1:] = False
        at = np.flatnonzero(active)
        if at.size == 0:
            break
        code = seq[at].astype(np.int64)
        code <<= 32
        code |= seq[at + 1]
        bits = min(max(int(4 * at.size).bit_length(), 8), _PAIR_BITS)
        bucket = _bucket(code, bits, len(per_round))
        pairs = np.empty(1 << bits, np.int64)  # only buckets of pairs are looked at
        pairs[bucket] = code
        # One pair for each bucket; others that share it wait for a round whose buckets differ.
        own = pairs[bucket] == code
        waiting = not own.all()
        if waiting:
            at, bucket = at[own], bucket[own]
        counts = np.bincount(bucket, minlength=1 << bits)
        hits = counts[bucket]
        often = hits >= min_pairs
        active[at[~often]] = False
        at, which, hits = at[often], bucket[often], hits[often]
        if at.size == 0:
            per_round += [0] if waiting else []
            if waiting:
                continue
            break
        beside = at[1:] == at[:-1] + 1
        most = np.ones(at.size, bool)
        most[1:] = ~beside | (hits[1:] >= hits[:-1])
        most[:-1] &= ~beside | (hits[:-1] >= hits[1:])
        top = np.flatnonzero(most)
        top = top[_alternating(at[top])]
        chosen, kind = at[top], which[top]
        enough = np.bincount(kind) >= min_pairs
        if not enough.any():  # equally frequent pairs in each other's way: one after the other
            chosen, kind, never = _one_by_one(at, which, counts, min_pairs, seq.size)
            active[never] = False
            enough = np.bincount(kind) > 0
            if not chosen.size:
                continue
        used = enough[kind]
        chosen, kind = chosen[used], kind[used]
        made = np.flatnonzero(enough)
        number = np.empty(enough.size, np.uint32)
        number[made] = np.arange(base + total, base + total + made.size)
        seq[chosen] = number[kind]
        active[chosen] = True
        active[np.maximum(chosen - 1, 0)] = True
        keep = np.ones(seq.size, bool)
        keep[chosen + 1] = False
        kept = np.flatnonzero(keep)
        seq, active = seq[kept], active[kept]
        rules.append(np.stack([pairs[made] >> 32, pairs[made] & 0xFFFFFFFF], axis=1))
        per_round.append(made.size)
        total += per_round[-1]
    pairs = np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)
    return pairs, np.asarray(per_round, np.int64), seq.astype(np.int64)


def lengths_of(rules: np.ndarray, base: int) -> np.ndarray:
    """Expansion length of every rule's symbol."""
    out = np.zeros(len(rules), np.int64)
    done = 0
    while done < len(rules):
        # All rules whose parts are known by now; at least one, as rules refer backwards.
        known = base + done
        end = done + int(np.argmax(np.r_[(rules[done:] >= known).any(axis=1), True]))
        part = rules[done:end]
        out[done:end] = np.where(part < base, 1, out[np.maximum(part - base, 0)]).sum(axis=1)
        done = end
    return out


def expand(seq: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """The ids a sequence of symbols stands for."""
    seq = seq.astype(np.int64)
    while True:
        new = seq >= base
        if not new.any():
            return seq.astype("<u4")
        start = np.arange(seq.size) + np.r_[0, np.cumsum(new)[:-1]]
        out = np.empty(seq.size + int(new.sum()), np.int64)
        pair = rules[seq[new] - base]
        out[start[~new]] = seq[~new]
        out[start[new]] = pair[:, 0]
        out[start[new] + 1] = pair[:, 1]
        seq = out


def expand_all(seq: np.ndarray, rules: np.ndarray, lengths: np.ndarray, base: int) -> np.ndarray:
    """The same for a whole sequence: every rule is expanded once, then all symbols are looked up.

    The expansions take no more room than the ids do for each round, as every rule is used several times.
    """
    pool = np.zeros(int(lengths.sum()), np.uint32)
    starts = np.zeros(len(rules), np.int64)

    def looked_up(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        new = np.flatnonzero(symbols >= base)
        size, source = np.ones(symbols.size, np.int32), np.zeros(symbols.size, np.int32)
        rule = symbols[new] - base
        size[new], source[new] = lengths[rule], starts[rule]
        end = np.cumsum(size)
        begin = end - size
        if not new.size:
            return symbols.astype(np.uint32), begin
        # Places fit 31 bits: a segment has SEGMENT_IDS ids.
        places = np.repeat(source - begin.astype(np.int32), size)
        places += np.arange(places.size, dtype=np.int32)
        out = pool[places]
        old = np.flatnonzero(symbols < base)
        out[begin[old]] = symbols[old]
        return out, begin

    done = filled = 0
    while done < len(rules):
        end = done + int(np.argmax(np.r_[(rules[done:] >= base + done).any(axis=1), True]))
        out, begin = looked_up(rules[done:end].ravel())
        pool[filled:filled + out.size] = out
        starts[done:end] = filled + begin[::2]
        done, filled = end, filled + out.size
    return looked_up(seq.astype(np.int64))[0].astype("<u4")


def pack_block(doc_ids: list[int | None], packed: list[bytes], base: int | None = None) -> bytes:
    """One block: header, documents, then each segment's grammar."""
    ids = np.frombuffer(b"".join(packed), "<u4")
    base = base or (int(ids.max()) + 1 if ids.size else 1)
    parts = []
    segments = range(0, ids.size, SEGMENT_IDS)
    for start in segments:
        rules, _, seq = compress(ids[start:start + SEGMENT_IDS], base)
        lengths = lengths_of(rules, base)
        parts += [np.asarray([len(rules), len(seq)], "<u8").tobytes(), rules.astype("<u4").tobytes(),
                  lengths.astype("<u4").tobytes(), seq.astype("<u4").tobytes()]
    head = np.asarray([_MAGIC, base, len(doc_ids), len(segments)], "<u8").tobytes()
    names = np.asarray([d or 0 for d in doc_ids], "<i8").tobytes()
    names += np.asarray([d is None for d in doc_ids], "u1").tobytes()
    sizes = np.asarray([len(p) // 4 for p in packed], "<u8").tobytes()
    return b"".join([head, names, sizes, *parts])


class Block:
    """A block as read: whole, or one document at a time."""

    def __init__(self, data: bytes):
        magic, self.base, docs, segments = map(int, np.frombuffer(data, "<u8", 4))
        if magic != _MAGIC:
            raise ValueError("not a block of token ids")
        at = 32
        names = np.frombuffer(data, "<i8", docs, at)
        missing = np.frombuffer(data, "u1", docs, at + 8 * docs)
        self.doc_ids = [None if m else int(n) for n, m in zip(names, missing, strict=True)]
        self.sizes = np.frombuffer(data, "<u8", docs, at + 9 * docs).astype(np.int64)
        self.starts = np.r_[0, np.cumsum(self.sizes)]
        at += 17 * docs
        self.segments = []
        for _ in range(segments):
            n_rules, n_seq = map(int, np.frombuffer(data, "<u8", 2, at))
            at += 16
            rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
            lengths = np.frombuffer(data, "<u4", n_rules, at + 8 * n_rules)
            seq = np.frombuffer(data, "<u4", n_seq, at + 12 * n_rules)
            at += 12 * n_rules + 4 * n_seq
            self.segments.append((rules, lengths, seq))

    def ids(self) -> np.ndarray:
        parts = [expand_all(seq, rules, lengths.astype(np.int64), self.base) for rules, lengths, seq in self.segments]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def read(self, start: int, end: int) -> np.ndarray:
        """Ids ``start`` to ``end`` of the block; only symbols over them are expanded."""
        out = []
        for number, (rules, lengths, seq) in enumerate(self.segments):
            low = max(start - number * SEGMENT_IDS, 0)
            high = min(end - number * SEGMENT_IDS, SEGMENT_IDS)
            if low >= high:
                continue
            symbols = seq.astype(np.int64)
            size = np.ones(symbols.size, np.int64)
            new = symbols >= self.base
            size[new] = lengths[symbols[new] - self.base]
            ends = np.cumsum(size)
            first = int(np.searchsorted(ends, low, "right"))
            last = int(np.searchsorted(ends, high, "left"))
            before = int(ends[first - 1]) if first else 0
            out.append(expand(symbols[first:last + 1], rules, self.base)[low - before:high - before])
        return np.concatenate(out) if out else np.zeros(0, "<u4")

    def document(self, number: int) -> np.ndarray:
        return self.read(int(self.starts[number]), int(self.starts[number + 1]))


_BLOCKS = "shard int, block int, n_docs long, n_tokens long, payload binary"
_DOCS = "shard int, block int, doc_id long, in_block long, n_tokens long, ids_crc32 long"


def encode_blocks(docs: DataFrame, path: str, end_id: int, tokenizer: str | None = None,
                  n: int | None = None) -> None:
    """Encode all texts in ascending order of ``doc_id`` and write the blocks to ``path``.

    Null texts are empty and hold the end id alone; null ids come first; equal
    ids follow one another in the order of their texts; an empty table writes
    no block.  Other columns are ignored.
    """
    vocabulary = tokenizer or default_tokenizer()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, held, kept, total = TaskContext.get().partitionId(), 0, [], [], 0
        words = worker_tokenizer(vocabulary)
        end = np.asarray([end_id], "<u4").tobytes()

        def row():
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([len(held)], pa.int64()),
                 pa.array([total], pa.int64()), pa.array([pack_block(held, kept)], pa.binary())],
                names=["shard", "block", "n_docs", "n_tokens", "payload"])

        for part in text_parts(batches):
            for doc_id, packed in zip(part.column("doc_id").to_pylist(), words.encode_array(part.column("text")),
                                      strict=True):
                held.append(doc_id)
                kept.append(packed + end)
                total += len(packed) // 4 + 1
                if total >= BLOCK_IDS:
                    yield row()
                    block, held, kept, total = block + 1, [], [], 0
        if held:
            yield row()

    ordered_text(docs, n).mapInArrow(write, _BLOCKS).write.parquet(path)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: its place, length and checksum."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, 1):
            for shard, number, payload in zip(part["shard"], part["block"], part["payload"], strict=True):
                block = Block(payload)
                raw = memoryview(block.ids().tobytes())
                edges = (block.starts * 4).tolist()
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
                count = len(crcs)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * count, pa.int32()), pa.array([number] * count, pa.int32()),
                     pa.array(block.doc_ids, pa.int64()), pa.array(block.starts[:-1], pa.int64()),
                     pa.array(block.sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    names=["shard", "block", "doc_id", "in_block", "n_tokens", "ids_crc32"])

    return (spark.read.schema(_BLOCKS).parquet(path).select("shard", "block", "payload")
            .mapInArrow(read, _DOCS))


def with_starts(documents: DataFrame, blocks: DataFrame) -> DataFrame:
    """Add ``start``, the ids of all documents before: shard totals are summed
    first, so that the only window without a key sees one row per shard."""
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("_tokens"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_tokens").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_inside"))
              .join(shards, "shard").select("shard", "block", (F.col("_inside") + F.col("_before")).alias("_base")))
    return (documents.join(starts, ["shard", "block"])
            .withColumn("start", F.col("_base") + F.col("in_block")).drop("_base", "in_block"))


def op1_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the grammar files and back; see :func:`encode_blocks`."""
    path = scratch(spark, "token-blocks")
    encode_blocks(table(spark, sf_dir, "documents"), path, end_id=2)
    blocks = spark.read.schema(_BLOCKS).parquet(path).select("shard", "block", "n_tokens")
    return (with_starts(read_documents(spark, path), blocks)
            .select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "block"))
