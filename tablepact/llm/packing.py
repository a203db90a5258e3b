"""Order-preserving packing by dynamic programming.

The ids of the documents, in order, form one stream.  A sequence is a window of
the stream of at most ``length`` ids.  A window may end where a document ends, at
no cost, where a sentence ends, or, at a higher cost, inside a sentence.  A
sequence is padded to ``length`` unless its own length is a power of two.  The
cuts with the least sum of padding and truncation costs are found by dynamic
programming over all possible ends: the best start of a padded window is the
head of a monotone queue, and windows of a power of two have one start each.

The stream is cut into ranges of documents, which are packed independently, so
no task sees more than its range; each range wastes one window at most.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tablepact.llm.common import give_back, ordered_text, table
from tablepact.llm.tokens import default_tokenizer, text_parts, worker_tokenizer

LENGTH = 2048
#: What a cut costs, in ids of padding: at a sentence end, and elsewhere in a document.
SENTENCE_CUT = 2
HARD_CUT = 8
#: Ids between possible cuts where no sentence ends.
GRAIN = 64
#: Ids of a stretch of the stream whose cuts are chosen together.
STRETCH_IDS = 1 << 19

#: An id whose text ends so ends a sentence.
_MARKS = (".", "!", "?")


@cache
def sentence_marks(tokenizer: str) -> np.ndarray:
    """Whether each id ends a sentence; found once per worker."""
    vocabulary = worker_tokenizer(tokenizer).tokenizer.get_vocab(with_added_tokens=True)
    out = np.zeros(max(vocabulary.values(), default=-1) + 1, bool)
    out[[i for text, i in vocabulary.items() if text.endswith(_MARKS)]] = True
    return out


def best_cuts(ends: list[int], costs: list[int], length: int = LENGTH) -> list[int]:
    """Positions of the chosen cuts, the last of ``ends`` included.

    ``ends`` are ascending possible cuts after position 0, no two of them, and
    not the first and 0, farther apart than ``length``; ``costs`` belong to them.
    Of equally good windows the longest is taken.
    """
    places = [0, *ends]
    best = [0] * len(places)
    come = [0] * len(places)
    queue: deque[int] = deque()
    first, starts = _power_starts(np.asarray(places, np.int64), length)
    for j in range(1, len(places)):
        i, here = j - 1, places[j]
        key = best[i] + places[i]
        while queue and best[queue[-1]] + places[queue[-1]] > key:
            queue.pop()
        queue.append(i)
        while places[queue[0]] < here - length:
            queue.popleft()
        start = queue[0]
        low = best[start] + length - (here - places[start])
        for i in starts[first[j]:first[j + 1]]:
            if best[i] < low or best[i] == low and i < start:
                low, start = best[i], i
        best[j], come[j] = low + costs[j - 1], start
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(places[j])
        j = come[j]
    return cuts[::-1]


def _power_starts(places: np.ndarray, length: int) -> tuple[list[int], list[int]]:
    """The starts of windows of a power of two: those of place ``j`` are from ``first[j]`` to ``first[j + 1]``."""
    ends, starts = [], []
    for k in range(length.bit_length()):
        at = np.searchsorted(places, places - (1 << k))
        hit = np.flatnonzero(places[at] == places - (1 << k))
        ends.append(hit)
        starts.append(at[hit])
    ends, starts = np.concatenate(ends), np.concatenate(starts)
    first = np.r_[0, np.cumsum(np.bincount(ends, minlength=len(places)))]
    return first.tolist(), starts[np.argsort(ends, kind="stable")].tolist()


def possible_cuts(documents: list[list[int]], length: int = LENGTH) -> tuple[list[int], list[int]]:
    """Ends and their costs for documents given by the ascending ends of their
    sentences (the last is the document's end).

    Stretches without an end get cuts every ``GRAIN`` ids, and the last window
    gets cuts a power of two before the end, so that it can do without padding.
    """
    cost: dict[int, int] = {}
    at = 0
    for sentences in documents:
        for end in sentences:
            cost.setdefault(at + end, SENTENCE_CUT)
        at += sentences[-1]
        cost[at] = 0
    for k in range(length.bit_length()):
        if at - (1 << k) > 0:
            cost.setdefault(at - (1 << k), HARD_CUT)
    ends = sorted(cost)
    filled, before, grain = [], 0, min(GRAIN, length)
    for end in ends:
        while end - before > grain:
            before += grain
            filled.append(before)
            cost.setdefault(before, HARD_CUT)
        filled.append(end)
        before = end
    return filled, [cost[e] for e in filled]


def pack_stream(lengths: list[list[int]], length: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, size, sequence, offset)`` of one stretch."""
    ends, costs = possible_cuts(lengths, length)
    cuts = best_cuts(ends, costs, length)
    starts = np.cumsum([0] + [d[-1] for d in lengths]).tolist()
    pieces, doc, at = [], 0, 0
    for sequence, cut in enumerate(cuts):
        offset = 0
        while at < cut:
            size = min(cut, starts[doc + 1]) - at
            pieces.append((doc, at - starts[doc], size, sequence, offset))
            at, offset = at + size, offset + size
            if at == starts[doc + 1]:
                doc += 1
    return pieces


_PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
           "sequence_id long, offset long")


def pack(docs: DataFrame, end_id: int = 1, length: int = LENGTH, tokenizer: str | None = None,
         n: int | None = None, ids: bool = False) -> DataFrame:
    """Pack all texts in ascending order of ``doc_id``; one row per piece.

    ``ids`` adds the piece's ids as packed unsigned 32-bit integers.  A null text
    is empty and holds the end id alone; null ids come first; equal ids follow
    one another in the order of their texts, and their pieces can be told apart
    by sequence and offset; an empty table gives no pieces.  Other columns are
    ignored.  A document longer than a stretch makes a stretch of its own.
    """
    if not 1 <= length < 1 << 31:
        raise ValueError("length must be positive")
    vocabulary = tokenizer or default_tokenizer()
    end = np.asarray([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_tokenizer(vocabulary)
        marks = sentence_marks(vocabulary)
        next_sequence = TaskContext.get().partitionId() << 40
        held: list[tuple[int | None, bytes]] = []
        cuts: list[list[int]] = []
        total = 0

        def flush() -> pa.RecordBatch:
            nonlocal next_sequence
            pieces = pack_stream(cuts, length)
            views = [memoryview(p) for _, p in held]
            chunks = [views[d][4 * s:4 * (s + n)] for d, s, n, _, _ in pieces]
            columns = [pa.array([held[p[0]][0] for p in pieces], pa.int64()),
                       pa.array([p[1] for p in pieces], pa.int64()), pa.array([p[2] for p in pieces], pa.int64()),
                       pa.array([zlib.crc32(c) for c in chunks], pa.int64()),
                       pa.array([len(views[p[0]]) // 4 for p in pieces], pa.int64()),
                       pa.array([next_sequence + p[3] for p in pieces], pa.int64()),
                       pa.array([p[4] for p in pieces], pa.int64())]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if ids:
                columns.append(pa.array([bytes(c) for c in chunks], pa.binary()))
                names.append("ids")
            next_sequence += pieces[-1][3] + 1
            return pa.RecordBatch.from_arrays(columns, names=names)

        for part in text_parts(batches):
            for doc_id, packed in zip(part.column("doc_id").to_pylist(), tokens.encode_array(part.column("text")),
                                      strict=True):
                ids_here = np.frombuffer(packed, "<u4")
                ends = [*(np.flatnonzero(marks[ids_here]) + 1).tolist(), len(ids_here) + 1]
                held.append((doc_id, packed + end))
                cuts.append(ends)
                total += ends[-1]
                if total >= STRETCH_IDS:
                    yield flush()
                    held, cuts, total = [], [], 0
                    give_back()
        if held:
            yield flush()
        held.clear()
        cuts.clear()
        give_back()

    return ordered_text(docs, n).mapInArrow(run, _PIECES + (", ids binary" if ids else ""))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 ids; see :func:`pack`."""
    return pack(table(spark, sf_dir, "documents"))
