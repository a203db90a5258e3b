"""SentencePiece encoding as a max-plus parallel scan, and decoding.

The pieces of a model and their scores define the best segmentation of a text:
the one with the greatest sum of scores.  A giant document is cut into chunks.
A piece may reach over the end of a chunk by fewer characters than the longest
piece has, and that number is the state at the boundary.  Every chunk yields the
matrix of the best sums from each state before it to each state after it.
Matrices are combined in the max-plus algebra, which is associative: first
inside blocks of chunks, then over the blocks of a document.  This gives the
states at all boundaries, and with them every chunk is traced back on its own.

No piece of the usual models has a blank mark after another character, so a text
can always be cut before a word, and between two such cuts the best sum does not
depend on the states.  That is checked against the model; it makes the matrices
cheap.  Likewise a text can be cut between any two characters that are neighbours
in no piece.  The units between such cuts are numbered by Arrow, and a worker
segments each distinct unit once: all new ones of a slice together, by a walk
through the trie of the pieces from each of their characters.

The scores of a byte-pair model are the negated ranks of its merges; the best
segmentation by their sum is not the one its merges give, but is decoded alike.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import columns, kept, slices, table, written
from tablepact.llm.tokens import text_parts

#: Characters of a chunk, and chunks of a block.
CHUNK = 1 << 15
BLOCK = 64
#: Units of one of the two generations one worker keeps; longer ones are not kept, and segmented one by one.
CACHE_WORDS = 400_000
LONG_WORD = 64
#: New units of about the same length that are segmented together.
WORDS_AT_ONCE = 4096
#: What an unknown character costs more than the worst piece.
UNKNOWN_COST = 10.0
#: Longest piece that chunks allow for; a model with longer ones is refused.
REACH = 24

MARK = "▁"
_CUT = re.compile(f"(?<=[^{MARK}]){MARK}")
_WORKER: dict[str, "Pieces"] = kept()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces and scores of a model, and the best segmentations by them."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        usable = [i for i in range(len(self.names)) if not (
            model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.score = {self.names[i]: model.get_score(i) for i in usable}
        self.ids = {self.names[i]: i for i in usable}
        self.byte = [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte)}
        self.unknown = min(self.score.values()) - UNKNOWN_COST
        self.reach = max(map(len, self.score))
        if self.reach > REACH:
            raise ValueError(f"pieces of {self.reach} characters; at most {REACH} are allowed for")
        if any(_CUT.search(p) for p in self.score):
            raise ValueError("a piece holds a blank mark after another character")
        if model.encode("a  b ", out_type=str) and model.decode(model.encode("a  b ")) != "a  b ":
            raise ValueError("the model normalises its text")
        # Packed ids by units of UTF-32 characters: what was met since the cache was full last, and before that.
        self.words: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        # Numbers of the characters of pieces (0: of none), and which are neighbours in one.
        known = sorted({c for p in self.score for c in p})
        self.kind = np.zeros(0x110000, np.uint16 if len(known) < 0xFFFF else np.int32)
        self.kind[[*map(ord, known)]] = np.arange(1, len(known) + 1)
        self.kinds = len(known) + 1
        number = dict(zip(known, range(1, self.kinds), strict=True))
        self.beside = _Table({number[a] * self.kinds + number[b]: 1 for p in self.score for a, b in pairwise(p)})
        # The trie of the pieces: node 0 is its root, and -1 is nowhere.
        nodes, edges = {"": 0}, {}
        for piece in self.score:
            for end in range(1, len(piece) + 1):
                if piece[:end] not in nodes:
                    nodes[piece[:end]] = len(nodes)
                    edges[nodes[piece[:end - 1]] * self.kinds + number[piece[end - 1]]] = nodes[piece[:end]]
        self.trie = _Table(edges)
        self.node_score = np.full(len(nodes), -np.inf)
        self.node_id = np.zeros(len(nodes), np.int64)
        for piece, score in self.score.items():
            self.node_score[nodes[piece]], self.node_id[nodes[piece]] = score, self.ids[piece]
        # What an id adds to a sum and stands for; an unknown character counts with the first of its bytes.
        self.adds, texts = np.zeros(len(self.names)), [n.encode() for n in self.names]
        self.adds[list(self.ids.values())] = [self.score[p] for p in self.ids]
        for b, i in enumerate(self.byte):
            self.adds[i], texts[i] = 0.0 if b & 0xC0 == 0x80 else self.unknown, bytes([b])
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.places = np.cumsum(self.sizes) - self.sizes

    def pieces_at(self, text: str, i: int, end: int) -> list[tuple[int, float]]:
        """Ends and scores of the pieces that start at ``i``; one unknown character
        if no piece has just that character."""
        get, found = self.score.get, []
        for j in range(i + 1, min(i + self.reach, end) + 1):
            s = get(text[i:j])
            if s is not None:
                found.append((j, s))
        if not found or found[0][0] != i + 1:
            found.insert(0, (i + 1, self.unknown))
        return found

    def forward(self, text: str, start: int, size: int) -> tuple[list[float], list[int]]:
        """Best sums from ``start`` to every position and where the last piece began.

        Pieces start before ``size`` only; the text may go on behind.
        """
        low = float("-inf")
        best, come = [low] * (len(text) + 1), [-1] * (len(text) + 1)
        best[start] = 0.0
        for i in range(start, size):
            here = best[i]
            if here == low:
                continue
            for j, s in self.pieces_at(text, i, len(text)):
                if here + s > best[j]:
                    best[j], come[j] = here + s, i
        return best, come

    def trace(self, text: str, start: int, end: int, size: int) -> tuple[float, list[int]]:
        """Sum and ids of the best segmentation of ``text[start:end]`` whose last
        piece starts before ``size``."""
        best, come = self.forward(text, start, min(size, end))
        cuts, at = [], end
        while at > start:
            cuts.append((come[at], at))
            at = come[at]
        ids = []
        for a, b in reversed(cuts):
            piece = self.ids.get(text[a:b])
            ids += [piece] if piece is not None else [self.byte[x] for x in text[a:b].encode()]
        return best[end], ids

    def words_together(self, units: list[bytes]) -> list[bytes]:
        """Packed ids of units of at most ``LONG_WORD`` characters, as :meth:`trace` finds them."""
        sizes = np.fromiter(map(len, units), np.int64, len(units)) >> 2
        longest = int(sizes.max())
        kinds = np.zeros((longest, len(units)), np.int64)
        inside = np.arange(longest)[:, None] < sizes
        kinds.T[inside.T] = self.kind[np.frombuffer(b"".join(units), "<u4")]
        best = np.full((longest + 1, len(units)), -np.inf)
        come, ids = np.zeros(best.shape, np.int64), np.full(best.shape, -1)
        best[0] = 0.0
        for i in range(longest):
            at, node = np.flatnonzero(sizes > i), 0
            for j in range(i + 1, min(i + self.reach, longest) + 1):
                node = self.trie.get(node * self.kinds + kinds[j - 1, at])
                if j == i + 1:  # a character that is no piece
                    alone = np.where(node < 0, -np.inf, self.node_score[node])
                    odd = at[alone == -np.inf]
                    better = odd[best[i, odd] + self.unknown > best[j, odd]]
                    best[j, better], come[j, better], ids[j, better] = best[i, better] + self.unknown, i, -1
                there = np.flatnonzero(node >= 0)  # the kind 0 behind a unit leads nowhere
                at, node = at[there], node[there]
                if not at.size:
                    break
                sums = best[i, at] + self.node_score[node]
                more = np.flatnonzero(sums > best[j, at])
                better = at[more]
                best[j, better], come[j, better], ids[j, better] = sums[more], i, self.node_id[node[more]]
        # Back from the ends, all units at once.
        at, place, steps = np.arange(len(units)), sizes.copy(), []
        while at.size:
            steps.append((at, place, ids[place, at]))
            place = come[place, at]
            at, place = at[place > 0], place[place > 0]
        at, place, made = map(np.concatenate, zip(*steps, strict=True))
        made = made[np.lexsort((place, at))]
        unknown = np.unique(at[ids[place, at] < 0]).tolist()
        ends = np.cumsum(np.bincount(at, minlength=len(units))).tolist()
        packed = made.astype("<u4").tobytes()
        out = [packed[4 * a:4 * b] for a, b in zip([0, *ends], ends, strict=False)]
        for i in unknown:
            out[i] = self.word(units[i])
        return out

    def word(self, unit: bytes) -> bytes:
        """Packed ids of one unit."""
        text = unit.decode("utf-32-le")
        return np.asarray(self.trace(text, 0, len(text), len(text))[1], "<u4").tobytes()

    def ids_of(self, units: list[bytes]) -> list[bytes]:
        """Packed ids of different units, from the cache or the model."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.before = {}, self.words
        found = [*map(self.words.get, units)]
        kept, new = {}, []
        for i in [i for i, value in enumerate(found) if value is None]:
            value = self.before.get(units[i])
            if value is not None:
                found[i] = kept[units[i]] = value
            elif len(units[i]) <= 4 * LONG_WORD:
                new.append(i)
            else:
                found[i] = self.word(units[i])
        new.sort(key=lambda i: len(units[i]))
        for start in range(0, len(new), WORDS_AT_ONCE):
            group = new[start:start + WORDS_AT_ONCE]
            for i, ids in zip(group, self.words_together([units[i] for i in group]), strict=True):
                found[i] = kept[units[i]] = ids
        self.words.update(kept)
        return found

    def runs(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that start and end at cuts, and where those of each text end."""
        raw = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        bounds = np.cumsum([0, *map(len, texts)])
        kinds = self.kind[raw].astype(np.int64)
        begins = np.ones(raw.size + 1, bool)
        begins[1:-1] = self.beside.get(kinds[:-1] * self.kinds + kinds[1:]) < 0
        begins[bounds] = True
        places = np.flatnonzero(begins)
        units = pa.Array.from_buffers(pa.large_binary(), len(places) - 1,
                                      [None, pa.py_buffer(4 * places), pa.py_buffer(raw)]).dictionary_encode()
        found = self.ids_of(units.dictionary.to_numpy(zero_copy_only=False).tolist())
        pool = np.frombuffer(b"".join(found), "<u4")
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        which = units.indices.to_numpy()
        ids, ends = _gathered(pool, np.cumsum(sizes) - sizes, sizes, which)
        return ids, np.r_[0, ends][np.searchsorted(places, bounds[1:])]

    def sums(self, ids: np.ndarray, ends: np.ndarray) -> list[float]:
        """Sums of the scores of ids up to each end."""
        scores = self.adds[ids]
        return [float(scores[a:b].sum()) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]

    def run(self, text: str) -> tuple[float, bytes]:
        """Sum and packed ids of a text that starts and ends at cuts."""
        ids, ends = self.runs([text])
        return self.sums(ids, ends)[0], ids.tobytes()

    def decoded(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes in UTF-8 that the ids up to each end stand for."""
        out, stops = _gathered(self.bytes, self.places, self.sizes, ids)
        raw, stops = out.tobytes(), np.r_[0, stops][ends].tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    # --- chunks -----------------------------------------------------------------

    def cuts(self, text: str, size: int) -> tuple[int, int] | None:
        """First and last cut in a chunk, its end included, its start not."""
        first = _CUT.search(text, 0, len(text))
        if first is None or first.start() > size:
            return None
        at = size
        while not (at < len(text) and text[at] == MARK and text[at - 1] != MARK):
            at -= 1
        return first.start(), at

    def matrix(self, text: str, size: int) -> np.ndarray:
        """Best sums from each state before the chunk to each state after it.

        ``text`` is the chunk's ``size`` characters and up to ``reach - 1`` more.
        """
        n = self.reach
        out = np.full((n, n), -np.inf)
        between = self.cuts(text, size)
        if between is None:
            for s in range(min(n, size + 1)):
                best, _ = self.forward(text, s, size)
                out[s, :len(text) - size + 1] = best[size:size + n]
            for s in range(size, min(n, len(text) + 1)):  # a piece that covers the whole chunk
                out[s, s - size] = 0.0
            return out
        first, last = between
        before = np.full(n, -np.inf)
        head = text[:first]
        for s in range(min(n, first + 1)):
            before[s] = self.forward(head, s, first)[0][first] if s < first else 0.0
        middle = self.run(text[first:last])[0] if first < last else 0.0
        after = np.full(n, -np.inf)
        tail = self.forward(text[last:], 0, size - last)[0][size - last:] if last < size else [0.0]
        after[:min(n, len(tail))] = tail[:n]
        return before[:, None] + middle + after[None, :]

    def encode(self, text: str, size: int, entry: int, leave: int) -> tuple[float, bytes]:
        """Sum and packed ids of a chunk between given states."""
        between = self.cuts(text, size)
        if entry >= size + leave:
            return 0.0, b""
        if between is None:
            if entry == leave == 0 and size == len(text):
                return self.run(text)
            total, ids = self.trace(text[:size + leave], entry, size + leave, size)
            return total, np.asarray(ids, "<u4").tobytes()
        first, last = between
        total, out = 0.0, []
        if entry < first:
            part, ids = self.trace(text[:first], entry, first, first)
            total, out = total + part, [np.asarray(ids, "<u4").tobytes()]
        if first < last:
            part, ids = self.run(text[first:last])
            total, out = total + part, [*out, ids]
        if last < size + leave:
            part, ids = self.trace(text[last:size + leave], 0, size + leave - last, size - last)
            total, out = total + part, [*out, np.asarray(ids, "<u4").tobytes()]
        return total, b"".join(out)

    def whole(self, text: str) -> tuple[float, bytes]:
        """Sum and packed ids of a normalised text in one piece."""
        return self.run(text)

    def decode(self, ids) -> str:
        """The normalised text of ids; bytes that are no text become marks of an error."""
        out, raw = [], bytearray()
        for i in ids:
            byte = self.byte_of.get(i)
            if byte is not None:
                raw.append(byte)
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(self.names[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)


class _Table:
    """Numbers by numbers that are not negative, looked up for whole arrays; -1 where there is none."""

    def __init__(self, entries: dict[int, int]):
        self.bits = max(int(4 * len(entries)).bit_length(), 4)
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, -1, np.int32)
        places = self.place(np.asarray([*entries], np.int64)).tolist()
        for (key, value), at in zip(entries.items(), places, strict=True):
            while self.keys[at] >= 0:
                at = (at + 1) % (1 << self.bits)
            self.keys[at], self.values[at] = key, value

    def place(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.place(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], -1)
        left = np.flatnonzero((held != keys) & (held >= 0))
        while left.size:
            at[left] = (at[left] + 1) % (1 << self.bits)
            held = self.keys[at[left]]
            same = held == keys[left]
            out[left[same]] = self.values[at[left[same]]]
            left = left[~same & (held >= 0)]
        return out


def _gathered(pool: np.ndarray, starts: np.ndarray, sizes: np.ndarray,
              which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of a pool that numbers stand for, one after the other, and their ends."""
    size = sizes[which]
    ends = np.cumsum(size)
    places = np.repeat(starts[which] - (ends - size), size)
    places += np.arange(places.size)
    return pool[places], ends


def worker_pieces(path: str) -> Pieces:
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


def decode_text(ids, path: str) -> str:
    """The text that a whole document's ids stand for."""
    text = worker_pieces(path).decode(ids)
    return text[1:].replace(MARK, " ") if text else ""


# --- max-plus algebra --------------------------------------------------------------

def combined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product; associative."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def states(matrices: list[np.ndarray], entry: int, leave: int) -> list[int]:
    """States at all boundaries, ``entry`` and ``leave`` included, of a best path."""
    value = np.full(len(matrices[0]), -np.inf)
    value[entry] = 0.0
    come = []
    for m in matrices:
        sums = value[:, None] + m
        come.append(sums.argmax(axis=0))
        value = sums.max(axis=0)
    path = [leave]
    for back in reversed(come):
        path.append(int(back[path[-1]]))
    return path[::-1]


def _unpacked(values) -> list[np.ndarray]:
    out = [np.frombuffer(v) for v in values]
    return [v.reshape(round(len(v) ** 0.5), -1) for v in out]


# --- Spark -------------------------------------------------------------------------

_OUT = "doc_id long, chunk int, start long, n_chars long, score double, ids binary, restored boolean"


def encode(docs: DataFrame, model: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """Ids of all texts: one row per document and chunk.

    ``start`` and ``n_chars`` give the chunk's place in the normalised text (a
    blank mark in front, and one for every blank), ``ids`` are packed unsigned
    32-bit integers, and ``restored`` tells whether they decode to what they
    stand for.  A null text is empty; an empty text has one chunk without ids.
    Repeated rows give repeated results; an empty table gives none; other columns
    are ignored.
    """
    path = model or default_model()
    text = F.coalesce(F.col("text"), F.lit(""))
    normal = F.when(text == "", "").otherwise(F.concat(F.lit(MARK), F.translate(text, " ", MARK)))
    own = columns(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), normal.alias("_text"))
    short = own.where(F.length("_text") <= chunk).select(
        "doc_id", F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("start"),
        F.length("_text").alias("size"), F.col("_text").alias("text"), F.lit(0).alias("entry"), F.lit(0).alias("leave"))

    # Written once, so that row numbers and chunks stay the same.
    giant = written(
        own.where(F.length("_text") > chunk).withColumn("_row", F.monotonically_increasing_id())
        .select("doc_id", "_row", "_text", F.explode(F.sequence(
            F.lit(0), F.floor((F.length("_text") - 1) / chunk).cast("int"))).alias("chunk"))
        .select("doc_id", "_row", "chunk", (F.col("chunk").cast("long") * chunk).alias("start"),
                F.least(F.lit(chunk), F.length("_text") - F.col("chunk") * chunk).alias("size"),
                F.substr("_text", F.col("chunk") * chunk + 1, F.lit(chunk + REACH - 1)).alias("text")),
        "text-chunks")

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path)
        for part in slices(batches, 64):
            pieces.runs(part["text"])  # all new units at once; they are looked up below
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["_row"], pa.int64()), pa.array(part["chunk"], pa.int32()),
                 pa.array([pieces.matrix(t[:n + pieces.reach - 1], n).tobytes()
                           for t, n in zip(part["text"], part["size"], strict=True)], pa.binary())],
                names=["_row", "chunk", "matrix"])

    matrices = giant.select("_row", "chunk", "size", "text").mapInArrow(
        transfer, "_row long, chunk int, matrix binary").withColumn("_block", F.floor(F.col("chunk") / BLOCK).cast("int"))
    matrices = written(matrices, "transfer-matrices")

    def product(group: pd.DataFrame) -> pd.DataFrame:
        out = None
        for m in _unpacked(group.sort_values("chunk")["matrix"]):
            out = m if out is None else combined(out, m)
        return pd.DataFrame({"_row": group["_row"][:1], "_block": group["_block"][:1], "matrix": [out.tobytes()]})

    def bounds(key: str):
        """States before and after each part of a group, whose own ends are given or 0."""
        def solve(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values(key)
            path_ = states(_unpacked(group["matrix"]), int(group["entry"].iloc[0]), int(group["leave"].iloc[-1]))
            return pd.DataFrame({"_row": group["_row"], key: group[key], "entry": path_[:-1], "leave": path_[1:]})
        return solve

    blocks = matrices.groupBy("_row", "_block").applyInPandas(product, "_row long, _block int, matrix binary")
    ends = (blocks.withColumn("entry", F.lit(0)).withColumn("leave", F.lit(0)).groupBy("_row")
            .applyInPandas(bounds("_block"), "_row long, _block int, entry int, leave int"))
    inner = (matrices.join(ends, ["_row", "_block"]).groupBy("_row", "_block")
             .applyInPandas(bounds("chunk"), "_row long, chunk int, entry int, leave int"))
    long = giant.join(inner, ["_row", "chunk"]).select(*short.columns)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path)
        for rows in text_parts(batches):
            part = {name: rows.column(i).to_pylist() for i, name in enumerate(rows.schema.names)}
            cut = [t[:n + pieces.reach - 1] for t, n in zip(part["text"], part["size"], strict=True)]
            ids, ends = pieces.runs(cut)
            made = [*zip(pieces.sums(ids, ends), np.split(ids, ends[:-1]), strict=True)]
            # Parts of texts: the units of their own stretch were looked up with the others.
            for i in [i for i, (t, n, a, b) in enumerate(zip(cut, part["size"], part["entry"], part["leave"],
                                                             strict=True)) if a or b or n < len(t)]:
                total, packed = pieces.encode(cut[i], part["size"][i], part["entry"][i], part["leave"][i])
                made[i] = total, np.frombuffer(packed, "<u4")
            ids = np.concatenate([m[1] for m in made])
            ends = np.cumsum([len(m[1]) for m in made])
            same = [found == t[a:n + b].encode() for found, t, n, a, b in zip(
                pieces.decoded(ids, ends), part["text"], part["size"], part["entry"], part["leave"], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part["doc_id"], pa.int64()), pa.array(part["chunk"], pa.int32()),
                 pa.array(part["start"], pa.int64()), pa.array(part["size"], pa.int64()),
                 pa.array([m[0] for m in made], pa.float64()), pa.array([m[1].tobytes() for m in made], pa.binary()),
                 pa.array(same, pa.bool_())],
                names=["doc_id", "chunk", "start", "n_chars", "score", "ids", "restored"])

    return short.unionByName(long).mapInArrow(trace, _OUT)


def op4_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded: number and checksum of the ids of every chunk, the sum
    of their scores, and whether they decode to the text; see :func:`encode`."""
    return encode(table(spark, sf_dir, "documents")).select(
        "doc_id", "chunk", "start", "n_chars", F.floor(F.octet_length("ids") / 4).alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"), "score", "restored")
