"""Byte-level BPE ids of whole texts, as packed little-endian unsigned 32-bit integers.

The tokenizer splits text into words before it merges bytes, and it always parts
a blank or a line end between two characters that are no white space, and a mark
or digit behind a letter, from what is before.  So the texts of a slice are cut there,
the pieces are numbered by Arrow, and only the different ones are looked up: a
worker encodes every distinct piece once, as long as it stays in a cache of
bounded size.  The ids of the texts are then gathered by the pieces' numbers.
"""

from __future__ import annotations

import codecs
import gc
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tablepact.llm.common import kept

#: Pieces of one of the two generations one worker keeps (about 50 bytes each).
CACHE_PIECES = 550_000
#: Bytes of a key of that table: a piece padded with zeros, and its length.
KEY_BYTES = 24
#: Pieces too long for a key that are kept, in two generations as well (about 250 bytes each).
CACHE_LONG = 40_000
#: Still longer pieces are encoded each time.
LONG_PIECE = 64
#: Bytes of text whose pieces are numbered together.
PART_BYTES = 1 << 21

_LATIN = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_MARKS = bytes(b for b in range(33, 127) if b not in _LATIN)
#: One word of Latin letters, with the blank before it, as bytes.
_LETTERS = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
_BARE = re.compile(rb" ?[^\x00-\x20\x80-\xff]+")
_WORKER: dict[str, "WordTokenizer"] = kept()


def _flags(size: int, *on: int) -> np.ndarray:
    out = np.zeros(size, bool)
    out[list(on)] = True
    return out


_WHITE = [*range(9, 14), *range(28, 33)]
#: First two bytes of white space of two or three bytes (and of some other characters).
_WIDE = [0xC285, 0xC2A0, 0xE19A, 0xE280, 0xE281, 0xE380]
_MAY_PART = _flags(256, 10, 32, *_MARKS)
_WHITE_NEXT = _flags(1 << 16, *[w << 8 | b for w in _WHITE for b in range(256)], *_WIDE)
_WHITE_LAST = _flags(1 << 16, *[b << 8 | w for w in _WHITE for b in range(256)], *_WIDE[:2])
_WHITE_WIDE = _flags(1 << 16, *_WIDE[2:])
_LETTER_LAST = _flags(1 << 16, *[b << 8 | w for w in _LATIN for b in range(256)],
                      *[0xC3 << 8 | b for b in range(0x80, 0xC0) if b not in (0x97, 0xB7)])


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_characters() -> dict[int, str]:
    """The characters that stand for bytes in byte-level vocabularies, by the bytes as Latin-1 characters."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


#: Which bytes of a key belong to a piece of each length.
_OWN = np.arange(KEY_BYTES) < np.arange(KEY_BYTES)[:, None]


def _keys(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The keys, as rows of 64-bit words, of pieces shorter than a key."""
    if not len(starts):
        return np.zeros((0, KEY_BYTES // 8), np.uint64)
    padded = np.r_[raw, np.zeros(KEY_BYTES, np.uint8)]
    keys = np.lib.stride_tricks.sliding_window_view(padded, KEY_BYTES)[starts] * _OWN[lengths]
    keys[:, -1] = lengths
    return keys.view(np.uint64)


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions of all spans, one after the other."""
    out = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
    out += np.arange(len(out))
    return out


class Pieces:
    """The ids of at most ``most`` different pieces, found by their keys.

    Whole arrays of keys are looked up and added at once: a table of places, and
    keys and ids in the order they came, take a quarter of what a dictionary of
    byte strings does.
    """

    def __init__(self, most: int):
        self.most, self.n = most, 0
        self.bits = max(2 * most - 1, 1).bit_length()
        self.slots = np.zeros(1 << self.bits, np.int32)  # the entry's number from 1, or 0
        self.keys = np.empty((most, KEY_BYTES // 8), np.uint64)
        self.starts = np.zeros(most + 1, np.int64)
        self.ids = np.empty(1 << 10, np.uint32)

    def _places(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)
        for i in range(1, keys.shape[1]):
            mixed = (mixed ^ mixed >> np.uint64(32) ^ keys[:, i]) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry of every key, or -1."""
        out = np.full(len(keys), -1)
        left, at = np.arange(len(keys)), self._places(keys)
        while len(left):
            entry = self.slots[at] - 1
            left, at, entry = left[entry >= 0], at[entry >= 0], entry[entry >= 0]
            same = (self.keys[entry] == keys[left]).all(axis=1)
            out[left[same]] = entry[same]
            left, at = left[~same], at[~same] + 1 & len(self.slots) - 1
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        """Add different keys that are not there, as far as there is room; ``ids`` follow one another."""
        n = min(len(keys), self.most - self.n)
        keys, sizes = keys[:n], sizes[:n]
        begin, size = int(self.starts[self.n]), int(sizes.sum())
        if begin + size > len(self.ids):
            grown = np.empty(max(begin + size, len(self.ids) * 3 // 2), np.uint32)
            grown[:begin] = self.ids[:begin]
            self.ids = grown
        self.ids[begin:begin + size] = ids[:size]
        self.keys[self.n:self.n + n] = keys
        self.starts[self.n + 1:self.n + n + 1] = begin + np.cumsum(sizes)
        left, at = np.arange(self.n + 1, self.n + n + 1, dtype=np.int32), self._places(keys)
        while len(left):
            free = self.slots[at] == 0
            self.slots[at[free]] = left[free]  # of several that want one place the last one has it
            out = self.slots[at] != left
            left, at = left[out], at[out] + 1 & len(self.slots) - 1
        self.n += n

    def ids_of(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries, one after the other, and how many each has."""
        starts = self.starts[entries]
        sizes = self.starts[entries + 1] - starts
        return self.ids[_spans(starts, sizes)], sizes


class WordTokenizer:
    """Encodes with the tokenizers library, piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.tokenizer = Tokenizer.from_file(path)
        # What was met since the cache was full last, and what was met before that.
        self.cache = self.before = Pieces(0)
        # The same for pieces too long for a key.
        self.long: dict[bytes, bytes] = {}
        self.long_before: dict[bytes, bytes] = {}
        # A tokenizer that normalises, adds a blank, or joins words is not cut.
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        # Their texts stand for one id each, wherever they are found: a text that holds one is encoded whole.
        self.added = [t["content"] for t in spec.get("added_tokens") or ()]
        before = spec.get("pre_tokenizer") or {}
        self.cuts = (spec.get("normalizer") is None and before.get("type") == "ByteLevel"
                     and before.get("use_regex", True) and not before.get("add_prefix_space", True))
        line = self.tokenizer.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if self.cuts and len(line) == 1 else None
        # The same model for words whose bytes are written as the vocabulary writes them, one in a line.
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit("\n")
        written = _byte_characters() | {ord("\n"): "\n"}
        self.written = "".join(written[b] for b in range(256))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocabulary.values(), default=-1) + 1, np.int64)
        self.sizes[list(vocabulary.values())] = [*map(len, vocabulary)]

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, "<u4").tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def cut(self, raw: np.ndarray) -> np.ndarray:
        """Positions in texts that follow one another at which pieces may begin."""
        at = np.flatnonzero(_MAY_PART[raw])
        near = np.zeros(raw.size + 5, np.uint16)
        near[3:-2] = raw
        here, last, next_ = near[at + 3], near[at + 1] << 8 | near[at + 2], near[at + 4] << 8 | near[at + 5]
        blank = here <= 32
        between = ~(_WHITE_LAST[last] | _WHITE_WIDE[near[at] << 8 | near[at + 1]] | _WHITE_NEXT[next_])
        line = at[blank & between & (here == 10)] + 1
        return np.concatenate([at[np.where(blank, between, _LETTER_LAST[last])], line])

    def encode_array(self, texts: pa.Array) -> list[bytes]:
        """Packed ids of every text of a column without nulls, in order."""
        if not len(texts):
            return []
        if not self.cuts:
            return self.whole(texts.to_pylist())
        texts = texts.cast(pa.large_string())
        bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
        raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
        bounds = bounds - bounds[0]
        begins = np.zeros(raw.size + 1, bool)
        begins[self.cut(raw)] = True
        for token in self.added:
            for i in np.flatnonzero(pc.match_substring(texts, token).to_numpy(zero_copy_only=False)).tolist():
                begins[bounds[i]:bounds[i + 1]] = False
        begins[bounds] = True
        places = np.flatnonzero(begins)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(places) - 1,
                                       [None, pa.py_buffer(places), pa.py_buffer(raw)]).dictionary_encode()
        pool, sizes = self.ids_of(pieces.dictionary)
        which = pieces.indices.to_numpy()
        size = sizes[which]
        ends = np.r_[0, np.cumsum(size)]
        # Ids of a part are far fewer than 2^31, but those of one long text need not be.
        kind = np.int32 if max(ends[-1], pool.size) < 1 << 31 else np.int64
        places_in_pool = np.repeat(((np.cumsum(sizes) - sizes)[which] - ends[:-1]).astype(kind), size)
        places_in_pool += np.arange(ends[-1], dtype=kind)
        ids = pool[places_in_pool].tobytes()
        edges = (4 * ends[np.searchsorted(places, bounds)]).tolist()
        return [ids[a:b] for a, b in zip(edges, edges[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of every text, in order."""
        return self.encode_array(pa.array(texts, pa.large_string()))

    def ids_of(self, pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of different pieces, one after the other, and how many each has; from the cache or the tokenizer."""
        offsets = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset:pieces.offset + len(pieces) + 1]
        raw, lengths = np.frombuffer(pieces.buffers()[2] or b"", np.uint8), np.diff(offsets)
        short = np.flatnonzero(lengths < KEY_BYTES)
        keys = _keys(raw, offsets[short], lengths[short])
        entries = self.cache.find(keys)
        known = [(short[entries >= 0], *self.cache.ids_of(entries[entries >= 0]))]
        left = np.flatnonzero(entries < 0)
        entries = self.before.find(keys[left])
        again, left = left[entries >= 0], left[entries < 0]
        known.append((short[again], *self.before.ids_of(entries[entries >= 0])))
        new = short[left]
        known.append((new, *_joined([i for _, i in self._made(pieces.take(pa.array(new)).to_pylist())])))
        others = np.flatnonzero(lengths >= KEY_BYTES)
        known.append((others, *_joined(self._long_ids(pieces.take(pa.array(others)).to_pylist()))))
        for rows, (_, ids, size) in ((again, known[1]), (left, known[2])):
            if self.cache.n + len(rows) > self.cache.most:
                self.cache, self.before = Pieces(CACHE_PIECES), self.cache
            self.cache.add(keys[rows], ids, size)
        sizes = np.zeros(len(pieces), np.int64)
        for which, _, size in known:
            sizes[which] = size
        pool, starts = np.empty(sizes.sum(), np.uint32), np.cumsum(sizes) - sizes
        for which, ids, size in known:
            pool[_spans(starts[which], size)] = ids
        return pool, sizes

    def _long_ids(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of different pieces that are too long for a key."""
        if len(self.long) > CACHE_LONG:
            self.long, self.long_before = {}, self.long
        found = {p: self.long.get(p) or self.long_before.get(p) for p in pieces}
        found.update(self._made([p for p, value in found.items() if value is None]))
        self.long.update([(p, value) for p, value in found.items() if len(p) <= LONG_PIECE][:CACHE_LONG])
        return [*found.values()]

    def _made(self, pieces: list[bytes]) -> list[tuple[bytes, bytes]]:
        """Different pieces and their packed ids, in order, from the tokenizer."""
        made = dict(self.fresh(pieces))
        return [(p, made[p]) for p in pieces]

    def fresh(self, pieces: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
        """Pieces and their packed ids, from the tokenizer."""
        letters, blank, bare, others = [], [], [], []
        for piece in pieces:
            if _LETTERS.fullmatch(piece):
                letters.append(piece)
            elif self.line is None or not _BARE.fullmatch(piece):
                others.append(piece)
            else:
                (blank if piece[0] == 32 else bare).append(piece)
        for group in _groups(letters):
            text = codecs.charmap_decode(b"\n".join(group), "strict", self.written)[0]
            ids = np.asarray(self.words.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
            ends = np.cumsum([*map(len, group)])
            read = np.cumsum(self.sizes[ids])
            last = np.searchsorted(read, ends)
            if last[-1] != len(ids) - 1 or (read[last] != ends).any():  # ids that are not made of their bytes
                others += group
                continue
            yield from zip(group, _split(ids, (last + 1).tolist()), strict=True)
        for group in [*_groups(blank), *_groups(bare)]:
            # Several words as one text, each but the first behind a line end, which is a token of its own there.
            ids = np.asarray(self.tokenizer.encode_batch_fast(
                [b"\n".join(group).decode()], add_special_tokens=False)[0].ids, np.int64)
            line = ids == self.line
            if line.sum() != len(group) - 1:  # the line end's token is part of a word after all
                others += group
                continue
            ends = np.r_[np.flatnonzero(line), ids.size] - np.arange(len(group))
            yield from zip(group, _split(ids[~line], ends.tolist()), strict=True)
        for group in _groups(others):
            yield from zip(group, self.whole([piece.decode() for piece in group]), strict=True)


def _joined(packed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Packed ids one after the other, and how many there are of each."""
    return np.frombuffer(b"".join(packed), "<u4"), np.fromiter(map(len, packed), np.int64, len(packed)) >> 2


def _split(ids: np.ndarray, ends: list[int]) -> list[bytes]:
    """The packed ids up to each end."""
    packed = ids.astype("<u4").tobytes()
    return [packed[4 * a:4 * b] for a, b in zip([0, *ends], ends, strict=False)]


def _groups(pieces: list[bytes], size: int = 1024):
    for start in range(0, len(pieces), size):
        yield pieces[start:start + size]


def text_parts(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """Rows whose texts have about ``PART_BYTES`` bytes together, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
        part = (np.cumsum(sizes) - sizes) // PART_BYTES
        edges = [*np.flatnonzero(np.r_[True, part[1:] != part[:-1]][:batch.num_rows]).tolist(), batch.num_rows]
        for start, end in zip(edges, edges[1:], strict=False):
            yield batch.slice(start, end - start)


def worker_tokenizer(path: str) -> WordTokenizer:
    """The tokenizer of this worker process, with its cache.

    Nothing here makes cycles, so the collector need not walk the cache often.
    """
    if path not in _WORKER:
        gc.set_threshold(200_000, 50, 50)
        _WORKER[path] = WordTokenizer(path)
    return _WORKER[path]
