"""Token grammars, packing, sharding and segmentation against brute force."""

import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tablepact.llm import grammar, packing, segmentation, sharding
from tablepact.llm.tokens import WordTokenizer, default_tokenizer, text_parts, worker_tokenizer

from llm_samples import ODD_ROWS, odd_documents, sf_dir, whole_table


@pytest.fixture(scope="module")
def plain_ids():
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(default_tokenizer())

    def encode(text):
        return tokenizer.encode(text or "", add_special_tokens=False).ids
    return encode


def crc(ids):
    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("ab. \n\t \x1c　é,!1'")), max_size=20), max_size=6))
def test_pieces_give_the_ids_of_the_whole_text(texts):
    words = worker_tokenizer(default_tokenizer())
    assert words.encode(texts) == [np.asarray(words.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
                                   for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("abéß×'st. \n\t\r#|9_\x1c\x1f\x85\xa0\u1680\u2003\u200b\u2028\u202f\u3000Жя中😀")),
                        max_size=12), max_size=6))
def test_cuts_beside_odd_characters(texts):
    words = worker_tokenizer(default_tokenizer())
    assert words.encode(texts) == words.whole(texts)


def test_texts_of_a_slice_of_a_column():
    words = worker_tokenizer(default_tokenizer())
    texts = ["one two", "", "three\nfour <|endoftext|> five", " ", "six. ", "\nseven###", ""]
    for column in (pa.array(texts), pa.array(texts, pa.large_string())):
        assert words.encode_array(column.slice(1, 5)) == words.whole(texts[1:6])
        assert words.encode_array(column.slice(6)) == [b""] and words.encode_array(column.slice(7)) == []
    parts = [*text_parts(iter([pa.RecordBatch.from_arrays([pa.array(["x" * (1 << 20)] * 5)], names=["text"]),
                               pa.RecordBatch.from_arrays([pa.array([], pa.string())], names=["text"])]))]
    assert [p.num_rows for p in parts] == [2, 2, 1]


def test_a_word_is_encoded_once_whatever_is_behind_it():
    """Words with marks behind them were encoded anew for each of the marks (F1, F3)."""
    names = ["".join(p) for p in itertools.product(["an", "thé", "ou"], repeat=4)]
    text = " ".join(name + mark for mark in ("###", "***", "%%%", "|", "9") for name in names)
    words, given = WordTokenizer(default_tokenizer()), []

    class Counting:
        def __init__(self, tokenizer):
            self.tokenizer = tokenizer

        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    plain = words.whole([text])
    for name, value in list(vars(words).items()):
        if hasattr(value, "encode_batch_fast"):
            setattr(words, name, Counting(value))
    assert words.encode([text]) == plain
    assert sum(map(len, given)) < 2 * sum(len(name) + 1 for name in names)


def test_added_tokens_are_read_as_the_library_reads_them(plain_ids):
    words = worker_tokenizer(default_tokenizer())
    texts = ["a <|endoftext|> b. c", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "no <|endoftext| here", "two words"]
    assert words.encode(texts) == [np.asarray(plain_ids(t), "<u4").tobytes() for t in texts]
    assert 50256 in plain_ids(texts[0])


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr("tablepact.llm.tokens.CACHE_PIECES", 3)
    words = WordTokenizer(default_tokenizer())
    texts = ["one two three four", "five six seven one", "one two"]
    for text in texts:
        assert words.encode([text]) == words.whole([text])


def test_kept_pieces_take_little_memory(monkeypatch):
    """Dictionaries of byte strings took about 200 bytes for each piece a worker keeps."""
    monkeypatch.setattr("tablepact.llm.tokens.CACHE_PIECES", 50_000)
    words = WordTokenizer(default_tokenizer())
    text = " ".join("".join(p) for p in itertools.islice(itertools.product("aeioubdgst", repeat=6), 0, 800_000, 16))
    tracemalloc.start()
    first = words.encode([text])
    taken = tracemalloc.get_traced_memory()[0] - sum(map(len, first))
    tracemalloc.stop()
    assert first == words.whole([text]) and taken < 100 * 50_000
    monkeypatch.setattr(words, "fresh", lambda pieces: iter(zip(pieces, [b""] * len(pieces), strict=True)))
    assert words.encode([text]) == first


def test_pieces_of_all_lengths_from_a_small_cache(monkeypatch):
    monkeypatch.setattr("tablepact.llm.tokens.CACHE_PIECES", 7)
    monkeypatch.setattr("tablepact.llm.tokens.CACHE_LONG", 2)
    words = WordTokenizer(default_tokenizer())
    texts = ["x" * n for n in (1, 2, 22, 23, 24, 25, 63, 64, 65)] + ["a\0 a", "a a\0 \0", "Ж" * 12 + " " + "Ж" * 11, "é" * 40]
    for some in (texts, texts[::-1], [" ".join(texts)], *([t] for t in texts)):
        for _ in range(2):
            assert words.encode(some) == words.whole(some)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=400), st.integers(2, 6))
def test_grammar_expands_to_what_it_was_made_of(ids, least):
    ids = np.asarray(ids, np.uint32)
    rules, per_round, seq = grammar.compress(ids, 6, least)
    assert per_round.sum() == len(rules)
    assert grammar.expand(seq, rules, 6).tolist() == ids.tolist()
    lengths = grammar.lengths_of(rules, 6)
    assert grammar.expand_all(seq, rules, lengths, 6).tolist() == ids.tolist()
    assert lengths.tolist() == [len(grammar.expand(np.asarray([6 + i]), rules, 6)) for i in range(len(rules))]


def test_every_other_position_of_a_run():
    at = np.asarray([0, 1, 2, 3, 7, 9, 10, 20, 21, 22])
    assert at[grammar._alternating(at)].tolist() == [0, 2, 7, 9, 20, 22]
    assert grammar._alternating(at[:0]).tolist() == []


def test_rules_replace_frequent_pairs():
    ids = np.asarray([1, 2] * 500 + [3], np.uint32)
    rules, _, seq = grammar.compress(ids, 4)
    assert [1, 2] in rules.tolist() and len(seq) < 60


@pytest.mark.parametrize("copies", [20, 200])
def test_repeated_passages_end_as_few_symbols(copies):
    rng = np.random.default_rng(copies)
    passage = rng.integers(0, 30_000, 1000, dtype=np.uint32)
    ids = np.concatenate([np.r_[passage, rng.integers(30_000, 60_000, 2, dtype=np.uint32)] for _ in range(copies)])
    rules, _, seq = grammar.compress(ids, 60_000)
    assert grammar.expand(seq, rules, 60_000).tolist() == ids.tolist()
    assert len(rules) <= 1100 and len(seq) <= 4 * copies


def test_no_frequent_pair_is_left():
    rng = np.random.default_rng(7)
    ids = rng.zipf(1.3, 30_000).clip(0, 999).astype(np.uint32)
    rules, _, seq = grammar.compress(ids, 1000)
    assert grammar.expand(seq, rules, 1000).tolist() == ids.tolist()
    left = Counter(zip(seq[:-1].tolist(), seq[1:].tolist()))
    used = np.bincount(np.r_[seq, rules.ravel()].astype(int), minlength=1000 + len(rules))[1000:]
    assert max(n for (a, b), n in left.items() if a != b) < grammar.MIN_PAIRS
    assert 12 * len(rules) + 4 * len(seq) < 0.7 * 4 * len(ids) and (used > 0).all()


def test_the_least_id_is_no_null():
    block = grammar.Block(grammar.pack_block([None, -2 ** 63, 0], [b"\1\0\0\0"] * 3))
    assert block.doc_ids == [None, -2 ** 63, 0] and block.document(1).tolist() == [1]


def test_block_reads_single_documents(monkeypatch):
    monkeypatch.setattr(grammar, "SEGMENT_IDS", 64)
    docs = [np.arange(i % 7, dtype="<u4").repeat(i) for i in range(40)]
    block = grammar.Block(grammar.pack_block([None, *range(1, 40)], [d.tobytes() for d in docs]))
    assert block.doc_ids[0] is None
    for i, d in enumerate(docs):
        assert block.document(i).tolist() == d.tolist()


def test_op1_matches_plain_encoding(spark, plain_ids):
    rows = sorted(grammar.op1_grammar(spark, sf_dir()).collect(), key=lambda r: r["doc_id"])
    start = 0
    for row, doc in zip(rows, whole_table("documents", "doc_id"), strict=True):
        ids = [*plain_ids(doc["text"]), 2]
        assert (row["doc_id"], row["start"], row["n_tokens"], row["ids_crc32"]) == (
            doc["doc_id"], start, len(ids), crc(ids))
        start += len(ids)


def test_op1_odd_rows(spark, plain_ids, tmp_path):
    path = str(tmp_path / "blocks")
    grammar.encode_blocks(odd_documents(spark), path, end_id=2)
    blocks = spark.read.parquet(path)
    rows = grammar.with_starts(grammar.read_documents(spark, path), blocks.select("shard", "block", "n_tokens"))
    rows = sorted(rows.collect(), key=lambda r: r["start"])
    ordered = sorted(ODD_ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [(r["doc_id"], r["ids_crc32"]) for r in rows] == [(d, crc([*plain_ids(t), 2])) for d, t, *_ in ordered]
    empty = str(tmp_path / "none")
    grammar.encode_blocks(odd_documents(spark).limit(0), empty, end_id=2)
    assert grammar.read_documents(spark, empty).count() == 0


# --- packing -----------------------------------------------------------------------

def brute_cost(ends, costs, length):
    places = [0, *ends]
    best = [0.0] + [math.inf] * len(ends)
    for j in range(1, len(places)):
        for i in range(j):
            size = places[j] - places[i]
            if size <= length:
                pad = 0 if size & (size - 1) == 0 else length - size
                best[j] = min(best[j], best[i] + pad + costs[j - 1])
    return best[-1]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.integers(1, 9), min_size=1, max_size=5), min_size=1, max_size=8))
def test_cuts_are_the_best_ones(documents):
    documents = [np.cumsum(d).tolist() for d in documents]
    ends, costs = packing.possible_cuts(documents, 16)
    cuts = packing.best_cuts(ends, costs, 16)
    total, before, cost = 0, 0, dict(zip(ends, costs, strict=True))
    for cut in cuts:
        size = cut - before
        assert 0 < size <= 16
        total += (0 if size & (size - 1) == 0 else 16 - size) + cost[cut]
        before = cut
    assert before == sum(d[-1] for d in documents)
    assert total == brute_cost(ends, costs, 16)


def check_pieces(pieces, docs, encode):
    at, by_sequence = Counter(), {}
    for p in sorted(pieces, key=lambda p: (p["sequence_id"], p["offset"])):
        ids = encode(docs[p["doc_id"]])
        assert p["doc_tokens"] == len(ids) and p["start"] == at[p["doc_id"]]
        at[p["doc_id"]] += p["length"]
        assert p["ids_crc32"] == crc(ids[p["start"]:p["start"] + p["length"]])
        assert p["offset"] == by_sequence.get(p["sequence_id"], 0)
        by_sequence[p["sequence_id"]] = p["offset"] + p["length"]
    assert at == Counter({d: len(encode(t)) for d, t in docs.items()})
    assert max(by_sequence.values()) <= 2048
    return by_sequence.values()


def test_op8_pieces(spark, plain_ids):
    docs = {d["doc_id"]: d["text"] for d in whole_table("documents", "doc_id")}
    sizes = check_pieces(packing.op8_packing(spark, sf_dir()).collect(), docs, lambda t: [*plain_ids(t), 1])
    padded = sum(2048 - s for s in sizes if s & (s - 1))
    assert padded < 0.02 * sum(sizes)


def test_packing_odd_rows(spark, plain_ids):
    pieces = packing.pack(odd_documents(spark)).collect()
    assert sum(p["length"] for p in pieces) == sum(len(plain_ids(t)) + 1 for _, t, *_ in ODD_ROWS)
    assert packing.pack(odd_documents(spark).limit(0)).count() == 0


# --- sharding ----------------------------------------------------------------------

def brute_shard(key, tree):
    while tree.shard is None:
        if len(tree.children) == 1:
            tree = tree.children[0]
            continue
        def draw(child):
            # The engine's hash of several values chains them through the seed.
            h = xxhash.xxh64_intdigest(child.name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
            return -math.log(((h >> 11) + 0.5) * 2.0 ** -53) / child.total
        tree = min(tree.children, key=draw)
    return tree.shard


def test_op7_matches_brute_force(spark):
    rows = sharding.op7_sharding(spark, sf_dir()).collect()
    docs = {d["doc_id"]: d["text"] for d in whole_table("documents", "doc_id")}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        key = '{"doc_id":"%d"}' % r["doc_id"]
        data = (docs[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(data) + 1, zlib.crc32(data), "key")
        assert r["shard"] == brute_shard(key, sharding.layout(8))
        assert r["grown_shard"] == brute_shard(key, sharding.layout(9))
        assert r["grown_shard"] in (r["shard"], 8)
    for shard in range(8):
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))


def test_weight_change_moves_rows_only_through_its_subtree(spark):
    def tree(weight):
        return sharding.Node("root", children=(
            sharding.Node("a", children=(sharding.Node("a0", shard=0), sharding.Node("a1", weight, shard=1))),
            sharding.Node("b", children=(sharding.Node("b0", shard=2), sharding.Node("b1", shard=3)))))
    rows = sharding.with_shard(sharding.with_shard(spark.range(4000), ["id"], tree(1.0), "before"),
                               ["id"], tree(3.0), "after").collect()
    moved = [r for r in rows if r["before"] != r["after"]]
    assert moved and all(r["after"] in (0, 1) for r in moved)
    assert all(r["before"] == r["after"] for r in rows if r["after"] in (2, 3))
    share = Counter(r["after"] for r in rows)
    assert abs(share[1] / 4000 - 0.5) < 0.04


def test_sharding_odd_rows(spark):
    placed = sharding.with_shard(odd_documents(spark), ["doc_id"], sharding.layout(3))
    rows = sharding.with_slots(placed, "shard", ["doc_id", "text"], ["doc_id"]).collect()
    assert len(rows) == len(ODD_ROWS)
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.with_slots(placed.limit(0), "shard", ["doc_id"], ["doc_id"]).count() == 0


# --- segmentation --------------------------------------------------------------------

@pytest.fixture(scope="module")
def pieces():
    return segmentation.worker_pieces(segmentation.default_model())


def brute_sum(pieces, text):
    best = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        for i in range(max(0, j - pieces.reach), j):
            s = pieces.score.get(text[i:j], pieces.unknown if j - i == 1 else None)
            if s is not None:
                best[j] = max(best[j], best[i] + s)
    return best[-1]


@settings(max_examples=60, deadline=None)
@given(st.text(st.sampled_from(list("theran▁▁é☃.\n")), min_size=1, max_size=60), st.integers(3, 25))
def test_chunks_join_to_the_best_segmentation(text, chunk):
    pieces = segmentation.worker_pieces(segmentation.default_model())
    parts = [(text[i:i + chunk + pieces.reach - 1], min(chunk, len(text) - i)) for i in range(0, len(text), chunk)]
    matrices = [pieces.matrix(t, n) for t, n in parts]
    path = segmentation.states(matrices, 0, 0)
    made = [pieces.encode(t, n, a, b) for (t, n), a, b in zip(parts, path, path[1:], strict=False)]
    assert sum(m[0] for m in made) == brute_sum(pieces, text) == pieces.whole(text)[0]
    ids = np.frombuffer(b"".join(m[1] for m in made), "<u4").tolist()
    assert pieces.decode(ids) == text
    product = matrices[0]
    for m in matrices[1:]:
        product = segmentation.combined(product, m)
    assert product[0, 0] == brute_sum(pieces, text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(st.sampled_from(list("theraning▁▁é☃.\n中Ж,z9'$*")), max_size=70), min_size=1, max_size=5))
def test_units_join_to_the_trace_of_the_whole_text(texts):
    pieces = segmentation.worker_pieces(segmentation.default_model())
    ids, ends = pieces.runs(texts)
    for text, total, got in zip(texts, pieces.sums(ids, ends), np.split(ids, ends[:-1]), strict=True):
        assert (total, got.tolist()) == pieces.trace(text, 0, len(text), len(text))
    assert pieces.decoded(ids, ends) == [text.encode() for text in texts]


def test_new_words_are_segmented_together(monkeypatch):
    """Each word was searched by itself, and anew for every sign behind it (F2)."""
    names = ["▁" + "".join(p) for p in itertools.product(["an", "thé", "ou"], repeat=4)]
    text = "".join(name + mark for mark in ("", "☃", "\n") for name in names)
    calls, forward = [], segmentation.Pieces.forward
    monkeypatch.setattr(segmentation.Pieces, "forward", lambda *a: calls.append(a) or forward(*a))
    pieces = segmentation.Pieces(segmentation.default_model())
    total, ids = pieces.whole(text)
    assert total == brute_sum(pieces, text) and pieces.decode(np.frombuffer(ids, "<u4").tolist()) == text
    assert len(calls) < len(names) / 10


def test_never_worse_than_the_library(tmp_path, pieces):
    """The library's own search, told that the scores are those of a unigram model."""
    from sentencepiece import SentencePieceProcessor
    from sentencepiece import sentencepiece_model_pb2 as proto
    model = proto.ModelProto()
    with open(segmentation.default_model(), "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    compared = 0
    for doc in whole_table("documents", "doc_id")[:60]:
        # Single-precision sums of the library cannot tell paths apart beside an unknown character.
        text = "".join(c for c in " ".join((doc["text"] or "").split())[:300] if c == " " or c in pieces.score).strip()
        if not text or "  " in text:
            continue
        total, ids = pieces.whole("▁" + text.replace(" ", "▁"))
        theirs = sum(pieces.score[pieces.names[i]] for i in library.encode(text))
        assert theirs <= total <= 0.99 * theirs
        compared += 1
    assert compared > 20


def test_op4_round_trip_and_chunking(spark, pieces):
    docs = odd_documents(spark)
    rows = segmentation.encode(docs).collect()
    chunks = sum(max(1, -(-(len(t or "") + bool(t)) // segmentation.CHUNK)) for _, t, *_ in ODD_ROWS)
    assert len(rows) == chunks and all(r["restored"] for r in rows)
    small = segmentation.encode(docs, chunk=50).collect()
    def totals(some):
        out = Counter()
        for r in some:
            out[r["doc_id"]] += r["score"]
        return out
    assert totals(rows) == totals(small)
    for some in (rows, small):
        ids = b"".join(bytes(r["ids"]) for r in sorted(some, key=lambda r: r["start"]) if r["doc_id"] == 7)
        text = dict((d, t) for d, t, *_ in ODD_ROWS)[7]
        assert segmentation.decode_text(np.frombuffer(ids, "<u4").tolist(), segmentation.default_model()) == text
    assert segmentation.encode(docs.limit(0)).count() == 0


def test_op4_covers_the_table(spark):
    rows = segmentation.op4_segmentation(spark, sf_dir())
    assert rows.where("not restored").count() == 0
    assert rows.select("doc_id").distinct().count() == len(whole_table("documents", "doc_id"))


def test_places_of_a_segment_take_four_bytes():
    """Reading a segment needs few bytes for each id, beside the ids."""
    import tracemalloc
    ids = np.tile(np.arange(1, 65), 1 << 12).astype(np.uint32)
    rules, _, seq = grammar.compress(ids, 100)
    lengths = grammar.lengths_of(rules, 100)
    tracemalloc.start()
    try:
        out = grammar.expand_all(seq, rules, lengths, 100)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert (out == ids).all() and peak < 18 * ids.size
