"""Top-k search, hard negatives and conversation repair against brute force and SQL."""

import hashlib
import re
from itertools import product as every

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablepact.llm import conversation_repair as repair
from tablepact.llm import hard_negatives, topk_search, vectors

from llm_samples import sf_dir


def by_sql(sql):
    con = duckdb.connect()
    for name in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir()}/{name}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(r[i] for i in order) for r in found.fetchall()), key=repr)


def by_spark(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


NAN, INF = float("nan"), float("inf")
#: vec_id, embedding, label, and columns named like internal ones
VECTORS = [
    (0, [0.5, 0.25, -1.0], 1, 7), (50, [0.5, 0.25, -1.0], 1, 7), (50, [0.5, 0.25, -1.0], 1, 7), (100, [1.0, 1.0, 1.0], 2, 0),
    (None, [0.5, 0.25, -1.0], 1, None), (None, [9.0, 0.0, 0.0], 2, 1), (3, None, 1, 1), (4, [], 1, 1), (5, [0.5], 2, 1),
    (6, [0.5, None, 1.0], 1, 1), (8, [NAN, 0.0, 0.0], 1, 1), (9, [0.0, INF, 0.0], 1, 1), (10, [1e307, 0.0, 0.0], 1, 1),
    (11, [3e9, -3e9, 1.0], 2, 1), (12, [3e9, -3e9, 1.0], 1, 1), (14, [0.5, 0.5, -0.5], 0, 1), (200, [3e9, 1.0, 0.0], None, 1),
    (13, [0.001, -0.001, 0.3], 3, 1), (300, [0.6, 0.2, -0.9, 0.4], 1, 1), (15, [0.6, 0.2, -0.9, 0.4], 2, 1),
    *[(20 + i, [0.5, 0.25, -0.01 * i], i % 3, 1) for i in range(25)],
]


def odd_vectors(spark, rows=VECTORS):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, uid long").select(
        "*", F.col("uid").alias("id"), F.col("uid").alias("side"), F.col("uid").alias("cutoff"), F.col("uid").alias("vector"))


def whole(rows, need_label=False):
    """(row number, id, label, integer vector) of the rows that take part."""
    out = []
    for i, (vec_id, vector, label, _) in enumerate(rows):
        if vector is None or any(x is None or not np.isfinite(256.0 * x) for x in vector) or need_label and label is None:
            continue
        out.append((i, vec_id, label, [int(np.floor(256.0 * x)) for x in vector]))
    return out


def ranked(query, rows):
    scores = [(sum(a * b for a, b in zip(query[3], r[3])), r) for r in rows if r[0] != query[0]]
    return sorted(((min(max(s, -1 << 63), (1 << 63) - 1), r) for s, r in scores), key=lambda x: (-x[0], x[1][1] is None, x[1][1] or 0))


def test_products_are_exact_at_any_size():
    rng = np.random.default_rng(1)
    for size in (3, 1 << 11, 1 << 24, 1 << 45):
        a, b = (np.floor(rng.uniform(-size, size, (7, 5))) for _ in range(2))
        want = [[sum(int(x) * int(y) for x, y in zip(r, s)) for s in b] for r in a]
        assert vectors.product(a, b).astype(object).tolist() == want
    assert vectors.as_longs(np.array([[1 << 70, -(1 << 70)]], object)).tolist() == [[(1 << 63) - 1, -(1 << 63)]]


@pytest.mark.parametrize("rows", [VECTORS, VECTORS[:1], VECTORS[6:7], []])
def test_search_odd_rows(spark, rows):
    used = whole(rows)
    want = [(q[1], i + 1, s, r[1]) for q in used if q[1] is not None and q[1] % 50 == 0
            for i, (s, r) in enumerate(ranked(q, used)[:5])]
    got = topk_search.search(odd_vectors(spark, rows), lambda i: i % 50 == 0, 5)
    assert by_spark(got) == sorted(want, key=repr)


@pytest.mark.parametrize("lists", [1, 2, 5])
def test_search_in_many_tiles(spark, monkeypatch, lists):
    monkeypatch.setattr(vectors, "QUERY_VALUES", 200)
    monkeypatch.setattr(vectors, "TILE_ROWS", 40)
    rng = np.random.default_rng(lists)
    rows = [(i, [float(x) for x in rng.choice([-0.5, 0.0, 0.25, 0.5], 8)], 0, 0) for i in range(150)]
    used = whole(rows)
    want = [(q[1], i + 1, s, r[1]) for q in used if q[1] % 3 == 0 for i, (s, r) in enumerate(ranked(q, used)[:4])]
    got = topk_search.search(odd_vectors(spark, rows), lambda i: i % 3 == 0, 4, lists)
    assert by_spark(got) == sorted(want, key=repr)


def test_no_result_is_below_the_shares():
    rng = np.random.default_rng(0)
    c, q = np.floor(rng.normal(0, 40, (300, 16))), np.floor(rng.normal(0, 40, (20, 16)))
    parts, own = topk_search.partial_scores(c, q, 3), np.zeros((300, 20), bool)
    total = sum(parts)
    first = topk_search.gathered(parts, own, 5)
    for j in range(20):
        cutoff = sorted(total[first[first[:, 0] == j][:, 1], j])[-5]
        found = topk_search.collected(parts, own, np.full(20, np.ceil(cutoff / 3)))
        rows = found[found[:, 0] == j][:, 1]
        assert set(np.argsort(total[:, j])[-5:]) <= set(rows) and len(rows) < 300


def test_search_agrees_with_sql(spark):
    assert by_spark(topk_search.op13_topk_search(spark, sf_dir())) == by_sql(topk_search.SQL)


def mined(rows, positives, negatives, modulo):
    used = whole(rows, need_label=True)
    out = []
    for a in (r for r in used if r[1] is not None and r[1] % modulo == 0):
        others = ranked(a, used)
        for p_score, p in [x for x in others if x[1][2] == a[2]][:positives]:
            fit = [x for x in others if x[1][2] != a[2] and 30 * p_score <= 100 * x[0] <= 90 * p_score]
            out += [(a[1], p[1], i + 1, n[1], p_score, s) for i, (s, n) in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


def in_order(df):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


@pytest.mark.parametrize("rows", [VECTORS, VECTORS[:1], VECTORS[6:7], []])
def test_mining_odd_rows(spark, rows):
    got = hard_negatives.mine(odd_vectors(spark, rows), lambda i: i % 50 == 0, F.col("label"))
    assert in_order(got) == mined(rows, 5, 10, 50)


@pytest.mark.parametrize("levels", [(1,), (2, 8), (1, 2, 4)])
def test_mining_in_many_tiles(spark, monkeypatch, levels):
    monkeypatch.setattr(vectors, "QUERY_VALUES", 100)
    monkeypatch.setattr(vectors, "TILE_ROWS", 60)
    rng = np.random.default_rng(len(levels))
    centres = rng.normal(0, 1, (4, 10))
    rows = [(i, (centres[i % 4] + rng.normal(0, .3, 10)).tolist(), int(rng.integers(0, 4)), 0) for i in range(200)]
    got = hard_negatives.mine(odd_vectors(spark, rows), lambda i: i % 9 == 0, F.col("label"), 3, 4, levels=levels)
    assert in_order(got) == mined(rows, 3, 4, 9)


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 9), st.integers(0, 10 ** 6))
def test_summaries_bound_every_score(dims, seed):
    rng = np.random.default_rng(seed)
    c, q = np.floor(rng.normal(0, 99, (30, dims))), np.floor(rng.normal(0, 99, (5, dims)))
    levels = (1, 3, 7)

    def known(x):
        mean, deviation = hard_negatives.summary(x, levels[-1])
        import pyarrow as pa
        return hard_negatives.Summary.of(pa.RecordBatch.from_pydict({"means": list(mean), "deviations": list(deviation)}),
                                         dims, levels)
    scores = c @ q.T
    low = rng.normal(0, 9000, 5)
    high = low + abs(rng.normal(0, 9000, 5))
    left = hard_negatives.survivors(known(c), known(q), np.ones(scores.shape, bool), low, high)
    needed = np.argwhere((scores >= low) & (scores <= high))
    assert {*map(tuple, needed)} <= {*map(tuple, left)}
    assert hard_negatives.exact(c, q, left).tolist() == [int(scores[i, j]) for i, j in left]


def test_summaries_drop_pairs():
    import pyarrow as pa
    rng = np.random.default_rng(3)
    x = np.floor(np.repeat(rng.normal(0, 50, (400, 8)), 8, axis=1) + rng.normal(0, 2, (400, 64)))
    mean, deviation = hard_negatives.summary(x, 8)
    known = hard_negatives.Summary.of(pa.RecordBatch.from_pydict({"means": list(mean), "deviations": list(deviation)}), 64)
    scores = x @ x.T
    low = np.sort(scores, axis=0)[-5]
    left = hard_negatives.survivors(known, known, np.ones(scores.shape, bool), low, np.full(400, np.inf))
    assert len(left) < 0.1 * scores.size


def test_mining_agrees_with_sql(spark):
    assert by_spark(hard_negatives.op11_hard_negatives(spark, sf_dir())) == by_sql(hard_negatives.SQL)


# Conversations -----------------------------------------------------------------------------------

SYMBOLS = [repair.GONE, *[(letter, cut) for letter in "sua-" for cut in (False, True)]]


def cheapest(symbols):
    """(cost, letters) by a forward search that carries every best repair whole."""
    far = (1 << 40, "")
    states = ["", "s", "u", "a"]
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    best = {"": (0, ""), "s": far, "u": far, "a": far}

    def insert(now):
        for _ in range(3):
            for x in states:
                now[follow[x]] = min(now[follow[x]], (now[x][0] + 2, now[x][1] + "I"))
        return now

    best = insert(best)
    for letter, cut in symbols:
        new = {x: (best[x][0] + 3, best[x][1] + "D") for x in states}
        if (letter, cut) != repair.GONE:
            for x in states:
                c, a = best[x]
                new[follow[x]] = min(new[follow[x]], (c + 2 + cut, a + "R"))
                if letter == "s" and x == "" or letter in "ua" and follow[x] == letter:
                    new[letter] = min(new[letter], (c + cut, a + "K"))
        best = insert(new)
    return min(best[""], best["a"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(SYMBOLS), st.integers(1, 90)), max_size=6))
def test_runs_give_the_cheapest_first_letters(runs):
    symbols = [s for s, n in runs for _ in range(n)]
    runs = repair.runs_of(symbols)
    after, before = repair.costs_behind(runs, repair.END)
    letters, state = repair.unroll(runs, repair.START, after)
    assert (before[repair.START], "".join(letters) + repair.ending(state)) == cheapest(symbols)
    if runs:
        matrix = None
        for s, n in runs:
            matrix = repair.run_matrix(s, n) if matrix is None else repair.times(matrix, repair.run_matrix(s, n))
        assert repair.behind(matrix, repair.END) == before


def test_no_sequence_of_edits_is_cheaper():
    for symbols in every(SYMBOLS, repeat=2):
        found = set()
        for inserts in every(range(3), repeat=3):
            for edits in every("DKR", repeat=2):
                letters = "".join("I" * n + e for n, e in zip(inserts, [*edits, ""]))
                at, roles, cost, fine = 0, "", 0, True
                for x in letters:
                    if x == "I":
                        roles, cost = roles + "?", cost + 2
                        continue
                    letter, cut = symbols[at]
                    fine &= x == "D" or symbols[at] != repair.GONE
                    roles += {"D": "", "R": "?", "K": letter or "-"}[x]
                    cost += {"D": 3, "R": 2 + cut, "K": cut}[x]
                    at += 1
                options = (re.fullmatch("(s?(ua)+)?", "".join(w)) for w in every(*[x if x != "?" else "ua" for x in roles]))
                if fine and any(options):
                    found.add((cost, letters))
        assert min(found) == cheapest(symbols)


def plain(rows):
    """The contract of one conversation's rows, in order, one by one."""
    seen, symbols, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for turn, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        first = role[:1]
        symbols.append(repair.GONE if fault in ("blank", "duplicate")
                       else (first if first and first in "sua" else "-", fault == "truncated"))
    cost, audit = cheapest(symbols)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    lines, at, expected = [], 0, "u"
    for x in audit:
        role, text = ("", "") if x == "I" else rows[at][1:]
        at += x != "I"
        if x == "D":
            continue
        if x != "K":
            role = {"u": "user", "a": "assistant"}[expected]
        lines.append(f"{role}:{text}")
        expected = "a" if role[:1] == "u" else "u"
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit,
            "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}


def conversations():
    rng = np.random.default_rng(5)
    roles, texts = ["system", "user", "assistant", "user", "assistant", "tool", None, ""], [
        "Fine.", "cut", "", " \t\n", "Really?\n", "Fine.", "é☃!", None, "a.b", "\x1c", "long " * 500 + "."]
    rows = []
    for conv in [*range(12), None]:
        for i in range(int(rng.integers(1, 40)) if conv != 3 else 400):
            turn = None if rng.random() < 0.1 else int(i + 3 * (rng.random() < 0.1))
            rows.append((conv, turn, roles[rng.integers(len(roles))], texts[rng.integers(len(texts))], "x"))
    rows += [(77, 1, "user", "Same.", "x")] * 300
    return rows


COLUMNS = "conv_id long, turn long, role string, text string, part string"
CONTRACT = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def in_turns(spark, rows):
    """Rows of each conversation as they are taken, by turn and a hash of role and text."""
    own = spark.createDataFrame([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x, _ in rows],
                                "conv_id long, turn long, role string, text string")
    out = {}
    for r in own.withColumn("h", F.xxhash64("role", "text")).collect():
        out.setdefault(r["conv_id"], []).append(r)
    return {c: [(r["turn"], r["role"], r["text"])
                for r in sorted(found, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["h"]))]
            for c, found in out.items()}


@pytest.mark.parametrize("segment_rows", [repair.SEGMENT_ROWS, 1, 7])
def test_repair_in_segments(spark, segment_rows):
    rows = conversations()
    df = spark.createDataFrame(rows, COLUMNS)
    found = {r["conv_id"]: {k: r[k] for k in CONTRACT} for r in repair.digests(repair.repair(df, segment_rows)).collect()}
    assert found == {c: plain(own) for c, own in in_turns(spark, rows).items()}


def test_repaired_messages_are_sound(spark):
    df = spark.createDataFrame(conversations(), COLUMNS)
    found = {}
    for m in sorted(repair.messages(repair.repair(df, 7)).collect(), key=lambda m: (m["part"], m["seq"], m["place"])):
        found.setdefault(m["conv_id"], []).append(m["role"][:1])
    assert found and all(re.fullmatch("(s?(ua)+)?", "".join(x)) for x in found.values())


def test_empty_conversations(spark):
    assert repair.digests(repair.repair(spark.createDataFrame([], COLUMNS))).collect() == []


def test_damage(spark, tmp_path):
    rows = [(c, t, r, x, "p") for c, t, r, x, _ in conversations()]
    spark.createDataFrame(rows, COLUMNS).write.parquet(str(tmp_path / "conversations.parquet"))
    import zlib
    kept = []
    for c, t, r, x, p in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = {1: "", 2: re.sub("[.!?]", "", x)}.get(kind, x)
        kept += [(c, t, "user" if kind == 4 else r, x, p)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = {c: plain(own) for c, own in in_turns(spark, kept).items()}
    for c in {r[0] for r in rows} - set(want):
        want[c] = plain([])
    found = {r["conv_id"]: {k: r[k] for k in CONTRACT} for r in repair.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert found == want


def test_repair_agrees_with_sql(spark):
    assert by_spark(repair.op12_conversation_repair(spark, sf_dir())) == by_sql(repair.SQL)
