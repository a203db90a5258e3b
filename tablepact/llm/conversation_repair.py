"""Repair of a conversation's structure by a run-length dynamic programme.

A sound conversation is ``(s?(ua)+)?`` in the first letters of its roles.  Rows
are kept, given another role or deleted and empty ones inserted, at least cost;
among the cheapest repairs the one whose letters (``D I K R``) come first in the
alphabet is taken.  The states are those of the pattern: nothing yet, after the
system row, after a user row, after an assistant row.

Rows become symbols of role and fault, and equal neighbours one run.  What a run
does to the costs of the states is a power of its symbol's min-plus matrix; the
powers of two are cached, so that a run of ``n`` rows takes ``log n`` steps.
From the costs behind each run the letters are then unrolled forwards.

The rows are ranged by conversation and turn.  A conversation inside one range
is repaired there.  One that crosses ranges, or is long, is cut into segments:
each gives a matrix, the few numbers of all segments are swept back for the
costs behind each, the segments are unrolled on their own for every state they
may be entered in, and one more sweep finds the state they are.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from hashlib import blake2b, sha256
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablepact.llm.common import partitions, slices, table, written

#: A longer stretch of one conversation is cut into segments.
SEGMENT_ROWS = 16_384
SEGMENT_CHARS = 1 << 22

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
_FAR = 1 << 60
#: The state an inserted or renamed row leads to.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: The states a kept row leads to, by the first letter of its role.
_KEPT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The symbol of a row that has to go; others are the role's first letter and whether it is truncated.
GONE = ("", False)
_WHITE = " \t\n\x0b\x0c\r"
_ORDERLY = {"su", "ua", "au"}

Costs = tuple[int, int, int, int]
Matrix = tuple[Costs, Costs, Costs, Costs]


def times(a: Matrix, b: Matrix) -> Matrix:
    """Min-plus product."""
    return tuple(tuple(min(min(x + y for x, y in zip(row, column, strict=True)), _FAR)
                       for column in zip(*b, strict=True)) for row in a)


def behind(m: Matrix, costs: Costs) -> Costs:
    """Costs before a stretch from those behind it."""
    return tuple(min(x + y for x, y in zip(row, costs, strict=True)) for row in m)


@cache
def step(symbol: tuple[str, bool]) -> Matrix:
    """What one row costs between any two states, rows inserted before it included."""
    letter, truncated = symbol
    own = [[_FAR] * 4 for _ in range(4)]
    for state in range(4):
        own[state][state] = DELETE
        if symbol != GONE:
            own[state][_NEXT[state]] = min(own[state][_NEXT[state]], REROLE + truncated * TRUNCATED)
            if (after := _KEPT.get(letter, {}).get(state)) is not None:
                own[state][after] = min(own[state][after], KEEP + truncated * TRUNCATED)
    once = tuple(tuple(0 if i == j else INSERT if _NEXT[i] == j else _FAR for j in range(4)) for i in range(4))
    return times(times(times(once, once), once), tuple(map(tuple, own)))


@cache
def power(symbol: tuple[str, bool], k: int) -> Matrix:
    """The matrix of ``2 ** k`` equal rows."""
    return step(symbol) if k == 0 else times(power(symbol, k - 1), power(symbol, k - 1))


def run_matrix(symbol: tuple[str, bool], n: int) -> Matrix:
    out = None
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = power(symbol, k) if out is None else times(out, power(symbol, k))
    return out


#: At the end a user row or a system row alone has to be answered.
END: Costs = (0, 2 * INSERT, INSERT, 0)


@cache
def before_power(symbol: tuple[str, bool], k: int, costs: Costs) -> tuple[Costs, int]:
    """Costs before ``2 ** k`` equal rows less the least of them, and the least; few differ, so they are cached."""
    before = behind(power(symbol, k), costs)
    return tuple(c - min(before) for c in before), min(before)


def before_run(symbol: tuple[str, bool], n: int, costs: Costs) -> tuple[Costs, int]:
    """Costs before ``n`` equal rows from those behind them, the least of which is 0; and the least."""
    low = 0
    for k in range(n.bit_length()):
        if n >> k & 1:
            costs, more = before_power(symbol, k, costs)
            low += more
    return costs, low


@cache
def choice(symbol: tuple[str, bool], state: int, costs: Costs) -> tuple[str, int]:
    """The letters of one row (with those inserted before it) and the state behind it."""
    here = behind(step(symbol), costs)
    letter, truncated = symbol
    out = ""
    while True:
        if DELETE + costs[state] == here[state]:
            return out + "D", state
        if INSERT + here[_NEXT[state]] == here[state]:
            out, state = out + "I", _NEXT[state]
            continue
        kept = _KEPT.get(letter, {}).get(state) if symbol != GONE else None
        if kept is not None and KEEP + truncated * TRUNCATED + costs[kept] == here[state]:
            return out + "K", kept
        return out + "R", _NEXT[state]


def unroll_run(symbol: tuple[str, bool], n: int, state: int, costs: Costs) -> tuple[list[str], int]:
    """The letters of ``n`` equal rows entered in ``state``; the costs behind halves come from the powers."""
    if n <= 32:
        after = [costs]
        for _ in range(n - 1):
            after.append(before_power(symbol, 0, after[-1])[0])
        out = []
        for c in reversed(after):
            letters, state = choice(symbol, state, c)
            out.append(letters)
        return out, state
    k = (n - 1).bit_length() - 1
    first, state = unroll_run(symbol, n - (1 << k), state, before_power(symbol, k, costs)[0])
    rest, state = unroll_run(symbol, 1 << k, state, costs)
    return first + rest, state


Runs = list[tuple[tuple[str, bool], int]]


def runs_of(symbols: Iterable[tuple[str, bool]]) -> Runs:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def costs_behind(runs: Runs, costs: Costs) -> tuple[list[Costs], Costs]:
    """Costs behind each run, the least of which is 0, and the costs before all of them."""
    after, total = [], 0
    for symbol, n in reversed(runs):
        after.append(costs)
        costs, low = before_run(symbol, n, costs)
        total += low
    return after[::-1], tuple(c + total for c in costs)


def unroll(runs: Runs, state: int, after: list[Costs]) -> tuple[list[str], int]:
    """The letters of each row of a stretch entered in ``state``, given the costs behind each run; and the last state."""
    out = []
    for (symbol, n), c in zip(runs, after, strict=True):
        letters, state = unroll_run(symbol, n, state, c)
        out += letters
    return out, state


def ending(state: int) -> str:
    """Rows inserted at the end of a conversation."""
    return {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}[state]


def rebuilt(roles: list[str], texts: list[str], letters: str) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits.  Where a row goes is told by what stands before it, save for the very first."""
    return _rebuilt(roles, texts, letters, START)


def _rebuilt(roles, texts, letters, state):
    out_roles, out_texts, at = [], [], 0
    for letter in letters:
        if letter == "D":
            at += 1
            continue
        if letter == "K":
            state = _KEPT[roles[at][0]][state]
            out_roles.append(roles[at])
        else:
            state = _NEXT[state]
            out_roles.append("user" if state == USER else "assistant")
        out_texts.append("" if letter == "I" else texts[at])
        at += letter != "I"
    return out_roles, out_texts


def digest(role: str, text: str) -> bytes:
    return blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()


class Faults:
    """Symbols and counts of a stretch of rows."""

    def __init__(self, roles: list[str], texts: list[str], turns: list[int | None], seen: set[bytes]):
        self.blank = self.duplicate = self.truncated = 0
        symbols = []
        for role, text in zip(roles, texts, strict=True):
            own, bare = digest(role, text), text.strip(_WHITE)
            if not bare:
                self.blank += 1
                symbols.append(GONE)
            elif own in seen:
                self.duplicate += 1
                symbols.append(GONE)
            else:
                cut = bare[-1] not in ".!?"
                self.truncated += cut
                symbols.append((role[:1] if role[:1] in _KEPT else "-", cut))
            seen.add(own)
        self.runs = runs_of(symbols)
        letters = [r[:1] for r in roles]
        self.first, self.last = letters[0], letters[-1]
        self.illegal = sum(a + b not in _ORDERLY for a, b in zip(letters, letters[1:]))
        known = [t for t in turns if t is not None]
        self.low, self.high = (known[0], known[-1]) if known else (None, None)
        self.turns = len(set(known))


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
_SEGMENT = f"conv_id long, part int, seq long, pieces int, {_RESULT}, audit string, roles array<string>, texts array<string>"
_RAW = f"{_SEGMENT}, turns array<long>, digests array<binary>"


def _arrow(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(),
             "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64()),
             "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary())}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in ddl.split(", "))])


def _segments(rows: DataFrame, segment_rows: int, segment_chars: int) -> DataFrame:
    """One row per conversation inside a range, repaired; raw segments of the others."""
    schema = _schema(_RAW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        out, held, chars, seq, cut, at_border, now = [], [], 0, 0, False, True, None

        def segment():
            nonlocal seq
            turns, roles, texts = (list(c) for c in zip(*held, strict=True))
            row = {"conv_id": now, "part": part, "seq": seq, "turns": turns, "roles": roles, "texts": texts,
                   "digests": [digest(r, t) for r, t in zip(roles, texts, strict=True)]}
            seq += 1
            return row

        def whole():
            nonlocal seq
            turns, roles, texts = (list(c) for c in zip(*held, strict=True))
            found = Faults(roles, texts, turns, set())
            after, costs = costs_behind(found.runs, END)
            letters, state = unroll(found.runs, START, after)
            audit = "".join(letters) + ending(state)
            new_roles, new_texts = rebuilt(roles, texts, audit)
            gaps = found.high - found.low + 1 - found.turns if found.low is not None else 0
            row = {"conv_id": now, "part": part, "seq": seq, "pieces": 1, "gaps": gaps, "blank": found.blank,
                   "duplicate": found.duplicate, "truncated": found.truncated, "illegal": found.illegal,
                   "cost": costs[START], "audit": audit, "roles": new_roles, "texts": new_texts}
            seq += 1
            return row

        for columns in slices(batches):
            for conv, turn, role, text in zip(columns["conv_id"], columns["turn"], columns["role"], columns["text"],
                                              strict=True):
                if held and conv != now:
                    # The first conversation of a range may have begun in an earlier one.
                    out.append(segment() if cut or at_border else whole())
                    held, chars, cut, at_border = [], 0, False, False
                elif len(held) >= segment_rows or chars > segment_chars:
                    out.append(segment())
                    held, chars, cut = [], 0, True
                now = conv
                held.append((turn, role, text))
                chars += len(text)
                if len(out) >= 64 or out and chars > segment_chars:
                    yield _arrow(out, schema)
                    out = []
        if held:  # the last one may go on in the next range
            out.append(segment())
        if out:
            yield _arrow(out, schema)

    return rows.mapInArrow(run, _RAW)


_MARKED = ("part int, seq long, conv_id long, blank long, duplicate long, truncated long, illegal long, first string, "
           "last string, low long, high long, turns long, matrix array<long>, letters array<string>, cut array<int>, "
           "lengths array<long>")


def _marked(split: DataFrame) -> DataFrame:
    """Counts, matrix and runs of every segment, given the digests met in earlier ones."""
    schema = _schema(_MARKED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in slices(batches, 1):
            roles, texts, turns = c["roles"][0], c["texts"][0], c["turns"][0]
            found = Faults(roles, texts, turns, set(c["earlier"][0] or ()))
            matrix = None
            for symbol, n in found.runs:
                own = run_matrix(symbol, n)
                matrix = own if matrix is None else times(matrix, own)
            yield _arrow([{
                "part": c["part"][0], "seq": c["seq"][0], "conv_id": c["conv_id"][0],
                **{k: getattr(found, k) for k in ("blank", "duplicate", "truncated", "illegal", "first", "last", "low",
                                                  "high", "turns")},
                "matrix": [x for row in matrix for x in row], "letters": [s[0] for s, _ in found.runs],
                "cut": [int(s[1]) for s, _ in found.runs], "lengths": [n for _, n in found.runs]}], schema)

    return split.mapInArrow(run, _MARKED)


def _in_order(rows: pa.Table) -> list[dict]:
    return sorted(rows.to_pylist(), key=lambda r: (r["part"], r["seq"]))


_SWEPT = f"part int, seq long, after array<long>, pieces int, {_RESULT}"


def _swept_back(marked: DataFrame) -> DataFrame:
    """Costs behind each segment; the conversation's totals beside its first one."""
    schema = _schema(_SWEPT)

    def sweep(rows: pa.Table) -> pa.Table:
        segments, costs, out = _in_order(rows), END, []
        for s in reversed(segments):
            low, m = min(costs), s["matrix"]
            out.append({"part": s["part"], "seq": s["seq"], "after": [c - low for c in costs], "pieces": len(segments)})
            costs = behind(tuple(tuple(m[i:i + 4]) for i in range(0, 16, 4)), costs)
        totals = {k: sum(s[k] for s in segments) for k in ("blank", "duplicate", "truncated", "illegal")}
        totals["illegal"] += sum(a["last"] + b["first"] not in _ORDERLY for a, b in zip(segments, segments[1:]))
        known = [s for s in segments if s["low"] is not None]
        distinct = sum(s["turns"] for s in known) - sum(a["high"] == b["low"] for a, b in zip(known, known[1:]))
        totals["gaps"] = known[-1]["high"] - known[0]["low"] + 1 - distinct if known else 0
        out[-1] |= totals | {"cost": costs[START]}
        return pa.Table.from_pylist(out, schema=schema)

    return marked.select("part", "seq", "conv_id", "blank", "duplicate", "truncated", "illegal", "first", "last", "low",
                         "high", "turns", "matrix").groupBy("conv_id").applyInArrow(sweep, _SWEPT)


_UNROLLED = "part int, seq long, conv_id long, audits array<string>, exits array<int>"


def _unrolled(marked: DataFrame) -> DataFrame:
    """The letters of each segment, and the state behind it, for every state it may be entered in."""
    schema = _schema(_UNROLLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in slices(batches, 1):
            runs = [((letter, bool(cut)), n) for letter, cut, n in zip(c["letters"][0], c["cut"][0], c["lengths"][0],
                                                                      strict=True)]
            after, _ = costs_behind(runs, tuple(c["after"][0]))
            ways = [unroll(runs, state, after) for state in range(4)]
            yield _arrow([{"part": c["part"][0], "seq": c["seq"][0], "conv_id": c["conv_id"][0],
                           "audits": ["".join(letters) for letters, _ in ways], "exits": [s for _, s in ways]}], schema)

    return marked.select("part", "seq", "conv_id", "letters", "cut", "lengths", "after").mapInArrow(run, _UNROLLED)


_ENTERED = "part int, seq long, state int, tail string"


def _entered(unrolled: DataFrame) -> DataFrame:
    """The state each segment is entered in, and what is inserted at the conversation's end."""
    schema = _schema(_ENTERED)

    def sweep(rows: pa.Table) -> pa.Table:
        state, out = START, []
        for s in _in_order(rows):
            out.append({"part": s["part"], "seq": s["seq"], "state": state, "tail": ""})
            state = s["exits"][state]
        out[-1]["tail"] = ending(state)
        return pa.Table.from_pylist(out, schema=schema)

    return unrolled.select("part", "seq", "conv_id", "exits").groupBy("conv_id").applyInArrow(sweep, _ENTERED)


def _repaired(split: DataFrame) -> DataFrame:
    """Roles and texts of each segment after its edits."""
    schema = _schema(_SEGMENT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in slices(batches, 1):
            row = {k: v[0] for k, v in c.items()}
            row["roles"], row["texts"] = _rebuilt(row["roles"], row["texts"], row["audit"], row.pop("state"))
            yield _arrow([row], schema)

    names = [c.split()[0] for c in _SEGMENT.split(", ")]
    return split.select(*names, "state").mapInArrow(run, _SEGMENT)


def repair(rows: DataFrame, segment_rows: int = SEGMENT_ROWS, segment_chars: int = SEGMENT_CHARS) -> DataFrame:
    """The repaired conversations of ``conv_id, turn, role, text``.

    A conversation is one row, or several in the order of ``(part, seq)`` if it
    is long or crosses ranges (``pieces`` tells how many): ``audit`` holds the
    letters of its edits, ``roles`` and ``texts`` what stands after them.  The
    counts (``gaps`` between turns, ``blank``, ``duplicate`` and ``truncated``
    rows, ``illegal`` neighbours) and the ``cost`` stand in its first row.

    Rows are taken by turn, null turns first, rows of one turn in the order of a
    hash of role and text.  Rows without ``conv_id`` form one conversation; a
    null role or text is one space.  A role that begins with none of ``s u a``
    cannot be kept.  Texts may be of any length; an empty table gives no rows;
    other columns are ignored.
    """
    own = rows.select(F.col("`conv_id`").cast("long").alias("conv_id"), F.col("`turn`").cast("long").alias("turn"),
                      F.coalesce(F.col("`role`").cast("string"), F.lit(" ")).alias("role"),
                      F.coalesce(F.col("`text`").cast("string"), F.lit(" ")).alias("text"))
    # The last key splits equal rows, which may be many, over ranges; it does not matter which of them goes where.
    order = ["conv_id", "turn", "_hash", "_row"]
    keyed = own.withColumn("_hash", F.xxhash64("role", "text")).withColumn("_row", F.monotonically_increasing_id())
    ranges = max(partitions(rows.sparkSession), rows.rdd.getNumPartitions())
    ranged = keyed.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    found = written(_segments(ranged.drop("_hash", "_row"), segment_rows, segment_chars), "conversations")
    names = [c.split()[0] for c in _SEGMENT.split(", ")]

    split = found.where(F.col("pieces").isNull())
    # One row per segment and digest; which segment met a digest first.
    met = split.select("conv_id", "part", "seq", F.explode(F.array_distinct("digests")).alias("digest"))
    first = F.min(F.struct("part", "seq")).over(Window.partitionBy("conv_id", "digest"))
    earlier = (met.withColumn("first", first).where(F.struct("part", "seq") > F.col("first"))
               .groupBy("part", "seq").agg(F.collect_list("digest").alias("earlier")))
    marked = written(_marked(split.join(earlier, ["part", "seq"], "left")
                             .select("part", "seq", "conv_id", "roles", "texts", "turns", "earlier")), "marked")
    swept = written(_swept_back(marked), "swept")
    unrolled = written(_unrolled(marked.join(swept.select("part", "seq", "after"), ["part", "seq"])), "unrolled")
    entered = (_entered(unrolled).join(unrolled.select("part", "seq", "audits"), ["part", "seq"])
               .select("part", "seq", "state", F.concat(F.get("audits", "state"), "tail").alias("audit")))
    totals = swept.drop("after")
    repaired = _repaired(split.select("conv_id", "part", "seq", "roles", "texts")
                         .join(totals, ["part", "seq"]).join(entered, ["part", "seq"]))
    return found.where(F.col("pieces").isNotNull()).select(*names).unionByName(repaired)


def messages(repaired: DataFrame) -> DataFrame:
    """One row for each message of the repaired conversations, in the order of ``part, seq, place``."""
    pairs = F.arrays_zip("roles", "texts")
    return (repaired.select("conv_id", "part", "seq", F.posexplode(pairs).alias("place", "message"))
            .select("conv_id", "part", "seq", "place", "message.roles", "message.texts")
            .withColumnsRenamed({"roles": "role", "texts": "text"}))


_DIGESTED = f"conv_id long, {_RESULT}, audit string, repaired_sha256 string"


def digests(repaired: DataFrame) -> DataFrame:
    """One row per conversation with its counts, its audit and the hash of its ``role:text`` lines.

    A conversation of one row is hashed where it is.  The hash of a longer one
    has to see its lines in order, so these are streamed by one task, segment by
    segment, of which only the audit is kept.
    """
    lines = F.array_join(F.transform(F.arrays_zip("roles", "texts"), lambda m: F.concat(m["roles"], F.lit(":"), m["texts"])),
                         "\n")
    result = [c.split()[0] for c in _RESULT.split(", ")]
    short = repaired.where(F.col("pieces") == 1).select("conv_id", *result, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    schema = _schema(_DIGESTED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, state, empty, audit = None, None, True, []
        for c in slices(batches, 1):
            if row is None or c["conv_id"][0] != row["conv_id"]:
                if row is not None:
                    yield _arrow([row | {"audit": "".join(audit), "repaired_sha256": state.hexdigest()}], schema)
                row = {k: c[k][0] for k in ["conv_id", *result]}
                state, empty, audit = sha256(), True, []
            audit.append(c["audit"][0])
            for role, text in zip(c["roles"][0], c["texts"][0], strict=True):
                state.update(f"{'' if empty else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                empty = False
        if row is not None:
            yield _arrow([row | {"audit": "".join(audit), "repaired_sha256": state.hexdigest()}], schema)

    long = (repaired.where(F.col("pieces") > 1).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
            .mapInArrow(run, _DIGESTED))
    return short.unionByName(long)


def damage() -> Column:
    """What happens to a row: a number below 20 from the hash of ``conv_id:turn``, a null as one space."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    return F.crc32(key.cast("binary")) % 20


def damaged(rows: DataFrame) -> DataFrame:
    """Rows dropped (0), emptied (1), without ``. ! ?`` (2), repeated (3) or made the user's (4)."""
    kind, text, role = F.col("_kind"), F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    return (rows.select("conv_id", "turn", "role", "text", damage().alias("_kind")).where(kind != 0).select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("_copy"))
        .drop("_copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cheapest repair and hash of the repaired form of every conversation, after the damage.

    Conversations whose rows were all dropped have zeros, no audit and the hash
    of nothing.  Null ids are one conversation.
    """
    source = table(spark, sf_dir, "conversations")
    gone = (source.groupBy("conv_id").agg(F.count_if(damage() != 0).alias("left")).where(F.col("left") == 0)
            .select("conv_id", *[F.lit(0).cast("long").alias(c.split()[0]) for c in _RESULT.split(", ")],
                    F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256")))
    return digests(repair(damaged(source))).unionByName(gone)


def _sql() -> str:
    """The same by a plain recursion over the rows, which carries the best repair of each state."""
    key = "coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')"
    crc = ("xor(4294967295, list_reduce([4294967295::BIGINT] || list_transform(range(strlen(k)::BIGINT), "
           "lambda i: ord(k[i + 1])::BIGINT), lambda c, b: list_reduce([xor(c, b)] || list_transform(range(8), "
           "lambda z: 0::BIGINT), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))))")

    def add(state: str, cost: str, letter: str, line: str = "''") -> str:
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 'r': {state}.r || {line}}}"

    def least(*ways: str) -> str:
        return f"list_sort([{', '.join(ways)}])[1]"

    def when(condition: str, way: str) -> str:
        return f"CASE WHEN {condition} THEN {way} ELSE far END"

    user, assistant = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
    own = "chr(10) || role || ':' || text"
    to_user = [w for f in "esa" for w in (
        when("NOT gone AND letter = 'u'", add(f, "cut", "K", own)),
        when("NOT gone", add(f, "2 + cut", "R", f"{user} || text")))]
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {key} AS k FROM conversations
), kinds AS (SELECT *, {crc} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS n, left(role, 1) AS letter,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
         regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS ended
  FROM damaged
), seen AS (
  SELECT *, NOT blank AND row_number() OVER (PARTITION BY n, role, text ORDER BY i) > 1 AS again,
         lag(letter) OVER (PARTITION BY n ORDER BY i) || letter AS pair
  FROM numbered
), marked AS (
  SELECT *, blank OR again AS gone, CASE WHEN blank OR again OR ended THEN 0 ELSE 1 END AS cut FROM seen
), counted AS (
  SELECT n, any_value(conv_id) AS conv_id, max(i) AS last,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(again) AS duplicate, sum(cut) AS truncated, count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY n
), repairs AS (
  SELECT n, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': ''}} AS e, {{'c': 1000000000000, 'a': '', 'r': ''}} AS s,
         {{'c': 2::BIGINT, 'a': 'I', 'r': {user}}} AS u, {{'c': 4::BIGINT, 'a': 'II', 'r': {user} || {assistant}}} AS a
  FROM counted
  UNION ALL
  SELECT n, i, e, s, u, {least("a", add("u", "2", "I", assistant))} AS a
  FROM (
    SELECT n, i, e, s, {least("u", add("e", "2", "I", user), add("s", "2", "I", user), add("a", "2", "I", user))} AS u, a
    FROM (
      SELECT n, i, {add("e", "3", "D")} AS e,
             {least(add("s", "3", "D"), when("NOT gone AND letter = 's'", add("e", "cut", "K", own)))} AS s,
             {least(add("u", "3", "D"), *to_user)} AS u,
             {least(add("a", "3", "D"), when("NOT gone AND letter = 'a'", add("u", "cut", "K", own)),
                    when("NOT gone", add("u", "2 + cut", "R", f"{assistant} || text")))} AS a
      FROM (
        SELECT r.n, m.i, e, s, u, a, m.role, m.text, m.letter, m.gone, m.cut,
               {{'c': 1000000000000, 'a': '', 'r': ''}} AS far
        FROM repairs r JOIN marked m ON m.n = r.n AND m.i = r.i + 1
      )
    )
  )
), chosen AS (
  SELECT c.*, {least("r.e", "r.a")} AS best FROM counted c JOIN repairs r ON r.n = c.n AND r.i = c.last
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank,
       coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
       coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost, coalesce(best.a, '') AS audit,
       sha256(coalesce(substr(best.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN chosen ON chosen.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
