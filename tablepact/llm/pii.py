"""Personal data in disguise: detection that keeps source offsets.

Plain detectors look for e-mail addresses, IP addresses, card and phone numbers.
A chain of small transducers then rewrites disguises: look-alike characters,
spelled digits, and ``at`` / ``dot`` in words or brackets.  Each transducer keeps,
for every character it puts out, the range of source characters it stands for.
The same detectors run on the rewritten text, and what they find there is mapped
back.  A span found only in disguise is added; plain ones stay as they are.

All detectors are linear in the length of the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablepact.llm.common import columns, let_go, table

Span = tuple[int, int]
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def find_emails(text: str) -> list[Span]:
    """From every @ the local part is read backwards and the domain forwards, so
    long runs of letters without one cost nothing."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            found.append((start, last))
        at = text.find("@", max(at + 1, last))
    return found


def find_ips(text: str) -> list[Span]:
    def fits(part: str) -> bool:
        digits = part.lstrip("0")
        return len(digits) <= 3 and int(digits or "0") <= 255
    if not _DOTTED.search(text):
        return []
    return [m.span() for m in _IP.finditer(text) if all(map(fits, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def find_cards(text: str) -> list[Span]:
    found = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(m.span())
    return found


def find_phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]


_FINDERS: dict[str, Callable[[str], list[Span]]] = {
    "email": find_emails, "ip": find_ips, "card": find_cards, "phone": find_phones}


def find_plain(text: str) -> dict[str, list[Span]]:
    return {kind: find(text) for kind, find in _FINDERS.items()}


# --- transducers -------------------------------------------------------------------

@dataclass
class Mapped:
    """A rewritten text and the source range of each of its characters."""

    text: str
    start: list[int]
    end: list[int]
    origin: str

    @classmethod
    def of(cls, text: str) -> "Mapped":
        return cls(text, list(range(len(text))), list(range(1, len(text) + 1)), text)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> "Mapped":
        """Replace ascending, disjoint ranges of this text.

        Each new character stands for the whole range replaced; where nothing is
        put in, the range is left out.
        """
        text, start, end, at = [], [], [], 0
        for low, high, new in edits:
            text += [self.text[at:low], new]
            start += self.start[at:low] + [self.start[low]] * len(new)
            end += self.end[at:low] + [self.end[high - 1]] * len(new)
            at = high
        text.append(self.text[at:])
        return Mapped("".join(text), start + self.start[at:], end + self.end[at:], self.origin)

    def put_in(self, i: int) -> bool:
        """Whether a transducer put this character in."""
        return self.origin[self.start[i]:self.end[i]] != self.text[i]

    def source(self, span: Span) -> Span:
        return self.start[span[0]], self.end[span[1] - 1]


#: Letters and marks that look like ASCII ones, without a compatibility mapping (fixed values).
_LOOKALIKES = dict(zip(
    "аеорсхуіѕјһԁԛԝАВЕКМНОРСТХІЅЈαονρικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
    "\u2024\u2010\u2011\u2012\u2013\u2014\u3002",
    "aeopcxyisjhdqwABEKMHOPCTXISJaovpikABEZHIKMNOPTYX"
    ".-----.", strict=True))
#: Characters of no width (fixed values).
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: Blanks other than the plain one (fixed values).
_BLANKS = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def _same_shape() -> dict[str, str]:
    """Letters, digits and marks whose compatibility form is one ASCII character,
    digits of all scripts, look-alikes, blanks, and characters of no width."""
    table = {}
    for code in range(0x250, 0x1FBFF):
        char = chr(code)
        kind = unicodedata.category(char)
        if kind == "Nd":
            table[char] = str(unicodedata.digit(char))
        elif kind[0] in "LPS":
            plain = unicodedata.normalize("NFKC", char)
            if len(plain) == 1 and (plain in _LOCAL or plain in "@()"):
                table[char] = plain
    table.update(_LOOKALIKES)
    table.update(dict.fromkeys(_INVISIBLE, ""))
    table.update(dict.fromkeys(_BLANKS, " "))
    return table


_SHAPES = _same_shape()
#: No character below the first and outside these is rewritten.
_MAYBE_SHAPED = re.compile("[\u00a0\u00ad\u0250-\U0001fbff]")

#: Spelled digits in the four languages of the corpus (fixed values).
_SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7",
    "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8",
    "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7",
    "ocho": "8", "nueve": "9",
}
_DIGIT_WORD = "(?:" + "|".join(sorted(_SPELLED, key=lambda w: (-len(w), w))) + ")"
_BREAK = r"(?:[ ,-]{1,2}|[ ]?\.[ ]?|[ ]dot[ ])"
_SPELLED_RUN = re.compile(
    rf"(?<!\w)(?:plus[ ,-]{{1,2}}(?:[0-9]+{_BREAK})*)?{_DIGIT_WORD}(?:{_BREAK}(?:{_DIGIT_WORD}|[0-9]+))*(?!\w)",
    re.IGNORECASE)
#: What makes a lone spelled digit part of a number: digits before it, or after it.
_NUMBER_BEFORE = re.compile(r"(?:[0-9](?:[ ,().-]{1,3}|[ ]dot[ ])|\+[ (]{0,2})\Z", re.IGNORECASE)
_NUMBER_AFTER = re.compile(r"[ ,().-]{1,3}\+?[0-9]|[ ]dot[ ][0-9]", re.IGNORECASE)
#: A digit and the one blank or hyphen before a run that goes on with it.
_DIGIT_BEFORE = re.compile(r"(?<![0-9])[0-9][ -]\Z")
_RUN_PART = re.compile(rf"plus|{_DIGIT_WORD}|[0-9]+|dot|\.", re.IGNORECASE)

_OPEN, _CLOSE = r"[ ]?[\[({<][ ]?", r"[ ]?[\])}>][ ]?"
_MARKED = re.compile(r"[\[({<][ ]?(?i:at|dot|punkt|point|punto|@|\.)")
_MARKED_AT = re.compile(rf"(?<=\w){_OPEN}(?:at|@){_CLOSE}(?=\w)", re.IGNORECASE)
_MARKED_DOT = re.compile(rf"(?<=\w){_OPEN}(?:dot|punkt|point|punto|\.){_CLOSE}(?=\w)", re.IGNORECASE)
#: Last parts of a domain after a spelled dot where prose is likely (fixed values).
_ENDINGS = (
    "com org net edu gov mil int info biz name pro io co me tv ai app dev example test uk de fr es eu us ca au ch nl it "
    "pl se fi dk cz pt gr ro hu ie be lu ru ua tr jp cn kr tw hk sg nz za br mx ar cl").split()
_LOCAL_PART = r"(?<![\w.%+-])[A-Za-z0-9_%+-]+(?:(?:\.|[ ]dot[ ])[A-Za-z0-9_%+-]+)*+(?P<at>[ ]at[ ]|@)"
#: ``name at host dot tld`` with a spelled dot and a listed ending, and with any dots and ending.
_LISTED_AT = re.compile(
    _LOCAL_PART + r"(?P<host>[A-Za-z0-9-]+(?:(?:\.|[ ]dot[ ])[A-Za-z0-9-]+)*?[ ]dot[ ](?:" + "|".join(_ENDINGS)
    + r"))(?![\w-]|[ ]dot[ ])", re.IGNORECASE)
_WORD_AT = re.compile(
    _LOCAL_PART + r"(?P<host>[A-Za-z0-9-]+(?:(?:\.|[ ]dot[ ])[A-Za-z0-9-]+)*+)(?![\w-])", re.IGNORECASE)
_LABELS = re.compile(r"\.|[ ]dot[ ]", re.IGNORECASE)
_ENDING = re.compile(r"(?:[a-z]{2,}|xn--[a-z0-9-]+)", re.IGNORECASE)
#: Words before a spelled at, and first words of a host, that make it prose (fixed values).
_PROSE_BEFORE = frozenset((
    "look looks looked looking stare stares stared staring point points pointed pointing aim aims aimed aiming glance "
    "glanced gaze arrive arrives arrived stop stops stopped start starts started end ends ended begin begins sit sits sat "
    "stand stands stood stay stays stayed live lives lived work works worked be is are was were been being am it us me "
    "him her them you we they he she i and or but not only even found located hosted available meet met see "
    "here there up down out back on in").split())
_PROSE_AFTER = frozenset((
    "the a an this that these those each every any some all no his her its our their your my which what least most first "
    "last once").split())
_SPELLED_DOT = re.compile(r"[ ]dot[ ]", re.IGNORECASE)
_NUMBER_DOTS = re.compile(r"(?<![\w.])[0-9]{1,3}+(?:(?:\.|[ ]dot[ ])[0-9]{1,3}+){3}(?![\w])", re.IGNORECASE)
_SOME_DOT = re.compile(r" dot ", re.IGNORECASE)
_SOME_AT = re.compile(r" at |@", re.IGNORECASE)


def _odd_shapes(text: str) -> set[str]:
    """The characters of a text that are rewritten."""
    return _SHAPES.keys() & set(text) if not text.isascii() and _MAYBE_SHAPED.search(text) else set()


def _shapes(m: Mapped) -> list[tuple[int, int, str]]:
    odd = _odd_shapes(m.text)
    return [(i, i + 1, _SHAPES[c]) for i, c in enumerate(m.text) if c in odd] if odd else []


_WORDS = re.compile(r"\w+")
_COUNTED = _SPELLED.keys() | {"dot", "plus"}


def _may_spell(text: str) -> bool:
    """Whether a spelled digit stands beside another one, a number, ``dot`` or ``plus``,
    whatever marks lie between, as in any run."""
    words = _WORDS.findall(text.casefold())
    if _SPELLED.keys().isdisjoint(words):
        return False

    def counts(i: int) -> bool:
        return 0 <= i < len(words) and (words[i] in _COUNTED or words[i].isdigit())
    return any(word in _SPELLED and (counts(i + 1) or counts(i - 1)) for i, word in enumerate(words))


def _marks(pattern: re.Pattern, new: str) -> Callable[[Mapped], list[tuple[int, int, str]]]:
    return lambda m: [(x.start(), x.end(), new) for x in pattern.finditer(m.text)]


def _spelled(m: Mapped, reading: str = "joined") -> list[tuple[int, int, str]]:
    """Runs of spelled digits, of any length: each word becomes its digit.

    What lies between the parts of a run goes; ``apart`` it stays, but for dots,
    and with ``led`` a single digit before the run is joined to it as well.
    """
    edits = []
    if not _may_spell(m.text):
        return edits
    for run in _SPELLED_RUN.finditer(m.text):
        parts = list(_RUN_PART.finditer(m.text, run.start(), run.end()))
        before = m.text[max(0, run.start() - 6):run.start()]
        if len(parts) == 1 and not (_NUMBER_BEFORE.search(before) or _NUMBER_AFTER.match(m.text, run.end())):
            continue
        at, last, spelled = run.start(), "", False
        if reading == "led" and _DIGIT_BEFORE.search(before):
            edits.append((at - 1, at, ""))
        for p in parts:
            word = p[0].casefold()
            new = _SPELLED.get(word, "+" if word == "plus" else "." if word in ("dot", ".") else word)
            spelled = spelled or word in _SPELLED  # numbers between a plus and the first spelled digit stay as they are
            marked = new == "." or last in (".", "+")
            if at < p.start() and (marked or reading != "apart" and spelled):
                edits.append((at, p.start(), ""))
            if new != p[0]:
                edits.append((p.start(), p.end(), new))
            at, last = p.end(), new
    return edits


def _addresses(m: Mapped) -> Iterator[re.Match]:
    """Addresses whose host has a spelled dot or one that a transducer put in.

    If the at is a disguise as well, any ending will do, unless the words around
    it make prose likely; else the ending after a spelled dot must be listed.
    """
    at = 0
    while x := _WORD_AT.search(m.text, at):
        host = _LABELS.split(x["host"])
        dots = [d.start() for d in _LABELS.finditer(m.text, x.start("host"), x.end())]
        hidden_dot = any(m.text[d] == " " or m.put_in(d) for d in dots)
        bare_at = x["at"] != "@"
        prose = bare_at and (host[0].casefold() in _PROSE_AFTER
                             or _LABELS.split(m.text[x.start():x.start("at")])[-1].casefold() in _PROSE_BEFORE)
        if not (hidden_dot and (bare_at or m.put_in(x.start("at"))) and not prose and _ENDING.fullmatch(host[-1])):
            x = _LISTED_AT.match(m.text, x.start()) or x
            if x.re is _WORD_AT:  # the host may be the name before another at
                at = x.start("host")
                continue
        yield x
        at = x.end()


def _word_dots(m: Mapped) -> list[tuple[int, int, str]]:
    some = _SOME_DOT.search(m.text)
    if not some and (m.text == m.origin or not _SOME_AT.search(m.text)):
        return []
    edits = {}
    for x in _addresses(m):
        if x["at"] != "@":
            edits[x.start("at")] = (x.start("at"), x.end("at"), "@")
        for dot in _SPELLED_DOT.finditer(m.text, x.start(), x.end()):
            edits[dot.start()] = (dot.start(), dot.end(), ".")
    for x in _NUMBER_DOTS.finditer(m.text) if some else ():
        for dot in _SPELLED_DOT.finditer(m.text, x.start(), x.end()):
            edits[dot.start()] = (dot.start(), dot.end(), ".")
    return [edits[k] for k in sorted(edits)]


_MARKS = (_shapes, _marks(_MARKED_AT, "@"), _marks(_MARKED_DOT, "."))
#: How runs of spelled digits are read besides ``joined``: prose or other numbers may stand beside them.
_OTHER_READINGS = ("led", "apart")
#: What a text must hold for any transducer to rewrite it; quicker than the transducers.
_TRIGGERS: tuple[Callable[[str], object], ...] = (_odd_shapes, _MARKED.search, _may_spell, _SOME_DOT.search)


def readings(text: str) -> list[Mapped]:
    """The text after all transducers, once for each way to read its spelled digits,
    the last one leaving them as words; empty if nothing is rewritten."""
    if not any(trigger(text) for trigger in _TRIGGERS):
        return []
    mapped = Mapped.of(text)
    for step in _MARKS:
        mapped = _after(mapped, step(mapped))
    joined, read = _spelled(mapped), [mapped]
    if joined:
        edits = [joined]
        for reading in _OTHER_READINGS:
            other = _spelled(mapped, reading)
            if other not in edits:
                edits.append(other)
        read = [mapped.rewrite(e) for e in edits] + read
    read = [_after(m, _word_dots(m)) for m in read]
    return [m for m in read if m.text != text]


def _after(m: Mapped, edits: list[tuple[int, int, str]]) -> Mapped:
    return m.rewrite(edits) if edits else m


def find_all(text: str) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Plain spans, and all spans: with those found in rewritten texts only.

    A disguised span is left out if a plain span of its kind, or one of an
    earlier reading, covers it.
    """
    plain = find_plain(text)
    read = readings(text)
    if not read:
        return plain, plain
    full = {}
    for kind, spans in plain.items():
        known = list(spans)
        for mapped in read:
            for span in _FINDERS[kind](mapped.text):
                low, high = mapped.source(span)
                disguised = text[low:high] != mapped.text[span[0]:span[1]]
                if disguised and not any(a <= low and high <= b for a, b in known):
                    known.append((low, high))
        full[kind] = sorted({*known})
    return plain, full


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in spans[kind])


def redact(text: str) -> str:
    """Every span, disguised or not, replaced by its kind in brackets.

    Overlapping spans are replaced together, under the kind of the first one.
    """
    spans = sorted((a, -b, kind) for kind, found in find_all(text)[1].items() for a, b in found)
    out, at = [], 0
    for low, negated, kind in spans:
        if low >= at:
            out += [text[at:low], f"[{kind.upper()}]"]
        at = max(at, -negated)
    out.append(text[at:])
    return "".join(out)


_FOUND = ("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
          "n_added long")


def found(text: Column) -> Column:
    """A struct of the counts of plain spans, their checksum, and all spans.

    Offsets are code points.  A null text is empty; an empty one holds nothing.
    """
    @F.pandas_udf(_FOUND)
    def detect(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for value in texts:
            plain, full = find_all(value or "")
            counts = [len(plain[k]) for k in KINDS]
            rows.append((*counts, hashlib.sha256(listed(plain).encode()).hexdigest(), listed(full),
                         sum(map(len, full.values())) - sum(counts)))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _FOUND.split(", ")])
    return detect(text)


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with personal data replaced; null texts stay null, every
    other column and every row stays, also repeated ones."""
    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        redacted_texts = [None if t is None else redact(t) for t in texts]
        let_go()
        return pd.Series(redacted_texts, dtype=object)
    return docs.withColumn(text, clean(F.col(f"`{text}`")))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain and disguised personal data in all documents; see :func:`found`."""
    docs = columns(table(spark, sf_dir, "documents"), "doc_id", "text")
    return docs.select("doc_id", found(F.col("text")).alias("_f")).select("doc_id", "_f.*")
