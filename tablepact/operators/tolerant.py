"""Conditions that mark the rows they cannot decide instead of failing on them.

A text that is no number, a sum that overflows or a division by zero ends the
whole query in which it is met.  Here a condition is read back as Spark has
understood it, implicit casts included, and put together again from the ``try_``
forms; beside its value stands whether the original would have failed on the
row.  A branch that is not taken, or a right side that the left one has already
settled, cannot fail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablepact.functions.text import quoted

_ARITHMETIC = {"Add": F.try_add, "Subtract": F.try_subtract, "Multiply": F.try_multiply, "Divide": F.try_divide,
               "Remainder": F.try_mod}
_COMPARED = {"EqualTo": "__eq__", "LessThan": "__lt__", "LessThanOrEqual": "__le__", "GreaterThan": "__gt__",
             "GreaterThanOrEqual": "__ge__", "EqualNullSafe": "eqNullSafe"}
_PARSED = {"ParseToDate": F.try_to_date, "ParseToTimestamp": F.try_to_timestamp}
_WIDER = ("boolean", "tinyint", "smallint", "int", "bigint", "float", "double")
#: Functions that run code of their own, or exist to fail.
_UNFORESEEN = {"ScalaUDF", "PythonUDF", "CallMethodViaReflection", "TryReflect", "RaiseError", "AssertTrue", "ScalarSubquery",
               "Exists", "InSubquery", "ListQuery"}


class Unforeseen(Exception):
    """A condition that may fail in a way that has no ``try_`` form."""


@dataclass(frozen=True)
class Tolerant:
    """A condition's value, and whether it fails on the row (``None``: on no row)."""

    value: Column
    fails: Column | None

    @property
    def violations(self) -> Column:
        decided = self.value if self.fails is None else self.value & ~self.fails
        return F.count_if(decided)

    @property
    def undecided(self) -> Column | None:
        return None if self.fails is None else F.count_if(self.fails)


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _name(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _fields(node) -> Iterator[tuple[str, object]]:
    names, values = node.productElementNames(), node.productIterator()
    while names.hasNext():
        yield names.next(), values.next()


def _strict(node) -> bool:
    """Whether this node itself fails on some values."""
    for name, value in _fields(node):
        if name in ("failOnError", "ansiEnabled") and value is True:
            return True
        if name == "evalMode" and value.toString() == "ANSI" or name == "evalContext" and "ANSI" in value.toString():
            return not (_name(node) == "Cast" and _harmless_cast(node))
    return False


def _harmless_cast(node) -> bool:
    source, target = node.child().dataType().simpleString(), node.dataType().simpleString()
    if node.child().foldable() or source == target or target.startswith("string"):
        return True
    if source in _WIDER and target in _WIDER:
        return _WIDER.index(source) <= _WIDER.index(target)
    return source == "date" and target.startswith("timestamp")


def _may_fail(node) -> bool:
    return _name(node) in _UNFORESEEN or _strict(node) or any(_may_fail(c) for c in _items(node.children()))


def _either(*fails: Column | None) -> Column | None:
    known = [f for f in fails if f is not None]
    return reduce(Column.__or__, known) if known else None


def _where(condition: Column, fails: Column | None) -> Column | None:
    return None if fails is None else F.coalesce(condition, F.lit(False)) & fails


def _rebuilt(node, shared: dict[str, Tolerant]) -> Tolerant:
    """The node's value and failure from those of its children."""
    name = _name(node)
    if name == "CommonExpressionRef":
        return shared[node.id().toString()]
    if name not in ("With", "Between") and not _has_shared(node) and not _may_fail(node):
        return Tolerant(F.expr(node.sql()), None)
    if name in _UNFORESEEN:
        raise Unforeseen(name)
    children = _items(node.children())
    if name == "Between":  # stands for a comparison on both sides
        return _rebuilt(children[0], shared)
    if name == "With":
        for d in _items(node.defs()):
            shared = shared | {d.id().toString(): _rebuilt(d.child(), shared)}
        return _rebuilt(node.child(), shared)

    parts = [_rebuilt(c, shared) for c in children]
    values, fails = [p.value for p in parts], [p.fails for p in parts]
    if name == "Cast":
        value = values[0].try_cast(node.dataType().simpleString())
        own = None if not _strict(node) else values[0].isNotNull() & value.isNull()
        return Tolerant(value, _either(fails[0], own))
    if name in _ARITHMETIC:
        value = _ARITHMETIC[name](*values)
        own = None if not _strict(node) else values[0].isNotNull() & values[1].isNotNull() & value.isNull()
        return Tolerant(value, _either(*fails, own))
    if name in _PARSED:
        value = _PARSED[name](*values)
        return Tolerant(value, _either(*fails, values[0].isNotNull() & value.isNull()))
    if name in _COMPARED:
        return Tolerant(getattr(values[0], _COMPARED[name])(values[1]), _either(*fails))
    if name == "And":
        return Tolerant(values[0] & values[1], _either(fails[0], _where(F.coalesce(values[0], F.lit(True)), fails[1])))
    if name == "Or":
        return Tolerant(values[0] | values[1], _either(fails[0], _where(~F.coalesce(values[0], F.lit(False)), fails[1])))
    if name == "Not":
        return Tolerant(~values[0], fails[0])
    if name in ("IsNull", "IsNotNull"):
        return Tolerant(values[0].isNull() if name == "IsNull" else values[0].isNotNull(), fails[0])
    if name == "In":
        return Tolerant(values[0].isin(*values[1:]), _either(*fails))
    if name == "Coalesce":
        later = None
        for value, own in zip(reversed(values), reversed(fails)):
            later = _either(own, _where(value.isNull(), later))
        return Tolerant(F.coalesce(*values), later)
    if name in ("If", "CaseWhen"):
        return _branches(values, fails)
    raise Unforeseen(name)


def _branches(values: list[Column], fails: list[Column | None]) -> Tolerant:
    """Conditions and results in turn, and perhaps a last result."""
    even = len(values) - len(values) % 2
    value = values[-1] if len(values) > even else F.lit(None)
    failing = fails[-1] if len(values) > even else None
    for i in range(even - 2, -1, -2):
        taken = F.coalesce(values[i], F.lit(False))
        value = F.when(taken, values[i + 1]).otherwise(value)
        failing = _either(fails[i], _where(taken, fails[i + 1]), _where(~taken, failing))
    return Tolerant(value, failing)


def _has_shared(node) -> bool:
    return _name(node) == "CommonExpressionRef" or any(_has_shared(c) for c in _items(node.children()))


#: Literals, quoted names and calls in which nothing can fail, as text.
_PLAIN = re.compile(r"'(?:[^'\\\\]|\\\\.)*'|`[^`]*`|\b(?:typeof|length|lower|upper|trim|in|and|or|not)\(", re.IGNORECASE)
_SUSPECT = re.compile(r"\w\(|[-+*/%\[]")


def _condition(node) -> Tolerant | None:
    """None if nothing in it can fail."""
    # A look at the text spares most conditions the walk over their nodes.
    if not _SUSPECT.search(_PLAIN.sub(" ", node.sql())) or not _may_fail(node):
        return None
    return _rebuilt(node, {})


def tolerant(df: DataFrame, *conditions: str) -> list[Tolerant | Unforeseen]:
    """Each condition in ``try_`` forms.

    An ``Unforeseen`` stands for one that may fail in other ways (functions of the
    user, for example).  What the analysis raises where a condition does not fit
    the table is raised.
    """
    if not conditions:
        return []
    named = [f"({c}) AS {quoted(f'c{i}')}" for i, c in enumerate(conditions)]
    plan = df.selectExpr(*named)._jdf.queryExecution().analyzed()
    out = []
    for item, condition in zip(_items(plan.projectList()), conditions, strict=True):
        try:
            out.append(_condition(item.child()) or Tolerant(F.expr(condition), None))
        except Unforeseen as unforeseen:
            out.append(unforeseen)
    return out
