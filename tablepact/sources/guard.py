"""What an ad-hoc query may do, read from its analysed plan.

Text tells little: a name may be hidden in a view, stand in a sub-query or in the
sixty-first column, and a harmless literal may look like a call.  So every node
of the plan Spark has made of the query is looked at, views and sub-queries
included.  Relations and expressions are allowed, not forbidden: what is unknown
is refused.
"""

from __future__ import annotations

from collections.abc import Iterator

#: Nodes a query is made of.
RELATIONAL = frozenset("""
Aggregate CTERelationDef CTERelationRef CollectMetrics Deduplicate Distinct Except Expand Filter Generate GlobalLimit
Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Range ResolvedHint Sample Sort
SubqueryAlias Tail Transpose Union UnionLoop UnionLoopRef Unpivot View Window WithCTE WithWindowDefinition Subquery
""".split())
#: Stored tables; outside a view only those the catalog knows, so that a path is no table.
STORED = frozenset("DataSourceV2Relation DataSourceV2ScanRelation HiveTableRelation InMemoryRelation LogicalRelation LogicalRDD".split())
#: What else the session may have put into a view of its own.
PREPARED = frozenset("""
ArrowEvalPython BatchEvalPython CoGroup EventTimeWatermark FlatMapGroupsInArrow FlatMapGroupsInPandas LogicalRDD MapInArrow
MapInPandas PythonMapInArrow RebalancePartitions Repartition RepartitionByExpression
""".split())
#: Statements that read metadata only.
METADATA = ("Show", "Describe", "Explain", "CommandResult", "LogicalQueryStage")

_BUILT_IN = ("org.apache.spark.sql.catalyst.expressions.", "org.apache.spark.sql.catalyst.analysis.")
#: Of Spark's own expressions, those that run code of somebody else.
_FOREIGN = frozenset("""
CallMethodViaReflection TryReflect ScalaUDF ScalaUDAF ScalaAggregator PythonUDF PythonUDAF PythonUDTF
PolymorphicPythonUDTF UnresolvedPythonUDTF UserDefinedPythonFunction ApplyFunctionExpression V2Aggregator
""".split())


class Refused(Exception):
    """A query that does more than read tables with Spark's own functions."""


def _items(seq) -> Iterator:
    return (seq.apply(i) for i in range(seq.size()))


def _simple(name: str) -> str:
    return name.rpartition(".")[2].rpartition("$")[2] or name.rpartition(".")[2].rstrip("$")


def _check_expression(expression, in_view: bool) -> None:
    name = expression.getClass().getName()
    simple = _simple(name)
    if simple in _FOREIGN or not name.startswith(_BUILT_IN):
        raise Refused(f"Functions that run foreign code are refused: {simple}")
    if simple in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
        _check_plan(expression.plan(), in_view)
    for child in _items(expression.children()):
        _check_expression(child, in_view)


def _check_plan(plan, in_view: bool) -> None:
    simple = _simple(plan.getClass().getName())
    if simple in STORED:
        known = in_view or simple in ("HiveTableRelation", "DataSourceV2Relation") or (
            simple == "LogicalRelation" and plan.catalogTable().isDefined())
        if not known:
            raise Refused(f"Only tables and views can be read, not files: {simple}")
        return  # its columns come from the store
    prepared = in_view and simple in PREPARED  # its function is the session's own
    if simple not in RELATIONAL and not prepared:
        raise Refused(f"Only queries are allowed: {simple}")
    for expression in _items(plan.expressions()) if not prepared else ():
        _check_expression(expression, in_view)
    for child in _items(plan.children()):
        _check_plan(child, in_view or simple == "View")


def check_query(frame) -> None:
    """Raise ``Refused`` unless the query only reads tables and views with Spark's own functions.

    One walk over the nodes of the analysed plan on the driver; nothing is executed.
    """
    _check_plan(frame._jdf.queryExecution().analyzed(), False)


def check_metadata(frame) -> None:
    """Raise ``Refused`` unless the statement shows, describes or explains."""
    parsed = _simple(frame._jdf.queryExecution().logical().getClass().getName())
    if not parsed.startswith(METADATA):
        raise Refused(f"Only queries are allowed: {parsed}")
