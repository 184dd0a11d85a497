"""Predicates that users give as text, checked before Spark evaluates any part of them.

A predicate over a frame may name its columns and hold literals, comparisons, AND, OR and NOT, IN, BETWEEN, LIKE, IS NULL,
arithmetic, casts and a few plain functions of text and numbers. Everything else is refused with a reason: other functions
(some of which call the JVM, read files or look at the session), subqueries, lambdas, windows, unknown columns, and
expressions that are not true or false.

The text is looked at twice. First as parsed: analysing some functions already evaluates their constant arguments, so a
name that is not on the list must not get that far. Then as analysed, where every node is resolved: what a name stands for,
what was put in for it and which column is meant.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

# What a predicate may be made of: functions by name, and the kinds of nodes they and the operators become.
FUNCTIONS = frozenset(
    "abs ceil ceiling char_length character_length coalesce concat floor ifnull length lower ltrim nullif round rtrim "
    "substr substring trim upper "
    "= == <> != < <= > >= <=> + - * / % || and or not in like ilike between isnull isnotnull negative positive".split()
)
OPERATORS = frozenset(
    "And Or Not EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual In IsNull IsNotNull Like ILike "
    "Between Add Subtract Multiply Divide Remainder UnaryMinus UnaryPositive Cast Literal".split()
)
PARSED = OPERATORS | {"UnresolvedAttribute", "UnresolvedFunction", "Concat", "StringTrim", "StringTrimLeft", "StringTrimRight", "Substring"}
ANALYSED = OPERATORS | frozenset(
    "AttributeReference Abs Ceil CeilExpressionBuilder RoundCeil Coalesce Concat Floor RoundFloor If Length Lower NullIf Nvl "
    "Round StringTrim StringTrimLeft StringTrimRight Substring Upper "
    "With CommonExpressionDef CommonExpressionRef TypedNullLiteral".split()  # of analysis itself
)
SUBQUERIES = frozenset("ScalarSubquery Exists InSubquery ListQuery LateralSubquery TableSubquery".split())


class PredicateRefused(ValueError):
    """A user's predicate that is not evaluated; the message says why."""


def _nodes(tree) -> Iterator:
    """All nodes of an expression of the JVM."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        yield node
        children = node.children()
        waiting.extend(children.apply(k) for k in range(children.size() - 1, -1, -1))


def _kind(node) -> str:
    return node.getClass().getSimpleName().rstrip("$")


def _problem_of_parsed(tree) -> str | None:
    for node in _nodes(tree):
        kind = _kind(node)
        if kind in SUBQUERIES:
            return "subqueries are not allowed"
        if kind == "UnresolvedFunction":
            name = node.nameParts().mkString(".").lower()
            if name not in FUNCTIONS:
                return f"function {name} is not allowed"
            if node.isDistinct() or node.filter().isDefined():
                return f"function {name} is no aggregate here"
        elif kind not in PARSED:
            return f"{kind} is not allowed"
    return None


def _problem_of_analysed(tree, columns: set[str]) -> str | None:
    for node in _nodes(tree):
        kind = _kind(node)
        if kind not in ANALYSED:
            return f"{kind} is not allowed"
        if kind == "AttributeReference" and node.name().lower() not in columns:
            return f"column {node.name()} is not known"
    return None


def refusal(frame: DataFrame, where: str, columns: Sequence[str] | None = None) -> str | None:
    """Why ``where`` may not be evaluated over ``frame``, or null if it may. ``columns`` restricts what it may name."""
    parser = frame.sparkSession._jsparkSession.sessionState().sqlParser()
    try:
        parsed = parser.parseExpression(where)
    except ParseException:
        return "the predicate cannot be read"
    problem = _problem_of_parsed(parsed)
    if problem:
        return problem
    # An empty frame of these columns: analysis would find others below a mere selection.
    known = frame.schema if columns is None else StructType([frame.schema[c] for c in columns])
    try:
        analysed = frame.sparkSession.createDataFrame([], known).filter(F.expr(where))._jdf.queryExecution().analyzed()
    except AnalysisException as error:
        condition = error.getCondition() or ""
        if condition.startswith("UNRESOLVED_COLUMN"):
            return f"column {error.getMessageParameters()['objectName'].replace('`', '')} is not known"
        if condition.startswith("DATATYPE_MISMATCH.FILTER_NOT_BOOLEAN"):
            return "the predicate is not true or false"
        return "the predicate does not fit the columns"
    return _problem_of_analysed(analysed.condition(), {name.lower() for name in known.names})


def checked(frame: DataFrame, where: str, columns: Sequence[str] | None = None) -> Column:
    """The predicate as a column, if it may be evaluated over ``frame``."""
    reason = refusal(frame, where, columns)
    if reason:
        raise PredicateRefused(f"{reason}: {where}")
    return F.expr(where)
