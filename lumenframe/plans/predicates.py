"""Predicate trees: parsing and columns."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BACKEND_ERROR, INVALID_PREDICATE, FrameError
from ..params import is_array
from ..schema import field


@dataclass(frozen=True)
class Logical:
    op: str
    conditions: tuple[Node, ...]


@dataclass(frozen=True)
class Not:
    condition: Node


@dataclass(frozen=True)
class Condition:
    column: str
    op: str
    value: Any = None
    value_column: str | None = None
    values: tuple | None = None
    low: Any = None
    high: Any = None


Node = Logical | Not | Condition

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
}

#: No character escapes a wildcard; one that texts don't hold stands in for Spark's default.
_NO_ESCAPE = "\x01"
TEXT_OPS: dict[str, Callable[[Column, Column], Column]] = {
    "like": lambda a, b: F.like(a, b, F.lit(_NO_ESCAPE)),
    "ilike": lambda a, b: F.ilike(a, b, F.lit(_NO_ESCAPE)),
    "starts_with": F.startswith,
    "ends_with": F.endswith,
    "contains": F.contains,
    "matches": F.rlike,
}
NULL_OPS = ("is_null", "is_not_null")


def _fail(message: str) -> FrameError:
    return FrameError(INVALID_PREDICATE, message)


def _name(x: Any) -> str | None:
    return x if isinstance(x, str) and x.strip() else None


def parse(node: Any) -> Node:
    """A node from its request form; INVALID_PREDICATE if it is malformed."""
    if not isinstance(node, Mapping):
        raise _fail("A predicate is an object.")
    op = _name(node.get("op"))
    if "column" not in node:
        if op is None:
            raise _fail("A predicate needs an 'op' (logical) or a 'column' (condition).")
        if op in ("and", "or"):
            inner = node.get("conditions")
            if not is_array(inner) or not (children := tuple(inner)):
                raise _fail(f"'{op}' needs a non-empty 'conditions' array.")
            return Logical(op, tuple(map(parse, children)))
        if op == "not":
            if not isinstance(node.get("condition"), Mapping):
                raise _fail("'not' needs one 'condition' object.")
            return Not(parse(node["condition"]))
        raise _fail(f"There is no logical operator '{op}'.")
    column = _name(node["column"])
    if column is None:
        raise _fail("'column' must be a non-empty string.")
    if op is None:
        raise _fail(f"The condition on '{column}' needs an 'op'.")
    if op in COMPARISONS or op in TEXT_OPS:
        other = _name(node.get("value_column"))
        if other is not None and "value" in node:
            raise _fail(f"'{op}' on '{column}' can't have both 'value' and 'value_column'.")
        if other is None and "value" not in node:
            raise _fail(f"'{op}' on '{column}' needs a 'value' or 'value_column'.")
        return Condition(column, op, node.get("value"), other)
    if op in NULL_OPS:
        return Condition(column, op)
    if op == "in":
        if not is_array(node.get("values")) or not (values := tuple(node["values"])):
            raise _fail(f"'in' on '{column}' needs a non-empty 'values' array.")
        return Condition(column, op, values=values)
    if op == "between":
        if "low" not in node or "high" not in node:
            raise _fail(f"'between' on '{column}' needs 'low' and 'high'.")
        return Condition(column, op, low=node["low"], high=node["high"])
    raise _fail(f"Column '{column}' can't be compared by '{op}'.")


Resolver = Callable[[str], tuple[Column, T.DataType]]


def resolver(df: DataFrame) -> Resolver:
    return lambda name: field(df, name)[1:]


def literal(x: Any, kind: T.DataType) -> Column:
    """A value to compare with a column of the type: strings take the column's type, as an untyped literal of SQL does."""
    if isinstance(x, str) and not isinstance(kind, T.StringType):
        return F.lit(x).cast(kind)
    if x is not None and isinstance(kind, T.StringType) and not isinstance(x, str):
        return F.lit(str(x).lower() if isinstance(x, bool) else str(x))
    return F.lit(x)


def to_column(node: Node, resolve: Resolver) -> Column:
    if isinstance(node, Logical):
        parts = [to_column(c, resolve) for c in node.conditions]
        return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)
    if isinstance(node, Not):
        return ~to_column(node.condition, resolve)
    c, kind = resolve(node.column)
    if node.op == "is_null":
        return c.isNull()
    if node.op == "is_not_null":
        return c.isNotNull()
    if node.op == "in":
        return c.isin([literal(v, kind) for v in node.values])
    if node.op == "between":
        return (c >= literal(node.low, kind)) & (c <= literal(node.high, kind))
    if node.value_column is not None:
        other, other_kind = resolve(node.value_column)
    else:
        other, other_kind = literal(node.value, kind), T.StringType()
    if node.op in COMPARISONS:
        return COMPARISONS[node.op](c, other)
    if not isinstance(kind, T.StringType) or not isinstance(other_kind, T.StringType):
        raise FrameError(BACKEND_ERROR, f"'{node.op}' needs text; column '{node.column}' isn't.")
    return TEXT_OPS[node.op](c, other)


def where(df: DataFrame, tree: Mapping[str, Any]) -> Column:
    return to_column(parse(tree), resolver(df))
