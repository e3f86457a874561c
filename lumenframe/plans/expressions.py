"""Expression trees: parsing and columns."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import typenames
from ..errors import COLUMN_NOT_FOUND, INVALID_PREDICATE, INVALID_TYPE, FrameError
from ..functions.casts import cast, try_cast
from ..functions.registry import FUNCTIONS, Typed
from ..params import is_array
from ..schema import field
from . import predicates


@dataclass(frozen=True)
class ColumnRef:
    column: str


@dataclass(frozen=True)
class Literal:
    value: Any


@dataclass(frozen=True)
class Call:
    op: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Cast:
    to: str
    arg: Expr
    safe: bool = False


@dataclass(frozen=True)
class Case:
    whens: tuple[tuple[predicates.Node, Expr], ...]
    otherwise: Expr | None = None


@dataclass(frozen=True)
class StructField:
    arg: Expr
    field: str


Expr = ColumnRef | Literal | Call | Cast | Case | StructField


def _fail(message: str) -> FrameError:
    return FrameError(INVALID_PREDICATE, message)


def _text(x: Any) -> str | None:
    return x if isinstance(x, str) and x.strip() else None


def _args(node: Mapping[str, Any]) -> tuple[Expr, ...]:
    args = node.get("args")
    if not is_array(args):
        raise _fail(f"'{node.get('op')}' needs an 'args' array.")
    return tuple(parse(a) for a in args)


def _one(node: Mapping[str, Any]) -> Expr:
    args = _args(node)
    if len(args) != 1:
        raise _fail(f"'{node['op']}' takes one argument.")
    return args[0]


def _case(node: Mapping[str, Any]) -> Case:
    whens = node.get("when")
    if not is_array(whens) or not (items := list(whens)):
        raise _fail("'case' needs a non-empty 'when' array.")
    parsed = []
    for item in items:
        if not isinstance(item, Mapping) or not isinstance(item.get("predicate"), Mapping) or not isinstance(item.get("then"), Mapping):
            raise _fail("Each 'when' entry needs a 'predicate' object and a 'then' object.")
        parsed.append((predicates.parse(item["predicate"]), parse(item["then"])))
    otherwise = node.get("else")
    return Case(tuple(parsed), parse(otherwise) if otherwise is not None else None)


def parse(node: Any) -> Expr:
    """A node from its request form; INVALID_PREDICATE if it is malformed."""
    if not isinstance(node, Mapping):
        raise _fail("An expression is an object.")
    if "column" in node:
        if _text(node["column"]) is None:
            raise _fail("'column' must be a non-empty string.")
        return ColumnRef(node["column"])
    if "literal" in node:
        return Literal(node["literal"])
    op = _text(node.get("op"))
    if op is None:
        raise _fail("An expression needs 'column', 'literal' or 'op'.")
    if op in ("cast", "try_cast"):
        to = _text(node.get("to"))
        if to is None:
            raise _fail(f"'{op}' needs a 'to' type.")
        return Cast(to, _one(node), op == "try_cast")
    if op == "case":
        return _case(node)
    if op == "struct_field":
        name = _text(node.get("field"))
        if name is None:
            raise _fail("'struct_field' needs a 'field'.")
        return StructField(_one(node), name)
    if op not in FUNCTIONS:
        raise _fail(f"There is no expression operator '{op}'.")
    least, most = FUNCTIONS[op].arity
    args = _args(node)
    if len(args) < least or (most is not None and len(args) > most):
        raise _fail(f"'{op}' takes {least}{'' if most == least else f' to {most}' if most else ' or more'} arguments; got {len(args)}.")
    return Call(op, args)


class Compiler:
    """Turns nodes into columns over a frame. Types are found by analysis only; nothing runs."""

    def __init__(self, df: DataFrame):
        self.df = df

    def type_of(self, c: Column) -> T.DataType:
        return self.df.select(c.alias("x")).schema[0].dataType

    def typed(self, c: Column) -> Typed:
        return Typed(c, self.type_of(c))

    def compile(self, e: Expr) -> Typed:
        if isinstance(e, ColumnRef):
            return Typed(*field(self.df, e.column)[1:])
        if isinstance(e, Literal):
            kind = T.LongType() if isinstance(e.value, int) and not isinstance(e.value, bool) and not -(2**31) <= e.value < 2**31 else None
            c = F.lit(e.value) if kind is None else F.lit(e.value).cast(kind)
            return Typed(c, self.type_of(c), e.value, True)
        if isinstance(e, Cast):
            if not re.fullmatch(r"[A-Za-z0-9_ ,()]{1,64}", e.to):
                raise FrameError(INVALID_TYPE, f"Cast type '{e.to}' is not valid.")
            kind, arg = typenames.parse(e.to), self.compile(e.arg)
            return Typed((try_cast if e.safe else cast)(arg.column, arg.type, kind), kind)
        if isinstance(e, Case):
            resolve = predicates.resolver(self.df)
            values = [self.compile(then) for _, then in e.whens]
            rest = self.compile(e.otherwise) if e.otherwise is not None else None
            kind = values[0].type
            for v in [*values[1:], *([rest] if rest else [])]:
                kind = typenames.common(kind, v.type)
            out = None
            for (p, _), v in zip(e.whens, values):
                test = predicates.to_column(p, resolve)
                out = (F if out is None else out).when(test, v.column.cast(kind))
            return Typed(out.otherwise(rest.column.cast(kind)) if rest else out, kind)
        if isinstance(e, StructField):
            arg = self.compile(e.arg)
            if not isinstance(arg.type, T.StructType):
                raise FrameError(COLUMN_NOT_FOUND, f"'{e.field}' was asked of a value that has no fields.", column=e.field)
            for f in arg.type.fields:
                if f.name.lower() == e.field.lower():
                    return Typed(arg.column.getField(f.name), f.dataType)
            raise FrameError(COLUMN_NOT_FOUND, f"Field '{e.field}' does not exist in the struct.", column=e.field)
        args = [self.compile(a) for a in e.args]
        return self.typed(FUNCTIONS[e.op].build(args))


def compile_expression(df: DataFrame, tree: Mapping[str, Any]) -> Column:
    return Compiler(df).compile(parse(tree)).column
