"""The closed set of scalar functions: name, number of arguments, builder."""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BACKEND_ERROR, FrameError
from ..typenames import common


@dataclass(frozen=True)
class Typed:
    """A column with its type, and its value if it is a literal."""

    column: Column
    type: T.DataType
    value: Any = None
    is_literal: bool = False


@dataclass(frozen=True)
class Function:
    arity: tuple[int, int | None]
    build: Callable[[Sequence[Typed]], Column]


FUNCTIONS: dict[str, Function] = {}


def function(name: str, least: int, most: int | None = -1):
    """Registers a builder; most: None for any number, by default as least."""

    def add(build: Callable[[Sequence[Typed]], Column]):
        FUNCTIONS[name] = Function((least, least if most == -1 else most), build)
        return build

    return add


def plain(name: str, least: int, build: Callable[..., Column], most: int | None = -1) -> None:
    """A function whose builder needs the columns only."""
    function(name, least, most)(lambda args: build(*[a.column for a in args]))


def _same_type(args: Sequence[Typed]) -> list[Column]:
    kind = reduce(common, [a.type for a in args])
    return [a.column.cast(kind) for a in args]


# Numbers

plain("add", 2, lambda *c: reduce(operator.add, c), None)
plain("multiply", 2, lambda *c: reduce(operator.mul, c), None)
plain("modulo", 2, operator.mod)
plain("abs", 1, F.abs)
plain("power", 2, lambda a, b: F.pow(a, b))


@function("subtract", 2)
def _subtract(args: Sequence[Typed]) -> Column:
    a, b = args
    if isinstance(a.type, T.DateType) and isinstance(b.type, T.DateType):
        return F.datediff(a.column, b.column).cast("long")
    return a.column - b.column


@function("divide", 2)
def _divide(args: Sequence[Typed]) -> Column:
    """Always floating; by zero gives an infinity, or NaN for zero."""
    a, b = (x.column.cast("double") for x in args)
    return F.when(b == 0, a * F.lit(float("inf"))).otherwise(a / F.when(b != 0, b))


@function("round", 1, 2)
def _round(args: Sequence[Typed]) -> Column:
    digits = 0
    if len(args) == 2:
        if not args[1].is_literal or not isinstance(args[1].value, (int, float)) or isinstance(args[1].value, bool):
            raise FrameError(BACKEND_ERROR, "round takes a literal number of digits.")
        digits = int(args[1].value)
    return F.round(args[0].column, digits)


def _toward(build: Callable[[Column], Column]) -> Callable[[Sequence[Typed]], Column]:
    """Decimals stay decimal; other numbers become floating."""
    return lambda args: build(args[0].column) if isinstance(args[0].type, T.DecimalType) else build(args[0].column.cast("double")).cast("double")


function("floor", 1)(_toward(F.floor))
function("ceil", 1)(_toward(F.ceil))


@function("ln", 1)
def _ln(args: Sequence[Typed]) -> Column:
    x = args[0].column.cast("double")
    return F.when(x > 0, F.ln(x)).when(x == 0, F.lit(float("-inf"))).when(x < 0, F.lit(float("nan"))).otherwise(x)


# Texts

plain("concat", 2, lambda *c: F.concat_ws("", *[x.cast("string") for x in c]), None)
plain("upper", 1, F.upper)
plain("lower", 1, F.lower)
plain("trim", 1, F.trim)
plain("replace", 3, F.replace)
plain("lpad", 2, lambda c, n, p=None: F.lpad(c, n.cast("int"), p if p is not None else F.lit(" ")), 3)
plain("rpad", 2, lambda c, n, p=None: F.rpad(c, n.cast("int"), p if p is not None else F.lit(" ")), 3)
plain("regexp_matches", 2, F.rlike)


@function("length", 1)
def _length(args: Sequence[Typed]) -> Column:
    """Characters of a text, elements of a list."""
    c, kind = args[0].column, args[0].type
    return (F.when(c.isNotNull(), F.size(c)) if isinstance(kind, (T.ArrayType, T.MapType)) else F.char_length(c)).cast("long")


@function("substring", 2, 3)
def _substring(args: Sequence[Typed]) -> Column:
    """Positions from 1, or from the end if negative; position 0 is one place before the text, and a negative length goes left."""
    s, start = args[0].column, args[1].column.cast("int")
    n = F.char_length(s)
    zero = start == 0
    begin = F.when(start > 0, F.least(n, start - 1)).when(zero, F.lit(0)).otherwise(F.greatest(n + start, F.lit(0)))
    if len(args) == 2:
        return F.substr(s, begin + 1, n)
    length = args[2].column.cast("int")
    length = F.when(zero, F.greatest(length - 1, F.lit(0))).otherwise(length)
    left, right = F.when(length < 0, F.greatest(begin + length, F.lit(0))).otherwise(begin), F.when(length > 0, F.least(n, begin + length)).otherwise(begin)
    return F.substr(s, left + 1, right - left)


@function("split_part", 3)
def _split_part(args: Sequence[Typed]) -> Column:
    """Negative numbers count from the end; 0 gives '', and an empty delimiter parts all characters."""
    s, d, k = args[0].column, args[1].column, args[2].column.cast("int")
    n = F.char_length(s)
    at = F.when(k > 0, k).otherwise(n + k + 1)
    letter = F.when((at >= 1) & (at <= n), F.substr(s, at, F.lit(1))).otherwise("")
    safe_d, safe_k = F.when(d == "", F.lit(" ")).otherwise(d), F.when(k == 0, F.lit(1)).otherwise(k)
    part = F.when(k == 0, F.lit("")).when(d == "", letter).otherwise(F.split_part(s, safe_d, safe_k))
    return F.when(s.isNotNull() & d.isNotNull() & k.isNotNull(), part)


def _literal_text(a: Typed, what: str) -> str:
    if not a.is_literal or not isinstance(a.value, str):
        raise FrameError(BACKEND_ERROR, f"{what} must be a literal text.")
    return a.value


def java_replacement(text: str, shift: int) -> str:
    r"""A replacement with references \0 to \9 in Java's form, their numbers raised by shift."""

    def one(m: re.Match) -> str:
        if m[1] is not None:
            return f"${int(m[1]) + shift}"
        return r"\$" if m[0] == "$" else r"\\"

    return re.sub(r"\\(\d)|\\\\|\\|\$", one, text)


@function("regexp_replace", 3)
def _regexp_replace(args: Sequence[Typed]) -> Column:
    """The first match only: what precedes it is matched too, and put back."""
    pattern, by = _literal_text(args[1], "regexp_replace's pattern"), _literal_text(args[2], "regexp_replace's replacement")
    lead = "" if pattern.startswith("^") else r"[\s\S]*?"
    body = pattern.removeprefix("^") if not lead else pattern
    by = java_replacement(by, 2)
    by = re.sub(r"\$(\d+)(?=\d)", r"$\1\\", by)  # a digit after a reference isn't part of its number
    return F.regexp_replace(args[0].column, F.lit(f"^({lead})({body})"), F.lit("$1" + by))


@function("regexp_extract", 2, 3)
def _regexp_extract(args: Sequence[Typed]) -> Column:
    group = int(args[2].value) if len(args) == 3 and args[2].is_literal else 0
    return F.regexp_extract(args[0].column, _literal_text(args[1], "regexp_extract's pattern"), group)


# Nulls and choices

function("coalesce", 1, None)(lambda args: F.coalesce(*_same_type(args)))
function("greatest", 2, None)(lambda args: F.greatest(*_same_type(args)))
function("least", 2, None)(lambda args: F.least(*_same_type(args)))
plain("nullif", 2, F.nullif)


@function("clip", 3)
def _clip(args: Sequence[Typed]) -> Column:
    """Between low and high; null becomes low."""
    x, low, high = _same_type(args)
    return F.least(F.greatest(x, low), high)


# Lists

plain("list_length", 1, lambda c: F.when(c.isNotNull(), F.size(c)).cast("long"))
function("array", 1, None)(lambda args: F.array(*_same_type(args)))


@function("list_contains", 2)
def _list_contains(args: Sequence[Typed]) -> Column:
    """False if absent, null elements or not; null only for a null list or value."""
    xs, x = args[0].column, args[1].column
    if isinstance(args[0].type, T.ArrayType):
        x = x.cast(args[0].type.elementType)
    return F.when(xs.isNotNull() & x.isNotNull(), F.coalesce(F.array_contains(xs, x), F.lit(False)))


plain("hash", 1, lambda c: F.xxhash64(c))

from . import dates  # noqa: E402, F401  (registers the temporal functions)
