"""Type names of the response contract (VARCHAR, BIGINT, DECIMAL(12,2), T[], STRUCT(...)) and Spark types."""

from __future__ import annotations

import re

from pyspark.sql import types as T

from .errors import INVALID_TYPE, FrameError

_SIMPLE: dict[type, str] = {
    T.BooleanType: "BOOLEAN",
    T.ByteType: "TINYINT",
    T.ShortType: "SMALLINT",
    T.IntegerType: "INTEGER",
    T.LongType: "BIGINT",
    T.FloatType: "FLOAT",
    T.DoubleType: "DOUBLE",
    T.StringType: "VARCHAR",
    T.BinaryType: "BLOB",
    T.DateType: "DATE",
    T.TimestampNTZType: "TIMESTAMP",
    T.TimestampType: "TIMESTAMP WITH TIME ZONE",
    T.NullType: '"NULL"',
}

# Accepted spellings. Unsigned types take the next wider signed one.
_SPELLINGS: dict[T.DataType, str] = {
    T.BooleanType(): "BOOLEAN BOOL LOGICAL",
    T.ByteType(): "TINYINT INT1",
    T.ShortType(): "SMALLINT INT2 SHORT UTINYINT",
    T.IntegerType(): "INTEGER INT INT4 SIGNED USMALLINT",
    T.LongType(): "BIGINT INT8 LONG UINTEGER",
    T.DecimalType(20, 0): "UBIGINT",
    T.DecimalType(38, 0): "HUGEINT",
    T.FloatType(): "FLOAT REAL FLOAT4",
    T.DoubleType(): "DOUBLE FLOAT8",
    T.StringType(): "VARCHAR TEXT STRING CHAR BPCHAR UUID TIME",
    T.BinaryType(): "BLOB BYTEA BINARY VARBINARY",
    T.DateType(): "DATE",
    T.TimestampNTZType(): "TIMESTAMP DATETIME",
    T.TimestampType(): "TIMESTAMPTZ",
}
_BY_NAME = {name: kind for kind, names in _SPELLINGS.items() for name in names.split()}


def _ident(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) else '"' + name.replace('"', '""') + '"'


def render(kind: T.DataType) -> str:
    if isinstance(kind, T.DecimalType):
        return f"DECIMAL({kind.precision},{kind.scale})"
    if isinstance(kind, T.ArrayType):
        return render(kind.elementType) + "[]"
    if isinstance(kind, T.StructType):
        return "STRUCT(" + ", ".join(f"{_ident(f.name)} {render(f.dataType)}" for f in kind.fields) + ")"
    if isinstance(kind, T.MapType):
        return f"MAP({render(kind.keyType)}, {render(kind.valueType)})"
    return _SIMPLE.get(type(kind), kind.simpleString().upper())


def parse(text: str) -> T.DataType:
    """Spark type of a type name; INVALID_TYPE if it is unknown."""
    name = re.sub(r"\s+", " ", text.strip()).upper()
    if name in ("TIMESTAMP WITH TIME ZONE", "TIMESTAMP_TZ"):
        return T.TimestampType()
    found = re.fullmatch(r"([A-Z0-9_]+) ?(?:\( ?(\d+) ?(?:, ?(\d+) ?)?\))?", name)
    if found:
        base, p, s = found.groups()
        if base in ("DECIMAL", "NUMERIC"):
            precision, scale = (18, 3) if p is None else (int(p), int(s or 0))
            if 1 <= precision <= 38 and scale <= precision:
                return T.DecimalType(precision, scale)
        elif base in _BY_NAME and (p is None or isinstance(_BY_NAME[base], T.StringType)):
            return _BY_NAME[base]
    raise FrameError(INVALID_TYPE, f"Type '{text}' is not supported.", type=text)


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def is_integral(kind: T.DataType) -> bool:
    return isinstance(kind, T.IntegralType)


def is_fractional(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def is_orderable_scalar(kind: T.DataType) -> bool:
    """Kinds of which profiles give minimum and maximum."""
    return isinstance(kind, (T.NumericType, T.StringType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def common(a: T.DataType, b: T.DataType) -> T.DataType:
    """The type that values of both take in a union: strings win, then the wider number or time."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, T.StringType) or isinstance(b, T.StringType):
        return T.StringType()
    if is_numeric(a) and is_numeric(b):
        if is_fractional(a) or is_fractional(b):
            return T.FloatType() if isinstance(a, T.FloatType) and isinstance(b, T.FloatType) else T.DoubleType()
        if isinstance(a, T.DecimalType) or isinstance(b, T.DecimalType):
            digits = {T.ByteType: 3, T.ShortType: 5, T.IntegerType: 10, T.LongType: 19}
            (wa, sa), (wb, sb) = ((x.precision - x.scale, x.scale) if isinstance(x, T.DecimalType) else (digits[type(x)], 0) for x in (a, b))
            scale = max(sa, sb)
            return T.DecimalType(min(38, max(wa, wb) + scale), scale)
        order = [T.ByteType, T.ShortType, T.IntegerType, T.LongType]
        return order[max(order.index(type(a)), order.index(type(b)))]()
    times = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, times) and isinstance(b, times):
        return times[max(times.index(type(a)), times.index(type(b)))]()
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common(a.elementType, b.elementType))
    if isinstance(a, T.BooleanType) and is_numeric(b):
        return b
    if isinstance(b, T.BooleanType) and is_numeric(a):
        return a
    return T.StringType()
