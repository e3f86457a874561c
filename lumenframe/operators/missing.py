"""Filling and dropping of nulls. NaN is a value, not a null."""

from __future__ import annotations

import decimal
import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from ..errors import BACKEND_ERROR, INVALID_ARGUMENT, FrameError
from ..params import text_list
from ..schema import everything, field, hidden, quoted, resolve
from ..typenames import is_fractional, is_integral, is_numeric
from .stretches import position, stretch_of


def coerced(value: Any, kind: T.DataType) -> Column:
    """The replacement in the column's type; texts are read as numbers or truth values where the column holds these."""
    wrong = FrameError(BACKEND_ERROR, f"'{value}' does not fit a column of type {kind.simpleString()}.")
    if isinstance(kind, T.StringType):
        return F.lit(("true" if value else "false") if isinstance(value, bool) else str(value))
    if isinstance(value, str):
        try:
            if is_integral(kind):
                value = int(value) if re.fullmatch(r"\s*[+-]?\d+\s*", value) else decimal.Decimal(value)
            elif is_fractional(kind):
                value = float(value)
            elif isinstance(kind, T.DecimalType):
                value = decimal.Decimal(value)
            elif isinstance(kind, T.BooleanType):
                value = {"true": True, "false": False}[value.strip().lower()]
        except (ValueError, KeyError, decimal.InvalidOperation):
            raise wrong from None
    if is_numeric(kind) and isinstance(value, bool):
        value = int(value)
    return F.lit(value).cast(kind)


def fillna(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    value, values, method = p.get("value"), p.get("values"), p.get("method")
    if values is not None and not isinstance(values, Mapping):
        raise FrameError(INVALID_ARGUMENT, "'values' maps columns to replacements.")
    if method is not None:
        if value is not None or values:
            raise FrameError(INVALID_ARGUMENT, "'method' can't be combined with 'value' or 'values'.")
        return _carry(df, str(method), p)
    if value is None and not values:
        raise FrameError(INVALID_ARGUMENT, "fillna needs 'value', 'values' or 'method'.")
    own = {resolve(k, df.columns): v for k, v in (values or {}).items()}
    out = []
    for c, column in everything(df):
        v = own[c] if c in own else value
        kind = df.schema[c].dataType
        fits = v is not None and not isinstance(kind, (T.ArrayType, T.StructType, T.MapType))
        out.append((F.coalesce(column, coerced(v, kind)) if fits else column).alias(c))
    return df.select(*out)


def _carry(df: DataFrame, method: str, p: Mapping[str, Any]) -> DataFrame:
    """The last known value before a row (ffill), or the next one after it (bfill)."""
    order = text_list("order_by", p.get("order_by"))
    if not order:
        raise FrameError(INVALID_ARGUMENT, f"'{method}' requires 'order_by'.")
    keys = [field(df, c)[1] for c in text_list("partition_by", p.get("partition_by"))]
    wanted = {resolve(c, df.columns) for c in text_list("columns", p.get("columns"))} or set(df.columns)
    by = [field(df, c)[1] for c in order]
    at = position(by[0], field(df, order[0])[2])
    if not keys and at is not None and (rows := df.count()) >= LONG:
        return _carry_far(df, method, by, at, wanted, rows)
    return df.select(*[(_nearest(c, method, Window.partitionBy(*keys).orderBy(*[o.asc_nulls_last() for o in by])) if n in wanted else c).alias(n) for n, c in everything(df)])


def _nearest(c: Column, method: str, rows: WindowSpec) -> Column:
    if method == "ffill":
        return F.coalesce(c, F.last(c, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return F.coalesce(c, F.first(c, ignorenulls=True).over(rows.rowsBetween(Window.currentRow, Window.unboundedFollowing)))


#: A sequence without partitions of so many rows is cut into stretches.
LONG = 4_000_000


def _carry_far(df: DataFrame, method: str, by: list[Column], at: Column, wanted: set[str], rows: int) -> DataFrame:
    """As one window, by stretches: each is given the last values of those before it, or the first ones of those after it."""
    split, of, *edges = (hidden(df, f"__{n}") for n in ("split", "of", *(f"e{k}" for k in range(len(wanted)))))
    names = sorted(wanted)
    # Null positions come last: the place is (is null, position, ...), as structs put nulls first.
    place = F.struct(*[x.alias(f"o{k}") for k, x in enumerate(y for c in by for y in (c.isNull(), c))])
    df2 = df.withColumn(split, stretch_of(df, at, rows))
    pick = F.max_by if method == "ffill" else F.min_by
    edge = df2.groupBy(split).agg(*[pick(quoted(n), F.when(quoted(n).isNotNull(), place)).alias(e) for n, e in zip(names, edges)])
    if method == "ffill":
        others, take = Window.orderBy(split).rowsBetween(Window.unboundedPreceding, -1), F.last
    else:
        others, take = Window.orderBy(split).rowsBetween(1, Window.unboundedFollowing), F.first
    told = edge.select(F.col(split).alias(of), *[take(e, ignorenulls=True).over(others).alias(e) for e in edges])  # one row for each stretch
    joined = df2.join(F.broadcast(told), F.col(split) == F.col(of))
    inside = Window.partitionBy(split).orderBy(*[o.asc_nulls_last() for o in by])
    filled = dict(zip(names, edges))
    return joined.select(*[(F.coalesce(_nearest(c, method, inside), F.col(filled[n])) if n in wanted else c).alias(n) for n, c in everything(df)])


def dropna(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    names = [resolve(c, df.columns) for c in text_list("columns", p.get("columns"))] or df.columns
    known = [quoted(c).isNotNull() for c in names]
    return df.filter(reduce((lambda a, b: a | b) if p.get("how") == "all" else (lambda a, b: a & b), known))
