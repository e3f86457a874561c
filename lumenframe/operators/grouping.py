"""Grouped aggregation and value counts."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import INVALID_AGGREGATION, INVALID_PREDICATE, FrameError
from ..functions.aggregates import AGGREGATES
from ..functions.registry import Typed
from ..params import is_array, text, to_bool, to_int, to_number
from ..plans import predicates
from ..schema import field, unique_names


def _fail(message: str) -> FrameError:
    return FrameError(INVALID_AGGREGATION, message)


def aggregate(df: DataFrame, spec: Any) -> tuple[str, Column]:
    """(alias, column) of an aggregation entry."""
    if not isinstance(spec, Mapping):
        raise _fail("An aggregation is an object.")
    name, column = str(spec.get("function") or "").lower(), text(spec.get("column"))
    if name not in AGGREGATES:
        raise _fail(f"There is no aggregate function '{spec.get('function')}'.")
    if column is None:
        raise _fail(f"'{name}' requires a 'column'.")
    kind, second, q = AGGREGATES[name], text(spec.get("column2")), spec.get("q")
    if kind.needs_second and second is None:
        raise _fail(f"'{name}' needs a second column, 'column2'.")
    if not kind.needs_second and second is not None:
        raise _fail(f"'{name}' does not take 'column2'.")
    if kind.needs_q:
        q = to_number(q) if q is not None and not isinstance(q, bool) else None
        if q is None or not 0 <= q <= 1:
            raise _fail(f"'{name}' needs a 'q' from 0 to 1.")
    elif q is not None:
        raise _fail(f"'{name}' does not take 'q'.")
    if column == "*":
        if name != "count":
            raise _fail(f"Only count can count rows by '*'; '{name}' can't.")
        return text(spec.get("alias")) or "count_*", F.count("*")
    own, c, dtype = field(df, column)
    other = Typed(*field(df, second)[1:]) if second else None
    alias = text(spec.get("alias")) or "_".join([name, own, *([resolve_name(df, second)] if second else [])])
    return alias, kind.build(Typed(c, dtype), other, q)


def resolve_name(df: DataFrame, name: str) -> str:
    return field(df, name)[0]


def group_by(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    """Keys, then aggregates. HAVING sees both; a key wins over an aggregate of its name."""
    if not is_array(p.get("group_by")) or not is_array(p.get("aggregations")):
        raise _fail("Keys and aggregations come as arrays.")
    keys = [field(df, str(k))[:2] for k in p["group_by"]]
    found = [aggregate(df, a) for a in p["aggregations"]]
    if not found:
        raise _fail("There is nothing to aggregate.")
    hidden = [f"k{i}" for i in range(len(keys))], [f"a{i}" for i in range(len(found))]
    out = df.groupBy(*[c.alias(h) for (_, c), h in zip(keys, hidden[0])]).agg(*[c.alias(h) for (_, c), h in zip(found, hidden[1])])
    names = [n for n, _ in keys] + [a for a, _ in found]
    if p.get("having") is not None:
        if not isinstance(p["having"], Mapping):
            raise FrameError(INVALID_PREDICATE, "'having' takes a predicate.")
        out = out.filter(predicates.to_column(predicates.parse(p["having"]), _having(out, names, hidden[0] + hidden[1])))
    return out.select(*[F.col(h).alias(n) for h, n in zip(hidden[0] + hidden[1], unique_names(names))])


def _having(out: DataFrame, names: list[str], columns: list[str]) -> predicates.Resolver:
    def resolve(name: str):
        for n, c in zip(names, columns):
            if n.lower() == name.lower():
                return F.col(c), out.schema[c].dataType
        raise FrameError(INVALID_PREDICATE, f"'having' knows keys and aliases; '{name}' is neither.", column=name)

    return resolve


def value_counts(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    """Values with count and proportion, most frequent first."""
    own, c, _ = field(df, p["column"])
    rows = df if to_bool(p.get("dropna")) is False else df.filter(c.isNotNull())
    counts = rows.groupBy(c.alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    out = counts.crossJoin(F.broadcast(total)).orderBy(F.desc("n"), F.col("value").asc_nulls_last())
    limit = to_int(p.get("limit"))
    out = out.limit(limit) if limit is not None else out
    names = unique_names([own, "count", "proportion"])
    return out.select(F.col("value").alias(names[0]), F.col("n").alias(names[1]), (F.col("n") / F.col("total")).alias(names[2]))


