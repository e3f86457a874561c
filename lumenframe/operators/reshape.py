"""Pivot, unpivot and unnest."""

from __future__ import annotations

import re
from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BACKEND_ERROR, INVALID_AGGREGATION, INVALID_ARGUMENT, INVALID_TYPE, FrameError
from ..params import is_array, text, text_list
from ..schema import field, project, quoted, resolve, unique_names
from ..typenames import common

PIVOT_AGGREGATES = {"sum": F.sum, "avg": lambda c: F.avg(c.cast("double")), "min": F.min, "max": F.max, "count": F.count}


#: Keys that a pivot may have; each names a column for each value.
MOST_KEYS = 10_000


def _pivot_values(df: DataFrame, p: Mapping[str, Any]) -> list[tuple[str, str, str | None]]:
    """(column, aggregate, alias) of each value."""
    values = p.get("values")
    if isinstance(values, str):
        specs = [{"column": values, "aggregation": p.get("aggregation") or "sum"}]
    elif is_array(values):
        if p.get("aggregation") is not None:
            raise FrameError(INVALID_ARGUMENT, "'aggregation' belongs into each entry where 'values' is an array.")
        specs = [v for v in values if v is not None]
        if not specs:
            raise FrameError(INVALID_ARGUMENT, "There is nothing in 'values' to aggregate.")
    else:
        raise FrameError(INVALID_TYPE, "'values' names one column, or lists objects with column, aggregation and alias.")
    out = []
    for s in specs:
        if not isinstance(s, Mapping) or text(s.get("column")) is None:
            raise FrameError(INVALID_ARGUMENT, "An entry of 'values' names no column.")
        name = str(s.get("aggregation") or "").lower()
        if name not in PIVOT_AGGREGATES:
            raise FrameError(INVALID_AGGREGATION, f"A pivot can't aggregate by '{name}'; known: {', '.join(PIVOT_AGGREGATES)}.")
        out.append((resolve(s["column"], df.columns), name, text(s.get("alias"))))
    return out


def pivot(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    """A row for each index, columns for each key (but null), ascending. The keys are found first, as they name the columns."""
    index = [resolve(c, df.columns) for c in text_list("index", p["index"])]
    if not index:
        raise FrameError(INVALID_ARGUMENT, "A pivot needs index columns.")
    values = _pivot_values(df, p)
    key, key_column, _ = field(df, p["columns"])
    keys = [r[0] for r in df.select(key_column).filter(key_column.isNotNull()).distinct().orderBy(key_column).limit(MOST_KEYS + 1).collect()]
    if len(keys) > MOST_KEYS:
        raise FrameError(INVALID_ARGUMENT, f"Column '{key}' has more than {MOST_KEYS} values; a pivot can't have as many columns.", column=key)
    names = [f"i{k}" for k in range(len(index))]
    grouped = df.select(*[quoted(c).alias(n) for c, n in zip(index, names)], key_column.alias("key"), *[quoted(c).alias(f"v{k}") for k, (c, _, _) in enumerate(values)]).groupBy(*names)
    if not keys:
        return grouped.agg(F.count("*").alias("n")).select(*[F.col(n).alias(c) for n, c in zip(names, index)])
    cells = grouped.pivot("key", keys).agg(*[PIVOT_AGGREGATES[a](F.col(f"v{k}")).alias(f"a{k}") for k, (_, a, _) in enumerate(values)])
    labels = [r[0] for r in df.sparkSession.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("k", df.schema[key].dataType)])).select(F.col("k").cast("string")).collect()]
    single = len(values) == 1 and values[0][2] is None
    out_names = [label if single else f"{label}_{alias or f'{a}({c})'}" for label in labels for c, a, alias in values]
    aggregates = [a for _ in labels for _, a, _ in values]
    cells = cells.toDF(*names, *[f"c{k}" for k in range(len(out_names))])
    filled: list[Column] = [F.coalesce(F.col(f"c{k}"), F.lit(0)) if a == "count" else F.col(f"c{k}") for k, a in enumerate(aggregates)]
    return project(cells, [*[(c, F.col(n)) for c, n in zip(index, names)], *zip(out_names, filled)])


def unpivot(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    """Columns to rows; null values give none."""
    ids = [resolve(c, df.columns) for c in text_list("id_columns", p.get("id_columns"))]
    values = [resolve(c, df.columns) for c in text_list("value_columns", p.get("value_columns"))]
    if not values:
        raise FrameError(INVALID_ARGUMENT, "There are no columns to unpivot.")
    if set(ids) & set(values):
        raise FrameError(INVALID_ARGUMENT, "A column can't be both an id and a value.")
    name_to, value_to = text(p.get("name_to")) or "name", text(p.get("value_to")) or "value"
    for n in (name_to, value_to):
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", n):
            raise FrameError(INVALID_ARGUMENT, f"'{n}' is not a valid column name.")
    kinds = [df.schema[c].dataType for c in values]
    if len({isinstance(k, T.StringType) for k in kinds}) > 1:
        raise FrameError(BACKEND_ERROR, "Texts and other values can't be unpivoted into one column.")
    kind = reduce(common, kinds)
    narrowed = df.select(*[quoted(c).alias(f"i{k}") for k, c in enumerate(ids)], *[quoted(c).cast(kind).alias(f"v{k}") for k, c in enumerate(values)])
    pairs = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"v{k}").alias("value")) for k, c in enumerate(values)])
    rows = narrowed.select(*[F.col(f"i{k}") for k in range(len(ids))], F.inline(F.filter(pairs, lambda x: x["value"].isNotNull())))
    return project(rows, [*[(c, F.col(f"i{k}")) for k, c in enumerate(ids)], (name_to, F.col("name")), (value_to, F.col("value"))])


def unnest(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    """A row for each element, the column last and named as asked for; a struct becomes columns."""
    own, c, kind = field(df, p["column"])
    others = [x for x in df.columns if x != own]
    if isinstance(kind, T.StructType):
        return project(df, [*[(x, quoted(x)) for x in others], *[(f.name, c.getField(f.name)) for f in kind.fields]])
    if not isinstance(kind, T.ArrayType):
        raise FrameError(BACKEND_ERROR, f"Column '{own}' is not a list.")
    names = unique_names([*others, str(p["column"])])
    return df.select(*[quoted(x).alias(n) for x, n in zip(others, names)], F.explode(c).alias(names[-1]))
