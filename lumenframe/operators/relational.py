"""Projection, filter, order, distinct rows, set union, sample."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import COLUMN_NOT_FOUND, INVALID_ARGUMENT, INVALID_PREDICATE, SCHEMA_MISMATCH, FrameError
from ..params import is_array, text, text_list, to_bool, to_int
from ..plans.expressions import compile_expression
from ..plans.predicates import where
from ..schema import everything, field, hidden, project, quoted, resolve
from ..typenames import common

Request = Mapping[str, Any]


def order_key(c: Column, descending: bool, nulls_first: bool = False) -> Column:
    """Nulls go last in both directions unless asked for."""
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


def is_desc(x: Any) -> bool:
    return str(x).lower() == "desc"


def select(df: DataFrame, p: Request) -> DataFrame:
    columns = []
    for item in p["columns"]:
        if isinstance(item, str):
            own = resolve(item, df.columns)
            columns.append((own, quoted(own)))
        elif isinstance(item, Mapping) and text(item.get("column")):
            own = resolve(item["column"], df.columns)
            columns.append((text(item.get("as")) or own, quoted(own)))
        else:
            raise FrameError(INVALID_ARGUMENT, "An entry of 'columns' is a name, or an object with 'column' and 'as'.")
    if not columns:
        raise FrameError(INVALID_ARGUMENT, "No columns were selected.")
    return project(df, columns)


def rename(df: DataFrame, p: Request) -> DataFrame:
    names = p["columns"]
    if not isinstance(names, Mapping) or not names:
        raise FrameError(INVALID_ARGUMENT, "'columns' maps old names to new ones, and needs one at least.")
    by_lower, new_names = {c.lower(): c for c in df.columns}, {}
    for old, new in names.items():
        if text(new) is None:
            raise FrameError(INVALID_ARGUMENT, f"'{old}' gets no new name.")
        if str(old).lower() not in by_lower:
            raise FrameError(COLUMN_NOT_FOUND, f"Column '{old}' does not exist in the dataset.", column=old)
        new_names[by_lower[str(old).lower()]] = str(new)
    after = [new_names.get(c, c) for c in df.columns]
    if len(set(after)) < len(after):
        raise FrameError(INVALID_ARGUMENT, "Two columns would have the same name.")
    return df.select(*[quoted(c).alias(a) for c, a in zip(df.columns, after)])


def with_column(df: DataFrame, p: Request) -> DataFrame:
    """Replaces the column in its place, under the name as given, or appends it."""
    name = text(p["name"])
    if name is None:
        raise FrameError(INVALID_ARGUMENT, "The column needs a name.")
    if not isinstance(p["expression"], Mapping):
        raise FrameError(INVALID_PREDICATE, "An expression is a tree of objects.")
    value, columns, found = compile_expression(df, p["expression"]), [], False
    for c, own in everything(df):
        same = c.lower() == name.lower()
        found |= same
        columns.append((name, value) if same else (c, own))
    return project(df, columns if found else [*columns, (name, value)])


def filter_rows(df: DataFrame, p: Request) -> DataFrame:
    if not isinstance(p["predicate"], Mapping):
        raise FrameError(INVALID_PREDICATE, "A predicate is a tree of objects.")
    return df.filter(where(df, p["predicate"]))


def order_columns(df: DataFrame, entries: Any, flip: bool = False, with_nulls: bool = True) -> list[Column]:
    out = []
    for e in entries or ():
        if not isinstance(e, Mapping) or text(e.get("column")) is None:
            raise FrameError(INVALID_ARGUMENT, "An entry of the order is an object with 'column' and 'direction'.")
        first = with_nulls and str(e.get("nulls")).lower() == "first"
        out.append(order_key(field(df, e["column"])[1], is_desc(e.get("direction")) != flip, first))
    return out


def sort(df: DataFrame, p: Request) -> DataFrame:
    """Ties keep the order in which rows are read. With a limit only the first rows travel."""
    keys = order_columns(df, p["by"])
    if not keys:
        raise FrameError(INVALID_ARGUMENT, "There is nothing to sort by.")
    tie = hidden(df, "__row")
    out = df.withColumn(tie, F.monotonically_increasing_id()).orderBy(*keys, tie)
    limit = to_int(p.get("limit"))
    return (out.limit(limit) if limit is not None else out).drop(tie)


def distinct(df: DataFrame, p: Request) -> tuple[DataFrame, list[str]]:
    names, last = text_list("columns", p.get("columns")), str(p.get("keep") or "first").lower() == "last"
    entries = list(p["order_by"]) if is_array(p.get("order_by")) else []
    if not names:
        if last:
            raise FrameError(INVALID_ARGUMENT, "Whole rows that are equal leave nothing to 'keep'.")
        if entries:
            raise FrameError(INVALID_ARGUMENT, "Whole rows that are equal have no order.")
        return df.distinct(), []
    keys = [field(df, n)[1] for n in names]
    order = order_columns(df, entries, flip=last, with_nulls=False)
    if order:  # only the first row of each key in each partition is shuffled
        rank = hidden(df, "__rank")
        window = Window.partitionBy(*keys).orderBy(*order)
        out = df.withColumn(rank, F.row_number().over(window)).filter(quoted(rank) == 1).drop(rank)
    else:
        out = df.dropDuplicates([field(df, n)[0] for n in names])
    out = out.orderBy(*[k.asc_nulls_last() for k in keys])
    return out, [] if order else ["distinct on a column subset without 'order_by' is non-deterministic about which row is kept."]


def union(frames: Sequence[DataFrame], p: Request) -> DataFrame:
    """Types are widened first; a text on one side makes the column text."""
    by_name, once = bool(to_bool(p.get("by_name"))), bool(to_bool(p.get("distinct")))
    try:
        return _union(frames, by_name, once)
    except AnalysisException as e:
        raise FrameError(SCHEMA_MISMATCH, str(e)) from e


def _union(frames: Sequence[DataFrame], by_name: bool, once: bool) -> DataFrame:
    if by_name:
        names: dict[str, str] = {}
        for f in frames:
            for c in f.columns:
                names.setdefault(c.lower(), c)
        parts = [{c.lower(): c for c in f.columns} for f in frames]
        lookup = [[part.get(n) for n in names] for part in parts]
    else:
        width = len(frames[0].columns)
        if any(len(f.columns) != width for f in frames):
            raise FrameError(SCHEMA_MISMATCH, "Datasets of a union must have as many columns each.")
        names = {str(k): c for k, c in enumerate(frames[0].columns)}
        lookup = [list(f.columns) for f in frames]
    kinds = [reduce(common, [f.schema[own[k]].dataType for f, own in zip(frames, lookup) if own[k] is not None]) for k in range(len(names))]
    aligned = [f.select(*[(quoted(c).cast(kind) if c is not None else F.lit(None).cast(kind)).alias(n) for c, kind, n in zip(own, kinds, names.values())]) for f, own in zip(frames, lookup)]
    out = reduce(DataFrame.unionAll, aligned)
    return out.distinct() if once else out


def sample(df: DataFrame, p: Request) -> DataFrame:
    """The rows with the smallest seeded hashes: the same for any partitioning, but for the choice among equal rows."""
    return df.orderBy(F.xxhash64(F.lit(to_int(p["seed"])), *[quoted(c) for c in df.columns])).limit(to_int(p["n"]))
