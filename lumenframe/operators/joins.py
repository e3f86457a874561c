"""Joins: equality joins of all kinds, cross, and the nearest match in time (as-of)."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import INVALID_ARGUMENT, FrameError
from ..params import text, text_list
from ..schema import field, project, quoted, resolve
from ..typenames import common
from .stretches import position, stretch_of

KINDS = ("inner", "left", "right", "full", "semi", "anti", "cross", "asof")
_SPARK_KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


def _keys(left: DataFrame, right: DataFrame, p: Mapping[str, Any]) -> list[tuple[str, str]]:
    on = text_list("on", p.get("on"))
    if on:
        return [(resolve(k, left.columns), resolve(k, right.columns)) for k in on]
    a, b = text_list("left_on", p.get("left_on")), text_list("right_on", p.get("right_on"))
    if not a or len(a) != len(b):
        raise FrameError(INVALID_ARGUMENT, "A join needs 'on', or 'left_on' and 'right_on' of equal length.")
    return [(resolve(x, left.columns), resolve(y, right.columns)) for x, y in zip(a, b)]


def _right_names(left: DataFrame, right: DataFrame, drop: set[str], suffix: str) -> list[tuple[str, str]]:
    """(column, name in the result) of the right side: keys are left out, overlapping names get the suffix."""
    taken = {c.lower() for c in left.columns}
    return [(c, c + suffix if c.lower() in taken else c) for c in right.columns if c.lower() not in drop]


def join(left: DataFrame, right: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    how, suffix = str(p.get("how") or "inner"), text(p.get("suffix")) or "_right"
    if how not in KINDS:
        raise FrameError(INVALID_ARGUMENT, f"Joins are of these kinds: {', '.join(KINDS)}.")
    # Own names for both sides, so that a frame can be joined with itself.
    l_cols, r_cols = [f"l{i}" for i in range(len(left.columns))], [f"r{i}" for i in range(len(right.columns))]
    l_of, r_of = dict(zip(left.columns, l_cols)), dict(zip(right.columns, r_cols))
    lf, rf = left.toDF(*l_cols), right.toDF(*r_cols)
    if how == "cross":
        columns = [(c, F.col(l_of[c])) for c in left.columns] + [(n, F.col(r_of[c])) for c, n in _right_names(left, right, set(), suffix)]
        return project(lf.crossJoin(rf), columns)
    keys = _keys(left, right, p)
    if how == "asof":
        return _asof(left, right, keys, str(p.get("asof_op") or ">="), suffix)
    matched = reduce(lambda a, b: a & b, [F.col(l_of[a]) == F.col(r_of[b]) for a, b in keys])
    joined = lf.join(rf, matched, _SPARK_KINDS[how])
    columns: list[tuple[str, Column]] = []
    partner = {a: b for a, b in keys}
    for c in left.columns:
        both = how in ("right", "full") and c in partner
        columns.append((c, F.coalesce(F.col(l_of[c]), F.col(r_of[partner[c]])) if both else F.col(l_of[c])))
    if how not in ("semi", "anti"):
        columns += [(n, F.col(r_of[c])) for c, n in _right_names(left, right, {b.lower() for _, b in keys}, suffix)]
    return project(joined, columns)


def _asof(left: DataFrame, right: DataFrame, keys: list[tuple[str, str]], op: str, suffix: str) -> DataFrame:
    """For each left row the nearest right row at or before its time (>=), or at or after it (<=); rows without one go.

    Both sides are merged by time and the last right row is carried along, so there is one
    sort by key and time and no pairwise comparison. Long sequences, of a key with very many
    rows or without equality keys, are cut into stretches of time, each of which is given the
    last right row before it.
    """
    if op not in (">=", "<="):
        raise FrameError(INVALID_ARGUMENT, "'asof_op' must be '>=' or '<='.")
    kinds = [common(field(left, a)[2], field(right, b)[2]) for a, b in keys]
    names = [f"k{i}" for i in range(len(keys))]
    l_row, r_row = F.struct(*[quoted(c) for c in left.columns]), F.struct(*[quoted(c) for c in right.columns])
    l_type, r_type = left.select(l_row.alias("x")).schema[0].dataType, right.select(r_row.alias("x")).schema[0].dataType
    l_side = left.select(*[quoted(a).cast(k).alias(n) for (a, _), k, n in zip(keys, kinds, names)], F.lit(1).alias("side"), l_row.alias("l"), F.lit(None).cast(r_type).alias("r"))
    r_side = right.select(*[quoted(b).cast(k).alias(n) for (_, b), k, n in zip(keys, kinds, names)], F.lit(0).alias("side"), F.lit(None).cast(l_type).alias("l"), r_row.alias("r"))
    known = reduce(lambda a, b: a & b, [F.col(n).isNotNull() for n in names])
    merged = l_side.unionAll(r_side).filter(known)
    at, parts, order = position(F.col(names[-1]), kinds[-1]), names[:-1], [F.col("at").asc(), F.col("side").asc(), F.col("r").asc()]
    if at is None:  # texts and the like: no distances, so no stretches
        order[0] = F.col("at").asc() if op == ">=" else F.col("at").desc()
        merged = merged.withColumn("at", F.col(names[-1])).withColumn("before", F.lit(None).cast(r_type))
    else:
        merged = _in_stretches(merged.withColumn("at", at if op == ">=" else -at), parts, r_type)
        parts = [*parts, "split"]
    window = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = merged.withColumn("match", F.coalesce(F.last("r", ignorenulls=True).over(window), F.col("before")))
    found = merged.filter(F.col("l").isNotNull() & F.col("match").isNotNull())
    columns = [(c, F.col("l")[c]) for c in left.columns]
    columns += [(n, F.col("match")[c]) for c, n in _right_names(left, right, {b.lower() for _, b in keys}, suffix)]
    return project(found, columns)


#: A key with so many rows is cut into stretches.
LONG = 4_000_000


def _in_stretches(merged: DataFrame, keys: list[str], r_type: T.DataType) -> DataFrame:
    """Rows with their stretch (0 for all rows of a short sequence) and, as ``before``, the last right row of the stretches before it."""
    short = merged.withColumn("split", F.lit(0)).withColumn("before", F.lit(None).cast(r_type))
    rows = merged.count()
    if rows < LONG:
        return short
    if keys:
        long = merged.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") >= LONG)  # rows / LONG keys at most
        hot = long.select(*[F.col(k).alias(f"hot_{k}") for k in keys], F.lit(True).alias("hot"))
        merged = merged.join(F.broadcast(hot), reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"hot_{k}")) for k in keys]), "left").drop(*[f"hot_{k}" for k in keys])
        split = F.when(F.col("hot"), stretch_of(merged.filter("hot"), F.col("at"), rows)).otherwise(0)
    else:
        merged, split = merged.withColumn("hot", F.lit(True)), stretch_of(merged, F.col("at"), rows)
    merged = merged.withColumn("split", split)
    last = merged.filter("hot").groupBy(*keys, "split").agg(F.max_by("r", F.when(F.col("side") == 0, F.struct("at", "r"))).alias("last"))
    earlier = Window.partitionBy(*keys).orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a few thousand rows for each long sequence
    before = last.select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("split").alias("of_split"), F.last("last", ignorenulls=True).over(earlier).alias("before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in keys], F.col("hot") & (F.col("split") == F.col("of_split")))
    return merged.join(F.broadcast(before), same, "left").drop("hot", "of_split", *[f"of_{k}" for k in keys])
