"""The closed set of aggregate functions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import Typed


@dataclass(frozen=True)
class Aggregate:
    """build gets the column, the second column and the quantile; only where they are needed."""

    build: Callable[[Typed, Typed | None, float | None], Column]
    needs_q: bool = False
    needs_second: bool = False


def _double(c: Typed) -> Column:
    return c.column.cast("double")


def _list(c: Typed) -> Column:
    """Nulls are kept; no rows at all give null."""
    return F.when(F.count("*") > 0, F.transform(F.collect_list(F.struct(c.column.alias("x"))), lambda s: s["x"]))


def _by(pick: Callable[[Column, Column], Column]) -> Callable[[Typed, Typed, None], Column]:
    """Rows where the returned value is null don't compete."""
    return lambda c, by, _: pick(c.column, F.when(c.column.isNotNull(), by.column))


def _quantile(c: Typed, q: float) -> Column:
    found = F.percentile(c.column, F.lit(q))
    return found.cast(c.type) if isinstance(c.type, T.DecimalType) else found


def _one(build: Callable[[Column], Column]) -> Aggregate:
    return Aggregate(lambda c, _, __: build(c.column))


def _floating(build: Callable[[Column], Column]) -> Aggregate:
    return Aggregate(lambda c, _, __: build(_double(c)))


AGGREGATES: dict[str, Aggregate] = {
    "count": _one(F.count),
    "count_distinct": _one(F.count_distinct),
    "approx_count_distinct": _one(F.approx_count_distinct),
    "sum": _one(F.sum),
    "product": _floating(F.product),
    "avg": _floating(F.avg),
    "min": _one(F.min),
    "max": _one(F.max),
    "median": Aggregate(lambda c, _, __: _quantile(c, 0.5)),
    "mode": _one(F.mode),
    "stddev": _floating(F.stddev_samp),
    "stddev_samp": _floating(F.stddev_samp),
    "stddev_pop": _floating(F.stddev_pop),
    "var": _floating(F.var_samp),
    "var_samp": _floating(F.var_samp),
    "var_pop": _floating(F.var_pop),
    "bool_and": _one(F.bool_and),
    "bool_or": _one(F.bool_or),
    "first": _one(F.first),
    "last": _one(F.last),
    "list": Aggregate(lambda c, _, __: _list(c)),
    "quantile": Aggregate(lambda c, _, q: _quantile(c, q), needs_q=True),
    "approx_quantile": Aggregate(lambda c, _, q: F.percentile_approx(c.column, F.lit(q)), needs_q=True),
    "corr": Aggregate(lambda c, by, _: F.corr(_double(c), _double(by)), needs_second=True),
    "covar": Aggregate(lambda c, by, _: F.covar_samp(_double(c), _double(by)), needs_second=True),
    "arg_min": Aggregate(_by(F.min_by), needs_second=True),
    "arg_max": Aggregate(_by(F.max_by), needs_second=True),
}
