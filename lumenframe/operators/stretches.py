"""Cutting a long sequence into stretches, so that values can be carried along it by many tasks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a stretch, by expectation; fewest and most stretches (a square: two levels of cuts).
ROWS, FEWEST, SIDE = 1_000_000, 64, 64


def position(t: Column, kind: T.DataType) -> Column | None:
    """Times and numbers as numbers; None for other types."""
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(t.cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(t)
    if isinstance(kind, T.DateType):
        return F.unix_date(t)
    return t if isinstance(kind, T.NumericType) else None


def _passed(at: Column, cuts: list) -> Column:
    """How many ascending cuts a position has reached."""
    return reduce(lambda a, b: a + b, [(at >= F.lit(c)).cast("int") for c in cuts], F.lit(0))


def stretch_of(df: DataFrame, at: Column, rows: int, rows_each: int = ROWS, side: int = SIDE) -> Column:
    """The number of a row's stretch; they ascend with the position. Null positions are in the last one."""
    wanted = min(side * side, max(FEWEST, -(-rows // rows_each)))
    quantiles = [k / wanted for k in range(1, wanted)]
    cuts = sorted(set(df.agg(F.percentile_approx(at, quantiles, max(10_000, 4 * wanted))).first()[0] or []))
    if len(cuts) < side:
        return F.coalesce(_passed(at, cuts), F.lit(len(cuts)))
    # Two levels: the outer cuts, and those between two of them from a table of cuts.
    each = -(-(len(cuts) + 1) // side)
    outer = cuts[each - 1 :: each]
    inner = [cuts[k * each : (k + 1) * each - 1] for k in range(len(outer) + 1)]
    nothing = F.array().cast(f"array<{'double' if isinstance(cuts[0], float) else 'decimal(38,18)' if not isinstance(cuts[0], int) else 'bigint'}>")
    table = F.array(*[F.array(*[F.lit(c) for c in part]) if part else nothing for part in inner])
    first = _passed(at, outer)
    second = F.size(F.filter(F.element_at(table, first + 1), lambda c: c <= at))
    return F.coalesce(first * each + second, F.lit(len(cuts)))
