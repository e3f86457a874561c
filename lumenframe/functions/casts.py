"""Casts that round where Spark's would cut off.

Fractions become whole numbers by rounding: floating ones half to even, decimals and texts half up.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..typenames import is_fractional, is_integral

#: Room for 20 digits before the point, so that every BIGINT fits.
_WIDE = T.DecimalType(38, 18)


def _whole(c: Column, source: T.DataType, safe: bool) -> Column:
    if is_fractional(source):
        return F.rint(c)
    if isinstance(source, T.DecimalType):
        return F.round(c, 0)
    if isinstance(source, T.StringType):
        return F.round(c.try_cast(_WIDE) if safe else c.cast(_WIDE), 0)
    return c


def cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    return (_whole(c, source, False) if is_integral(target) else c).cast(target)


def try_cast(c: Column, source: T.DataType, target: T.DataType) -> Column:
    """Null where the cast would fail."""
    return (_whole(c, source, True) if is_integral(target) else c).try_cast(target)
