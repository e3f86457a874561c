"""Temporal functions. Units and formats are closed sets, and literal."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import BACKEND_ERROR, INVALID_PREDICATE, FrameError
from .registry import Typed, function

# Accepted units, singular and plural.
_UNITS = {
    "year": "years", "month": "months", "day": "days", "hour": "hours", "minute": "minutes", "second": "seconds",
    "quarter": "quarters", "week": "weeks", "millisecond": "milliseconds", "microsecond": "microseconds",
    "nanosecond": "nanoseconds", "decade": "decades", "century": "centuries", "millennium": "millenniums",
}
_SINGULAR = {name: one for one, many in _UNITS.items() for name in (one, many)}
_ADDABLE = ("year", "month", "day", "hour", "minute", "second")
_YEARS = {"decade": 10, "century": 100, "millennium": 1000}
_MICROS = {"hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000, "microsecond": 1}

# Accepted formats of strptime.
FORMATS = (
    "%Y-%m-%d", "%Y/%m/%d", "%Y.%m.%d", "%Y%m%d", "%m/%d/%Y", "%m-%d-%Y", "%d/%m/%Y", "%d-%m-%Y", "%d.%m.%Y",
    "%d-%b-%y", "%d-%b-%Y", "%d %b %Y", "%d %B %Y", "%b %d, %Y", "%B %d, %Y",
    "%Y-%m-%d %H:%M", "%Y-%m-%d %H:%M:%S", "%Y-%m-%d %H:%M:%S.%f",
    "%Y-%m-%dT%H:%M", "%Y-%m-%dT%H:%M:%S", "%Y-%m-%dT%H:%M:%S.%f", "%Y-%m-%dT%H:%M:%SZ", "%Y-%m-%dT%H:%M:%S.%fZ",
    "%m/%d/%Y %H:%M", "%m/%d/%Y %H:%M:%S", "%d/%m/%Y %H:%M:%S", "%Y%m%d%H%M%S", "%H:%M", "%H:%M:%S", "%H:%M:%S.%f",
)


def unit_of(a: Typed, allowed: Sequence[str] = tuple(_UNITS)) -> str:
    if not a.is_literal or not isinstance(a.value, str) or not a.value.strip():
        raise FrameError(INVALID_PREDICATE, "The unit must be a literal text.")
    unit = _SINGULAR.get(a.value)
    if unit is None or unit not in allowed:
        raise FrameError(INVALID_PREDICATE, f"Date/time unit '{a.value}' is not in the closed vocabulary.")
    if unit == "nanosecond":
        raise FrameError(BACKEND_ERROR, "Nanoseconds are finer than timestamps are kept.")
    return unit


def _timestamp(a: Typed) -> Column:
    return a.column if isinstance(a.type, T.TimestampType) else a.column.cast("timestamp_ntz")


def _micros(a: Typed) -> Column:
    """Microseconds since 1970 of the wall-clock time."""
    day = F.to_date(_timestamp(a))
    ts = _timestamp(a)
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60
    return F.unix_date(day).cast("long") * 86_400_000_000 + seconds.cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _floor_div(a: Column, n: int) -> Column:
    return (a - F.pmod(a, F.lit(n))) / F.lit(n)


def _years(ts: Column, n: int) -> Column:
    return F.floor(F.year(ts) / F.lit(n)).cast("long")


@function("date_trunc", 2)
def _date_trunc(args: Sequence[Typed]) -> Column:
    unit, ts = unit_of(args[0]), _timestamp(args[1])
    kind = "timestamp" if isinstance(args[1].type, T.TimestampType) else "timestamp_ntz"
    if unit in _YEARS:
        return F.make_date((_years(ts, _YEARS[unit]) * _YEARS[unit]).cast("int"), F.lit(1), F.lit(1)).cast(kind)
    return F.date_trunc(unit, ts).cast(kind)


@function("date_part", 2)
def _date_part(args: Sequence[Typed]) -> Column:
    """Whole numbers; milli- and microseconds count from the minute's start."""
    unit, ts = unit_of(args[0]), _timestamp(args[1])
    year = F.year(ts)
    if unit == "decade":
        return _years(ts, 10)
    if unit in _YEARS:
        return F.ceil(year / F.lit(_YEARS[unit])).cast("long")
    if unit in ("second", "millisecond", "microsecond"):
        return F.floor(F.extract(F.lit("SECOND"), ts) * (1_000_000 // _MICROS[unit])).cast("long")
    if unit in ("hour", "minute"):
        return (F.hour(ts) if unit == "hour" else F.minute(ts)).cast("long")
    return {"year": year, "month": F.month(ts), "day": F.day(ts), "quarter": F.quarter(ts), "week": F.weekofyear(ts)}[unit].cast("long")


@function("date_diff", 3)
def _date_diff(args: Sequence[Typed]) -> Column:
    """Boundaries of the unit between two times; weeks are whole sevens of days."""
    unit, (a, b) = unit_of(args[0]), args[1:]
    ta, tb = _timestamp(a), _timestamp(b)
    if unit in _YEARS or unit == "year":
        n = _YEARS.get(unit, 1)
        return _years(tb, n) - _years(ta, n)
    if unit in ("quarter", "month"):
        months = [F.year(t) * 12 + F.month(t) - 1 for t in (ta, tb)]
        n = 3 if unit == "quarter" else 1
        return F.floor(months[1] / n).cast("long") - F.floor(months[0] / n).cast("long")
    if unit in ("day", "week"):
        days = F.datediff(F.to_date(tb), F.to_date(ta))
        return (days if unit == "day" else F.when(days < 0, F.ceil(days / 7)).otherwise(F.floor(days / 7))).cast("long")
    n = _MICROS[unit]
    return (_floor_div(_micros(b), n) - _floor_div(_micros(a), n)).cast("long")


@function("date_add", 3)
def _date_add(args: Sequence[Typed]) -> Column:
    """(unit, number, time); months end at the month's last day."""
    unit, ts = unit_of(args[0], _ADDABLE), _timestamp(args[2])
    whole = not isinstance(args[1].type, (T.FloatType, T.DoubleType, T.DecimalType))
    if unit in ("year", "month") or (whole and unit == "day"):
        n = args[1].column.cast("int") if whole else F.rint(args[1].column).cast("int")
        return ts + F.make_interval(**{unit + "s": n})
    seconds = {"day": 86_400, "hour": 3_600, "minute": 60, "second": 1}[unit]
    return ts + F.make_interval(secs=(args[1].column.cast("decimal(18,6)") * seconds).cast("decimal(18,6)"))


def java_pattern(fmt: str) -> str:
    """The pattern for Spark's parser; numbers may lack leading zeros where something parts them."""
    tight = re.search(r"%Y%m", fmt) is not None
    letters = {"Y": "yyyy", "y": "yy", "b": "MMM", "B": "MMMM"} | ({"m": "MM", "d": "dd", "H": "HH", "M": "mm", "S": "ss"} if tight else {"m": "M", "d": "d", "H": "H", "M": "m", "S": "s"})
    out = fmt.replace(".%f", "\0")
    out = re.sub("[TZ]", lambda m: f"'{m[0]}'", out)
    out = re.sub("%([YybBmdHMS])", lambda m: letters[m[1]], out)
    return out.replace("\0", "[" + "][".join("." + "S" * n for n in range(6, 0, -1)) + "]")


@function("strptime", 2)
def _strptime(args: Sequence[Typed]) -> Column:
    """Times without a date are of 1900-01-01; two-digit years from 69 on are of the last century."""
    fmt = args[1].value
    if not args[1].is_literal or not isinstance(fmt, str) or fmt not in FORMATS:
        raise FrameError(INVALID_PREDICATE, f"strptime format '{fmt}' is not in the closed vocabulary.")
    ts = F.to_timestamp_ntz(args[0].column, F.lit(java_pattern(fmt)))
    if "%y" in fmt:
        ts = F.when(F.year(ts) >= 2069, ts + F.make_interval(years=F.lit(-100))).otherwise(ts)
    return ts if "%d" in fmt else ts + F.make_interval(years=F.lit(-70))
