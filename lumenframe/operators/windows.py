"""Window functions; all functions of a request share one window."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import INVALID_ARGUMENT, INVALID_TYPE, FrameError
from ..params import is_array, text, text_list, to_int
from ..schema import everything, field, project
from .relational import is_desc, order_key

RANKING = {"row_number": F.row_number, "rank": F.rank, "dense_rank": F.dense_rank, "percent_rank": F.percent_rank}
VALUES = {"first_value": F.first_value, "last_value": F.last_value, "sum": F.sum, "avg": lambda c: F.avg(c.cast("double")), "min": F.min, "max": F.max, "count": F.count}
FUNCTIONS = (*RANKING, "ntile", "lag", "lead", *VALUES)


def _fail(message: str) -> FrameError:
    return FrameError(INVALID_ARGUMENT, message)


def _order(df: DataFrame, entries: Any) -> list[Column]:
    out = []
    for e in entries or ():
        if not isinstance(e, Mapping) or text(e.get("column")) is None:
            raise _fail("An entry of 'order_by' is an object with column, direction and nulls.")
        nulls = e.get("nulls")
        if nulls is not None and str(nulls).lower() not in ("first", "last"):
            raise _fail("Nulls come 'first' or 'last'.")
        out.append(order_key(field(df, e["column"])[1], is_desc(e.get("direction")), str(nulls).lower() == "first"))
    return out


def _bound(x: Any, side: str) -> int:
    words = {"unbounded_preceding": Window.unboundedPreceding, "current_row": Window.currentRow, "unbounded_following": Window.unboundedFollowing}
    if isinstance(x, str):
        if x not in words:
            raise _fail(f"Unknown frame {side} '{x}'.")
        return words[x]
    if isinstance(x, Mapping) and len(x) == 1 and next(iter(x)) in ("preceding", "following"):
        kind, n = next(iter(x.items()))
        rows = to_int(n) if not isinstance(n, bool) else None
        if rows is None:
            raise FrameError(INVALID_TYPE, f"The frame {side} must count whole rows; got '{n}'.")
        if rows < 0:
            raise _fail(f"The frame {side} can't be negative.")
        return -rows if kind == "preceding" else rows
    raise _fail(f"The frame {side} must be unbounded_preceding, current_row, unbounded_following, {{preceding: n}} or {{following: n}}.")


def _argument(f: Mapping[str, Any], name: str, default: int | None) -> int:
    args = list(f["args"]) if is_array(f.get("args")) else []
    if not args:
        if default is None:
            raise _fail(f"'{name}' requires 'args' with one number.")
        return default
    n = to_int(args[0]) if not isinstance(args[0], bool) else None
    if n is None:
        raise FrameError(INVALID_TYPE, f"'{name}' takes a whole number; got '{args[0]}'.")
    return n


def window(df: DataFrame, p: Mapping[str, Any]) -> DataFrame:
    """All columns, then each function's value. Frames count rows, and hold for value and aggregate functions only."""
    keys = [field(df, c)[1] for c in text_list("partition_by", p.get("partition_by"))]
    order = _order(df, p.get("order_by"))
    plain = Window.partitionBy(*keys)
    ordered = plain.orderBy(*(order or [F.lit(1)]))
    framed = plain.orderBy(*order) if order else plain
    if p.get("frame") is not None:
        frame = p["frame"]
        if not isinstance(frame, Mapping) or "start" not in frame or "end" not in frame:
            raise _fail("'frame' needs 'start' and 'end'.")
        framed = (plain.orderBy(*order) if order else ordered).rowsBetween(_bound(frame["start"], "start"), _bound(frame["end"], "end"))
    added = []
    for f in p["functions"]:
        if not isinstance(f, Mapping):
            raise _fail("A window function is an object.")
        name, alias = str(f.get("function") or "").lower(), text(f.get("alias"))
        if name not in FUNCTIONS:
            raise _fail(f"There is no window function '{f.get('function')}'.")
        if alias is None:
            raise _fail("A window function needs an alias.")
        added.append((alias, _value(df, f, name, ordered, framed, bool(order))))
    if not added:
        raise _fail("There are no window functions in the request.")
    return project(df, [*everything(df), *added])


def _value(df: DataFrame, f: Mapping[str, Any], name: str, ordered, framed, has_order: bool) -> Column:
    if name in RANKING:
        if not has_order and name != "row_number":  # all rows are peers
            return F.lit(0.0) if name == "percent_rank" else F.lit(1).cast("long")
        ranked = RANKING[name]().over(ordered)
        return ranked if name == "percent_rank" else ranked.cast("long")
    if name == "ntile":
        n = _argument(f, name, None)
        if n < 1:
            raise _fail("'ntile' makes one part at least.")
        return F.ntile(n).over(ordered).cast("long")
    if text(f.get("column")) is None:
        raise _fail(f"'{name}' requires a 'column'.")
    c = field(df, f["column"])[1]
    if name in ("lag", "lead"):
        return (F.lag if name == "lag" else F.lead)(c, _argument(f, name, 1)).over(ordered)
    return VALUES[name](c).over(framed)
