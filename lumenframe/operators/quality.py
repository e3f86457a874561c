"""Profiles and expectations, each over all columns in as few passes as the results allow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..envelope import plain
from ..errors import INVALID_ARGUMENT, FrameError
from ..params import is_array, text, text_list, to_int, to_number
from ..plans.predicates import literal
from ..schema import field, quoted, resolve
from ..typenames import is_numeric, is_orderable_scalar, render

QUANTILES = (0.25, 0.5, 0.75)


def short_number(x: float) -> str:
    """0.25, 0.5, 1: the shortest form that reads back alike."""
    return str(int(x)) if x == int(x) else repr(x)


#: Up to so many rows exact quantiles are taken in memory; beyond, between bounds that an approximation gives.
ROWS_IN_MEMORY = 20_000_000
ACCURACY = 20_000
#: Values between two bounds that come to the driver.
GATHERED = 100_000


@dataclass
class _Rank:
    """A quantile's place: the values below ``low``, the equal ones, those between, and those equal to ``high``."""

    column: str
    rank: float
    low: float
    high: float
    below: int = 0
    at_low: int = 0
    between: int = 0
    at_high: int = 0

    def inside(self, x: Column) -> Column:
        return (x > self.low) & (x < self.high)

    @property
    def open(self) -> bool:
        """Whether one of the two values around the rank may be strictly between the bounds."""
        first, last = int(self.rank), int(self.rank) + (self.rank != int(self.rank))
        start = self.below + self.at_low
        return self.between > 0 and last >= start and first < start + self.between

    def value(self, k: int, values: Sequence[float]) -> float:
        k -= self.below
        if k < self.at_low:
            return self.low
        return values[k - self.at_low] if k - self.at_low < self.between and values else self.high


def bounded_quantiles(df: DataFrame, names: Sequence[str], quantiles: Sequence[float], accuracy: int = ACCURACY, gathered: int = GATHERED) -> dict[str, list[float | None]]:
    """Exact interpolated quantiles of columns with very many values, in a few passes over all of them.

    Approximations give values that surely lie at or below and at or above each wanted rank. Each
    pass counts what is below, equal and between, and narrows the bounds until few enough values
    are strictly between them; only these come to the driver. Values that repeat are only counted.
    """
    x = {n: quoted(n).cast("double") for n in names}
    slack = 2 / accuracy
    ends = df.agg(*[g.alias(f"{k}{i}") for i, n in enumerate(names) for k, g in (("n", F.count(x[n])), ("lo", F.min(x[n])), ("hi", F.max(x[n])))]).first()
    ranks = {(n, j): _Rank(n, q * (ends[f"n{i}"] - 1), ends[f"lo{i}"], ends[f"hi{i}"]) for i, n in enumerate(names) if ends[f"n{i}"] for j, q in enumerate(quantiles)}
    while ranks:
        cells = [g.alias(f"{k}{i}") for i, r in enumerate(ranks.values()) for k, g in (("a", F.count_if(x[r.column] < r.low)), ("b", F.count_if(x[r.column] == r.low)), ("c", F.count_if(r.inside(x[r.column]))), ("d", F.count_if((x[r.column] == r.high) & F.lit(r.high > r.low))))]
        found = df.agg(*cells).first()
        for i, r in enumerate(ranks.values()):
            r.below, r.at_low, r.between, r.at_high = (found[f"{k}{i}"] for k in "abcd")
        wide = [r for r in ranks.values() if r.open and r.between > gathered]
        if not wide:
            break
        wanted = []
        for i, r in enumerate(wide):
            share = (r.rank - r.below - r.at_low) / r.between
            around = [F.lit(min(1.0, max(0.0, share + s))) for s in (-slack, slack + 1 / r.between)]
            wanted.append(F.percentile_approx(F.when(r.inside(x[r.column]), x[r.column]), F.array(*around), accuracy).alias(f"p{i}"))
        narrowed, before = df.agg(*wanted).first(), [(r.low, r.high) for r in wide]
        for i, r in enumerate(wide):
            share = (r.rank - r.below - r.at_low) / r.between
            low, high = narrowed[f"p{i}"]
            # A bound stays where the rank may lie at it.
            r.low, r.high = (low if share - slack > 0 else r.low), (high if share + slack + 1 / r.between < 1 else r.high)
        if before == [(r.low, r.high) for r in wide]:
            break
    few = {k: r for k, r in ranks.items() if r.open}
    lists = df.agg(*[F.collect_list(F.when(r.inside(x[r.column]), x[r.column])).alias(f"v{i}") for i, r in enumerate(few.values())]).first() if few else None
    values = {k: sorted(lists[f"v{i}"]) for i, k in enumerate(few)}
    out: dict[str, list[float | None]] = {n: [None] * len(quantiles) for n in names}
    for (n, j), r in ranks.items():
        k, part = int(r.rank), r.rank - int(r.rank)
        a = r.value(k, values.get((n, j), []))
        out[n][j] = a + part * (r.value(k + 1, values.get((n, j), [])) - a) if part else a
    return out


def profile(df: DataFrame, p: Mapping[str, Any], rows_in_memory: int = ROWS_IN_MEMORY, rows: int | None = None) -> list[dict[str, Any]]:
    """A row of statistics for each column, from one aggregation over all of them."""
    names = [resolve(c, df.columns) for c in text_list("columns", p.get("columns"))] or df.columns
    quantiles = []
    for s in text_list("quantiles", p.get("quantiles")):
        q = to_number(s)
        if q is None or not 0 <= q <= 1:
            raise FrameError(INVALID_ARGUMENT, f"'{s}' is no quantile: it must be from 0 to 1.")
        quantiles.append(q)
    quantiles = quantiles or list(QUANTILES)
    numeric = [n for n in names if is_numeric(df.schema[n].dataType)]
    far = bool(numeric) and (df.count() if rows is None else rows) > rows_in_memory
    exprs = [F.count("*").alias("rows")]
    for k, n in enumerate(names):
        c, kind = quoted(n), df.schema[n].dataType
        hashable = not isinstance(kind, T.MapType)
        exprs += [F.count(c).alias(f"n{k}"), (F.approx_count_distinct(c) if hashable else F.lit(None).cast("long")).alias(f"d{k}")]
        if is_orderable_scalar(kind):
            exprs += [F.min(c).alias(f"lo{k}"), F.max(c).alias(f"hi{k}")]
        if is_numeric(kind):
            x = c.cast("double")
            exprs += [F.avg(x).alias(f"mean{k}"), F.stddev_samp(x).alias(f"std{k}")]
            if not far:
                exprs.append(F.percentile(x, F.array(*[F.lit(q) for q in quantiles])).alias(f"q{k}"))
    found = df.agg(*exprs).first().asDict()
    if far:
        found |= {f"q{names.index(n)}": v for n, v in bounded_quantiles(df, numeric, quantiles).items()}
    out = []
    for k, n in enumerate(names):
        row = {"column": n, "type": render(df.schema[n].dataType), "null_count": found["rows"] - found[f"n{k}"], "distinct_count": found[f"d{k}"], "count": found[f"n{k}"], "mean": found.get(f"mean{k}"), "std": found.get(f"std{k}"), "min": plain(found.get(f"lo{k}")), "max": plain(found.get(f"hi{k}"))}
        if is_numeric(df.schema[n].dataType):
            row |= {f"q_{short_number(q)}": v for q, v in zip(quantiles, found[f"q{k}"] or [None] * len(quantiles))}
        out.append(row)
    return out


def profile_type(name: str, row: Mapping[str, Any]) -> str:
    """Type name of a profile's column, as the first profiled column decides it."""
    if name in ("column", "type"):
        return "VARCHAR"
    if name in ("null_count", "distinct_count", "count"):
        return "BIGINT"
    own = row["type"]
    numeric = own.startswith("DECIMAL") or own in ("TINYINT", "SMALLINT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE")
    return own if name in ("min", "max") and not numeric else "DOUBLE"


REPORT_COLUMNS = (("expectation", "VARCHAR"), ("column", "VARCHAR"), ("passed", "BOOLEAN"), ("violations", "BIGINT"), ("details", "VARCHAR"))


@dataclass(frozen=True)
class Check:
    kind: str
    column: str | None
    #: Rows that violate; for unique a frame of one number. Details are fixed values.
    violated: Column | None = None
    repeated: DataFrame | None = None
    good: str = ""
    bad: str = ""
    bounds: tuple[tuple[str, int], ...] = ()


def _checks(df: DataFrame, expectations: Sequence[Any]) -> list[Check]:
    out = []
    for e in expectations:
        if not isinstance(e, Mapping):
            raise FrameError(INVALID_ARGUMENT, "An expectation is an object with a 'type'.")
        kind = str(e.get("type") or "").lower()
        if kind == "row_count":
            out.append(_row_count(e))
            continue
        if kind not in ("not_null", "unique", "in_range", "in_set", "matches"):
            raise FrameError(INVALID_ARGUMENT, f"There is no expectation '{kind}'; known ones: not_null, unique, in_range, in_set, matches, row_count.")
        if text(e.get("column")) is None:
            raise FrameError(INVALID_ARGUMENT, f"The expectation '{kind}' needs a column to look at.")
        name, c, dtype = field(df, e["column"])
        if kind == "not_null":
            out.append(Check(kind, name, c.isNull(), good="no NULLs", bad="{} NULL value(s)"))
        elif kind == "unique":
            repeated = df.groupBy(c.alias("x")).agg(F.count("*").alias("n")).filter("n > 1").agg(F.count("*").alias("n"))
            out.append(Check(kind, name, repeated=repeated, good="all values unique", bad="{} value(s) occur more than once"))
        elif kind == "in_range":
            low, high = e.get("min"), e.get("max")
            if low is None and high is None:
                raise FrameError(INVALID_ARGUMENT, "A range needs a lower or an upper bound.")
            outside = F.lit(False)
            if low is not None:
                outside = outside | (c < literal(low, dtype))
            if high is not None:
                outside = outside | (c > literal(high, dtype))
            bounds = f"[{'-inf' if low is None else low}, {'+inf' if high is None else high}]"
            out.append(Check(kind, name, outside, good=f"all within {bounds}", bad=f"{{}} value(s) outside {bounds}"))
        elif kind == "in_set":
            values = list(e["values"]) if is_array(e.get("values")) else []
            if not values:
                raise FrameError(INVALID_ARGUMENT, "A set needs at least one value.")
            out.append(Check(kind, name, ~c.isin([literal(v, dtype) for v in values]), good="all values in set", bad="{} value(s) outside the set"))
        else:
            if text(e.get("pattern")) is None:
                raise FrameError(INVALID_ARGUMENT, "'matches' needs a pattern.")
            out.append(Check(kind, name, ~F.rlike(c, F.lit(e["pattern"])), good="all values match", bad="{} value(s) do not match"))
    return out


def _row_count(e: Mapping[str, Any]) -> Check:
    bounds = []
    for k in ("equals", "min", "max"):
        if e.get(k) is not None:
            n = to_int(e[k])
            if n is None:
                raise FrameError(INVALID_ARGUMENT, f"Row counts are whole numbers; '{k}' is not.")
            bounds.append((k, n))
    if not bounds:
        raise FrameError(INVALID_ARGUMENT, "'row_count' needs a number to compare with: equals, min or max.")
    return Check("row_count", None, bounds=tuple(bounds))


def check(df: DataFrame, p: Mapping[str, Any]) -> list[dict[str, Any]]:
    """A report row for each expectation. All row-level checks are counted in one pass, and each ``unique`` in one more."""
    checks = _checks(df, list(p["expectations"]))
    if not checks:
        raise FrameError(INVALID_ARGUMENT, "There are no expectations to check.")
    counts = [F.count_if(c.violated).alias(f"c{k}") for k, c in enumerate(checks) if c.violated is not None]
    found = df.agg(F.count("*").alias("rows"), *counts).first() if counts or any(c.bounds for c in checks) else None
    out = []
    for k, c in enumerate(checks):
        if c.bounds:
            n = found["rows"]
            passed = all({"equals": n == b, "min": n >= b, "max": n <= b}[kind] for kind, b in c.bounds)
            violations, details = int(not passed), f"row_count={n}, expected {', '.join(f'{kind} {b}' for kind, b in c.bounds)}"
        else:
            violations = c.repeated.first()[0] if c.repeated is not None else found[f"c{k}"]
            passed, details = violations == 0, c.bad.format(violations) if violations else c.good
        out.append({"expectation": c.kind, "column": c.column, "passed": passed, "violations": violations, "details": details})
    return out
