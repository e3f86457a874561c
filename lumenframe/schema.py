"""Column names: case-insensitive lookup with suggestions, quoting, and names made unique."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .errors import COLUMN_NOT_FOUND, FrameError


def distance(a: str, b: str) -> int:
    """Edits (insert, delete, replace) between two strings."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def resolve(name: str, columns: Sequence[str]) -> str:
    """The column's own spelling, or COLUMN_NOT_FOUND with the nearest name."""
    wanted = str(name).lower()
    for c in columns:
        if c.lower() == wanted:
            return c
    hint = {"did_you_mean": min(columns, key=lambda c: distance(c.lower(), wanted))} if columns else {}
    raise FrameError(COLUMN_NOT_FOUND, f"Column '{name}' does not exist in the dataset.", column=name, **hint)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def field(df: DataFrame, name: str) -> tuple[str, Column, T.DataType]:
    own = resolve(name, df.columns)
    return own, quoted(own), df.schema[own].dataType


def unique_names(names: Iterable[str]) -> list[str]:
    """Later repeats (in any case) get _1, _2, ..."""
    taken: set[str] = set()
    out = []
    for name in names:
        own, k = name, 0
        while own.lower() in taken:
            k += 1
            own = f"{name}_{k}"
        taken.add(own.lower())
        out.append(own)
    return out


def project(df: DataFrame, columns: Sequence[tuple[str, Column]]) -> DataFrame:
    """The columns under their names, repeats made unique."""
    return df.select(*[c.alias(n) for n, (_, c) in zip(unique_names(n for n, _ in columns), columns)])


def everything(df: DataFrame) -> list[tuple[str, Column]]:
    return [(c, quoted(c)) for c in df.columns]


def hidden(df: DataFrame, name: str) -> str:
    """A name that no column has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
