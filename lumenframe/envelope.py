"""The one response shape of all operations."""

from __future__ import annotations

import datetime as dt
import decimal
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Row
from pyspark.sql import types as T

from .typenames import render


@dataclass(frozen=True)
class ColumnSchema:
    name: str
    type: str
    nullable: bool = True

    def to_envelope(self) -> dict[str, Any]:
        return {"name": self.name, "type": self.type, "nullable": self.nullable}


def describe(schema: T.StructType) -> list[ColumnSchema]:
    return [ColumnSchema(f.name, render(f.dataType)) for f in schema.fields]


@dataclass(frozen=True)
class Stats:
    elapsed_ms: int = 0
    bytes_scanned: int = 0
    rows_produced: int = 0
    plan: str | None = None

    def to_envelope(self) -> dict[str, Any]:
        out = {"elapsed_ms": self.elapsed_ms, "bytes_scanned": self.bytes_scanned, "rows_produced": self.rows_produced}
        return out | ({"plan": self.plan} if self.plan is not None else {})


@dataclass(frozen=True)
class Response:
    success: bool
    dataset_id: str | None = None
    schema: Sequence[ColumnSchema] = ()
    row_count: int | None = None
    preview_rows: Sequence[Mapping[str, Any]] = ()
    preview_truncated: bool = False
    warnings: Sequence[str] = ()
    stats: Stats | None = None
    error_code: str | None = None
    message: str | None = None
    details: Mapping[str, Any] | None = None

    @staticmethod
    def ok(dataset_id: str, schema: Sequence[ColumnSchema], row_count: int, preview_rows: Sequence[Mapping[str, Any]], stats: Stats | None = None, warnings: Sequence[str] = ()) -> Response:
        return Response(True, dataset_id, schema, row_count, preview_rows, row_count > len(preview_rows), warnings, stats)

    @staticmethod
    def error(code: str, message: str, details: Mapping[str, Any] | None = None) -> Response:
        return Response(False, error_code=code, message=message, details=details)

    def to_envelope(self) -> dict[str, Any]:
        if not self.success:
            out = {"success": False, "error_code": self.error_code, "message": self.message}
            return out | ({"details": dict(self.details)} if self.details is not None else {})
        return {
            "success": True,
            "dataset_id": self.dataset_id,
            "schema": [c.to_envelope() for c in self.schema],
            "row_count": self.row_count,
            "preview_rows": [dict(r) for r in self.preview_rows],
            "preview_truncated": self.preview_truncated,
            "warnings": list(self.warnings),
            "stats": self.stats.to_envelope() if self.stats else None,
        }


def plain(x: Any) -> Any:
    """A preview value: numbers, strings, lists and dictionaries; times in ISO form."""
    if isinstance(x, Row):
        return {k: plain(v) for k, v in x.asDict().items()}
    if isinstance(x, Mapping):
        return {k: plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [plain(v) for v in x]
    if isinstance(x, (dt.datetime, dt.date, dt.time)):
        return x.isoformat()
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral_value() and x.as_tuple().exponent >= 0 else x
    return bytes(x) if isinstance(x, (bytearray, memoryview)) else x


def plain_rows(rows: Sequence[Row], names: Sequence[str]) -> list[dict[str, Any]]:
    return [dict(zip(names, map(plain, r))) for r in rows]
