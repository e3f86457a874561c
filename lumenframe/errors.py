"""Stable error codes and the exception that carries one."""

from __future__ import annotations

from typing import Any

DATASET_NOT_FOUND = "DATASET_NOT_FOUND"
COLUMN_NOT_FOUND = "COLUMN_NOT_FOUND"
INVALID_TYPE = "INVALID_TYPE"
INVALID_ARGUMENT = "INVALID_ARGUMENT"
INVALID_AGGREGATION = "INVALID_AGGREGATION"
INVALID_PREDICATE = "INVALID_PREDICATE"
SCHEMA_MISMATCH = "SCHEMA_MISMATCH"
FILE_NOT_FOUND = "FILE_NOT_FOUND"
PERMISSION_DENIED = "PERMISSION_DENIED"
TARGET_EXISTS = "TARGET_EXISTS"
CANCELLED = "CANCELLED"
BACKEND_ERROR = "BACKEND_ERROR"


class FrameError(Exception):
    """A refusal with a stable code, a message and optional details."""

    def __init__(self, code: str, message: str, **details: Any):
        super().__init__(message)
        self.code, self.message, self.details = code, message, details or None
