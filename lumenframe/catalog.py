"""Named datasets of a session."""

from __future__ import annotations

import re
import threading
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .errors import DATASET_NOT_FOUND, INVALID_ARGUMENT, FrameError

ID_PATTERN = r"^[A-Za-z_][A-Za-z0-9_]{0,127}$"


@dataclass(frozen=True)
class Dataset:
    """A lazy frame, where it came from, and its rows if they were counted."""

    id: str
    frame: DataFrame
    source: str
    row_count: int | None = None


class Catalog:
    """Ids are compared exactly. Replacing an id never changes frames derived from the old one."""

    def __init__(self) -> None:
        self._entries: dict[str, Dataset] = {}
        self._lock = threading.RLock()

    def put(self, entry: Dataset) -> None:
        if not re.fullmatch(ID_PATTERN, entry.id):
            raise FrameError(INVALID_ARGUMENT, f"'{entry.id}' is not a valid dataset id.", dataset_id=entry.id)
        with self._lock:
            self._entries[entry.id] = entry

    def get(self, dataset_id: str) -> Dataset:
        with self._lock:
            entry = self._entries.get(dataset_id)
        if entry is None:
            raise FrameError(DATASET_NOT_FOUND, f"Dataset '{dataset_id}' does not exist.", dataset_id=dataset_id)
        return entry

    def drop(self, dataset_id: str) -> Dataset:
        with self._lock:
            entry = self.get(dataset_id)
            del self._entries[dataset_id]
        return entry

    def __contains__(self, dataset_id: str) -> bool:
        return dataset_id in self._entries

    def __iter__(self) -> Iterator[Dataset]:
        with self._lock:
            return iter([self._entries[k] for k in sorted(self._entries)])
