"""Paths: policy, existence, sizes, globs."""

from __future__ import annotations

import glob
import itertools
import os
import re
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import SparkSession

from ..errors import BACKEND_ERROR, FILE_NOT_FOUND, PERMISSION_DENIED, FrameError
from .stores import is_remote, local, store_of

_WILD = re.compile(r"[*?\[]")


class PathPolicy(Protocol):
    """Decides on canonical paths: no '..', links resolved."""

    def can_read(self, path: str) -> bool: ...

    def can_write(self, path: str) -> bool: ...


def is_glob(path: str) -> bool:
    return _WILD.search(path) is not None


def canonical(path: str) -> str:
    """The real path; of a glob, the part before the first wildcard is resolved."""
    if is_remote(path):
        return path
    path = local(path)
    found = _WILD.search(path)
    if not found:
        return os.path.realpath(path)
    cut = path.rfind(os.sep, 0, found.start())
    return path if cut < 0 else os.path.join(os.path.realpath(path[:cut] or os.sep), path[cut + 1 :])


def allow(policy: PathPolicy | None, path: str, write: bool = False) -> None:
    if policy is None:
        return
    own = canonical(path)
    if not (policy.can_write if write else policy.can_read)(own):
        raise FrameError(PERMISSION_DENIED, f"{'Write' if write else 'Read'} access to path '{own}' is denied by the configured path policy.", path=own)


def must_exist(spark: SparkSession, path: str | None, policy: PathPolicy | None, directory: bool = False) -> str:
    """The path for Spark. Globs aren't checked: one that matches nothing fails in the reader."""
    if path is None or not path.strip():
        raise FrameError(FILE_NOT_FOUND, "The path is empty.", path=path)
    allow(policy, path)
    if is_glob(path):
        return path
    store = store_of(spark, path)
    if not (store.is_dir if directory else store.exists)(path):
        raise FrameError(FILE_NOT_FOUND, f"Path '{path}' does not exist.", path=path)
    return path


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of the files that a local glob names; 0 for folders and remote globs."""
    if is_glob(path):
        return 0 if is_remote(path) else sum(os.path.getsize(n) for n in glob.glob(local(path)) if os.path.isfile(n))
    store = store_of(spark, path)
    return 0 if store.is_dir(path) else store.size(path)


def tree_size(spark: SparkSession, path: str, suffix: str) -> int:
    store = store_of(spark, path)
    root = store.absolute(path)
    return sum(store.size(f"{root}/{f}") for f in store.files(root) if f.endswith(suffix))


def _first_file(path: str) -> str:
    names = sorted(glob.glob(local(path))) if is_glob(path) else [local(path)]
    if names and os.path.isdir(names[0]):
        names = sorted(os.path.join(d, f) for d, _, fs in os.walk(names[0]) for f in fs if not f.startswith(("_", ".")))
    if not names:
        raise FrameError(BACKEND_ERROR, f"No file matches '{path}'.", path=path)
    return names[0]


def _by_spark(path: str) -> bool:
    """Whether the driver can't read the file's bytes as text: other stores, and compressed files."""
    return is_remote(path) or re.search(r"\.(gz|bz2|zst|lz4|snappy|deflate|xz)$", path if is_glob(path) else _first_file(path)) is not None


def lines(spark: SparkSession, path: str, most: int) -> Iterator[str]:
    """The first lines of the first file, with their ends."""
    if _by_spark(path):
        for row in spark.read.text(path).limit(most).collect():
            yield row[0].removeprefix("\ufeff") + "\n"
        return
    with open(_first_file(path), encoding="utf-8-sig", errors="replace", newline="") as f:
        yield from itertools.islice(f, most)


def head(spark: SparkSession, path: str, size: int) -> str:
    """The first characters of the first file."""
    if not _by_spark(path):
        with open(_first_file(path), "rb") as f:
            return f.read(size).decode("utf-8", "ignore").removeprefix("\ufeff")
    return "".join(lines(spark, path, 1_000))[:size]
