"""File systems behind paths: the driver's own, and any that Hadoop knows.

A path without a scheme belongs to the session's default file system, so that driver and
executors mean the same place by it.
"""

from __future__ import annotations

import os
import re
import shutil
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession


def is_remote(path: str) -> bool:
    """Whether the path names a store other than the driver's own."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", path) is not None and not path.startswith("file:/")


def local(path: str) -> str:
    return re.sub(r"^file:/+", "/", path)


class LocalStore:
    """The driver's file system; on a cluster its paths must be shared folders."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def absolute(self, path: str) -> str:
        return os.path.abspath(local(path))

    def canonical(self, path: str) -> str:
        return os.path.realpath(local(path))

    def url(self, path: str) -> str:
        """For Spark, whatever its default file system is."""
        return "file://" + path

    def exists(self, path: str) -> bool:
        return os.path.lexists(local(path))

    def is_dir(self, path: str) -> bool:
        return os.path.isdir(local(path))

    def mkdirs(self, path: str) -> None:
        os.makedirs(path, exist_ok=True)

    def names(self, path: str) -> list[str]:
        return sorted(os.listdir(path))

    def files(self, path: str) -> list[str]:
        """All files below, by relative names with slashes."""
        return sorted(os.path.relpath(os.path.join(d, f), path).replace(os.sep, "/") for d, _, found in os.walk(path) for f in found)

    def size(self, path: str) -> int:
        return os.path.getsize(local(path))

    def changed(self, path: str) -> float:
        """Milliseconds since 1970."""
        return os.path.getmtime(path) * 1000

    def read(self, path: str) -> str:
        with open(path, encoding="utf-8") as f:
            return f.read()

    def create(self, path: str, content: Iterable[str]) -> bool:
        """A new file of these texts, on disk when this returns; False if there is one."""
        try:
            handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.writelines(content)
            f.flush()
            os.fsync(f.fileno())
        return True

    def rename(self, old: str, new: str) -> None:
        """Replaces a file by a file; otherwise the new name must be free."""
        if os.path.isfile(old) and not os.path.isdir(new):
            os.replace(old, new)
        else:
            os.rename(old, new)

    def delete(self, path: str) -> None:
        if os.path.isdir(path) and not os.path.islink(path):
            shutil.rmtree(path, ignore_errors=True)
        elif os.path.lexists(path):
            os.remove(path)


class HadoopStore:
    """A file system that Hadoop knows. Create and rename are as atomic as that store has them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def absolute(self, path: str) -> str:
        return self._fs(path).makeQualified(self._path(path)).toString()

    canonical = absolute

    def url(self, path: str) -> str:
        return path

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def is_dir(self, path: str) -> bool:
        return self.exists(path) and self._fs(path).getFileStatus(self._path(path)).isDirectory()

    def mkdirs(self, path: str) -> None:
        self._fs(path).mkdirs(self._path(path))

    def names(self, path: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path)))

    def files(self, path: str) -> list[str]:
        root, found = self._fs(path).makeQualified(self._path(path)).toString(), []
        each = self._fs(path).listFiles(self._path(path), True)
        while each.hasNext():
            found.append(each.next().getPath().toString()[len(root) :].lstrip("/"))
        return sorted(found)

    def size(self, path: str) -> int:
        return self._fs(path).getFileStatus(self._path(path)).getLen()

    def changed(self, path: str) -> float:
        return float(self._fs(path).getFileStatus(self._path(path)).getModificationTime())

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, content: Iterable[str]) -> bool:
        try:
            stream = self._fs(path).create(self._path(path), False)
        except Exception:
            if self.exists(path):
                return False
            raise
        try:
            for part in _larger(content):
                stream.write(bytearray(part.encode()))
        finally:
            stream.close()
        return True

    def rename(self, old: str, new: str) -> None:
        if self.exists(new) and not self.is_dir(new) and not self.is_dir(old):
            self.delete(new)
        if self.exists(new) or not self._fs(old).rename(self._path(old), self._path(new)):
            raise OSError(f"'{old}' could not be renamed to '{new}'.")

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)


Store = LocalStore | HadoopStore


def _larger(parts: Iterable[str], size: int = 1 << 20) -> Iterator[str]:
    held: list[str] = []
    length = 0
    for p in parts:
        held.append(p)
        length += len(p)
        if length >= size:
            yield "".join(held)
            held, length = [], 0
    if held:
        yield "".join(held)


def store_of(spark: SparkSession, path: str) -> Store:
    if is_remote(path):
        return HadoopStore(spark)
    if not path.startswith("file:/") and is_remote(str(spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///"))):
        return HadoopStore(spark)
    return LocalStore(spark)


def parent(path: str) -> str:
    return path.rstrip("/").rsplit("/", 1)[0] or "/"


def replace(store: Store, new: str, target: str, tag: str) -> None:
    """Puts a complete file or folder in the place of what is there, which comes back if that fails."""
    if store.exists(target) and not store.is_dir(target) and not store.is_dir(new):
        store.rename(new, target)
        return
    old = f"{target}.old-{tag}"
    moved = store.exists(target)
    if moved:
        store.rename(target, old)
    try:
        store.rename(new, target)
    except Exception:
        if moved:
            store.rename(old, target)
        raise
    if moved:
        store.delete(old)
