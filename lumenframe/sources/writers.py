"""Export to CSV, Parquet, JSON and Delta. Whatever is there is replaced only once the new data are complete."""

from __future__ import annotations

import re
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import BACKEND_ERROR, INVALID_ARGUMENT, INVALID_TYPE, TARGET_EXISTS, FrameError
from ..params import text, text_list, to_bool
from ..schema import quoted, resolve
from . import delta
from .paths import PathPolicy, allow
from .stores import Store, parent, replace, store_of

FORMATS = ("csv", "parquet", "json", "delta")
_CSV_ONLY = ("header", "delimiter", "quote", "escape")


def _check(df: DataFrame, p: Mapping[str, Any]) -> None:
    fmt, mode, compression = p["format"], p.get("mode") or "error", p.get("compression")
    if to_bool(p.get("array")) and fmt != "json":
        raise FrameError(INVALID_ARGUMENT, "'array' is for json only.")
    if mode == "append" and fmt != "delta":
        raise FrameError(INVALID_ARGUMENT, "Mode 'append' is for delta only.")
    if compression is not None:
        if not re.fullmatch(r"[A-Za-z0-9_]{1,32}", str(compression)):
            raise FrameError(INVALID_TYPE, f"Compression '{compression}' is not valid.", parameter="compression")
        if fmt in ("csv", "delta"):
            raise FrameError(INVALID_ARGUMENT, f"'compression' is not supported for {fmt}.")
    if to_bool(p.get("many_files")) and fmt != "parquet":
        raise FrameError(INVALID_ARGUMENT, "'many_files' is for parquet only.")
    if text_list("partition_by", p.get("partition_by")) and fmt in ("csv", "json"):
        raise FrameError(INVALID_ARGUMENT, f"'partition_by' is not supported for {fmt}.")
    for name in _CSV_ONLY:
        if p.get(name) is not None:
            if fmt != "csv":
                raise FrameError(INVALID_ARGUMENT, f"'{name}' is for csv only.")
            if name != "header" and len(str(p[name])) != 1:
                raise FrameError(INVALID_ARGUMENT, f"'{name}' must be one character.")


def export(df: DataFrame, p: Mapping[str, Any], policy: PathPolicy | None = None) -> None:
    _check(df, p)
    path, fmt, mode = text(p["path"]), p["format"], p.get("mode") or "error"
    if path is None:
        raise FrameError(INVALID_ARGUMENT, "'path' must not be empty.")
    allow(policy, path, write=True)
    store = store_of(df.sparkSession, path)
    target = store.absolute(path)
    partition_by = [resolve(c, df.columns) for c in text_list("partition_by", p.get("partition_by"))]
    if mode == "error" and store.exists(target):
        raise FrameError(TARGET_EXISTS, f"'{path}' exists already.", path=path)
    store.mkdirs(parent(target))
    if fmt == "delta":
        (delta.append if mode == "append" else delta.write_new)(df, target, partition_by)
        return
    tag = uuid.uuid4().hex
    staging = f"{target}.tmp-{tag}"
    try:
        if fmt == "parquet" and (partition_by or to_bool(p.get("many_files"))):
            writer = df.write.option("compression", p.get("compression") or "snappy")
            (writer.partitionBy(*partition_by) if partition_by else writer).parquet(store.url(staging))
            replace(store, staging, target, tag)
        elif fmt == "json" and to_bool(p.get("array")):
            _write_array(df, store, staging)
            replace(store, staging, target, tag)
        else:
            _one_file(df, store.url(staging), fmt, p)
            replace(store, _only_part(store, staging), target, tag)
    finally:
        store.delete(staging)


def _one_file(df: DataFrame, folder: str, fmt: str, p: Mapping[str, Any]) -> None:
    """A single file is what was asked for; partition_by, many_files or delta are for data that one writer can't hold."""
    writer = df.coalesce(1).write
    if fmt == "parquet":
        writer.option("compression", p.get("compression") or "snappy").parquet(folder)
    elif fmt == "json":
        compression = p.get("compression")
        (writer.option("compression", compression) if compression else writer).option("ignoreNullFields", False).json(folder)
    else:
        header = to_bool(p.get("header"))
        quote = str(p.get("quote") or '"')
        writer.options(header=header is not False, sep=str(p.get("delimiter") or ","), quote=quote, escape=str(p.get("escape") or quote), emptyValue=quote + quote, nullValue="", timestampNTZFormat="yyyy-MM-dd HH:mm:ss[.SSSSSS]").csv(folder)


def _only_part(store: Store, folder: str) -> str:
    parts = [n for n in store.names(folder) if n.startswith("part-")]
    if len(parts) != 1:
        raise FrameError(BACKEND_ERROR, f"One output file was expected; there are {len(parts)}.")
    return f"{folder}/{parts[0]}"


def _write_array(df: DataFrame, store: Store, file: str) -> None:
    """Objects of one array, passed through the driver a partition at a time."""
    rows = df.select(F.to_json(F.struct(*[quoted(c) for c in df.columns]), {"ignoreNullFields": "false"}))

    def parts():
        yield "[\n"
        for k, r in enumerate(rows.toLocalIterator()):
            yield (",\n" if k else "") + "\t" + r[0]
        yield "\n]\n"

    store.create(file, parts())
