"""The engine: operations by id, from a request to a response.

Each dataset is a lazy Spark frame, so a chain of operations is one plan for Catalyst. An
operation's response needs a preview and the row count: one job, or two where the count isn't known.
"""

from __future__ import annotations

import contextlib
import logging
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .catalog import ID_PATTERN, Catalog, Dataset
from .envelope import ColumnSchema, Response, Stats, describe, plain_rows
from .errors import BACKEND_ERROR, CANCELLED, INVALID_ARGUMENT, INVALID_TYPE, FrameError
from .operators import grouping, joins, missing, quality, relational, reshape, windows
from .params import Param, check, is_array, text, to_bool, to_int
from .sources import delta, readers, writers
from .sources.paths import PathPolicy, must_exist, size_of, tree_size

log = logging.getLogger("lumenframe")
PREVIEW_ROWS, MOST_PREVIEW_ROWS = 50, 1000


@dataclass
class Options:
    """Limits of one call. Memory is Spark's to manage, so its limit only gives a warning."""

    max_execution_time_ms: int | None = None
    max_memory_bytes: int | None = None
    cancel: threading.Event | None = None


@dataclass(frozen=True)
class Operation:
    id: str
    name: str
    description: str
    parameters: tuple[Param, ...]
    run: Callable[[Call], Response]


@dataclass
class Call:
    engine: Engine
    params: Mapping[str, Any]
    options: Options
    warnings: list[str] = field(default_factory=list)
    began: float = field(default_factory=time.monotonic)

    def dataset(self, name: str = "dataset_id") -> Dataset:
        return self.engine.catalog.get(str(self.params[name]))

    @property
    def target(self) -> str:
        into = self.params.get("into")
        return str(into if into is not None else self.params["dataset_id"])

    def stats(self, rows: int, scanned: int = 0, plan: str | None = None) -> Stats:
        return Stats(int((time.monotonic() - self.began) * 1000), scanned, rows, plan)

    def finish(self, frame: DataFrame, dataset_id: str, source: str, scanned: int = 0, explain: bool = False, rows: int | None = None) -> Response:
        """Previews and counts the frame, and keeps it under the id. A result that fits the preview, or whose rows are known, needs one job."""
        plan = plan_of(frame) if explain else None
        shown = frame.limit(PREVIEW_ROWS + 1).collect()
        if rows is None or len(shown) <= PREVIEW_ROWS:
            rows = len(shown) if len(shown) <= PREVIEW_ROWS else frame.count()
        self.engine.catalog.put(Dataset(dataset_id, frame, source, rows))
        return Response.ok(dataset_id, describe(frame.schema), rows, plain_rows(shown[:PREVIEW_ROWS], frame.columns), self.stats(rows, scanned, plan), self.warnings)


def plan_of(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().toString()


class Engine:
    """A session's datasets and operations.

    checkpoint_every: after so many lazy steps a dataset's plan is cut by checkpoint() in the
    folder of spark.checkpoint.dir; by default never, as Catalyst folds the steps.
    """

    def __init__(self, spark: SparkSession, path_policy: PathPolicy | None = None, catalog: Catalog | None = None, checkpoint_every: int | None = None):
        self.spark, self.path_policy, self.checkpoint_every = spark, path_policy, checkpoint_every
        self.catalog = catalog if catalog is not None else Catalog()
        self._steps: dict[str, int] = {}

    @property
    def operations(self) -> Sequence[Operation]:
        return tuple(OPERATIONS.values())

    def execute(self, op_id: str, params: Mapping[str, Any] | None = None, options: Options | None = None) -> Response:
        """Runs an operation. An unknown id raises; all else that goes wrong is an error response."""
        if op_id not in OPERATIONS:
            raise FrameError(INVALID_ARGUMENT, f"Unknown operation '{op_id}'.", operation=op_id)
        call = Call(self, dict(params or {}), options or Options())
        try:
            check(call.params, OPERATIONS[op_id].parameters)
            if call.options.max_memory_bytes:
                call.warnings.append("max_memory_bytes is advisory: Spark manages memory and spills by itself.")
            with self._watched(op_id, call.options) as stopped:
                try:
                    return OPERATIONS[op_id].run(call)
                except Exception:
                    if stopped():
                        raise FrameError(CANCELLED, f"'{op_id}' was cancelled.") from None
                    raise
        except FrameError as e:
            return Response.error(e.code, e.message, e.details)
        except Exception as e:
            log.debug("%s failed", op_id, exc_info=True)
            return Response.error(BACKEND_ERROR, str(e))

    @contextlib.contextmanager
    def _watched(self, op_id: str, options: Options) -> Iterator[Callable[[], bool]]:
        """Tags the call's jobs, and cancels them on timeout or when asked to."""
        context, tag = self.spark.sparkContext, f"lumenframe-{uuid.uuid4().hex}"
        stop, ended = threading.Event(), threading.Event()
        asked = options.cancel
        if asked is not None and asked.is_set():
            raise FrameError(CANCELLED, f"'{op_id}' was cancelled.")

        def watch() -> None:
            deadline = time.monotonic() + options.max_execution_time_ms / 1000 if options.max_execution_time_ms else None
            while not ended.wait(0.02):
                if (deadline and time.monotonic() > deadline) or (asked is not None and asked.is_set()):
                    stop.set()
                    context.cancelJobsWithTag(tag)

        context.addJobTag(tag)
        context.setJobDescription(op_id)
        watcher = threading.Thread(target=watch, daemon=True) if options.max_execution_time_ms or asked is not None else None
        if watcher:
            watcher.start()
        try:
            yield stop.is_set
            if stop.is_set():
                raise FrameError(CANCELLED, f"'{op_id}' was cancelled.")
        finally:
            ended.set()
            if watcher:
                watcher.join()
            context.removeJobTag(tag)
            context.setJobDescription(None)

    def cut(self, source_ids: Sequence[str], target: str, frame: DataFrame) -> DataFrame:
        steps = 1 + max([self._steps.get(s, 0) for s in source_ids], default=0)
        if self.checkpoint_every and steps > self.checkpoint_every:
            frame, steps = frame.checkpoint(), 0
        self._steps[target] = steps
        return frame


OPERATIONS: dict[str, Operation] = {}

DATASET = Param("dataset_id", required=True, description="The dataset to read.", pattern=ID_PATTERN)
INTO = Param("into", description="The dataset to write; by default the one read.", pattern=ID_PATTERN)
INTO_REQUIRED = Param("into", required=True, description="The dataset to write.", pattern=ID_PATTERN)
EXPLAIN = Param("explain", "boolean", description="Whether stats hold the plan.", default=False)
PATH = Param("path", required=True, description="File, folder or glob.")
NEW_DATASET = Param("dataset_id", required=True, description="The dataset to register.", pattern=ID_PATTERN)


def operation(name: str, description: str, *parameters: Param):
    def add(run: Callable[[Call], Response]):
        op_id = f"dataframe_{name}"
        OPERATIONS[op_id] = Operation(op_id, "DataFrame " + name.replace("_", " ").title(), description, parameters, run)
        return run

    return add


#: Operations that give as many rows as they read.
KEEP_ROWS = ("select", "with_column", "rename", "window", "fillna")


def transform(name: str, description: str, build: Callable[[DataFrame, Mapping[str, Any]], Any], *parameters: Param, into: Param = INTO, explain: bool = True) -> None:
    """An operation of one dataset whose builder gives a frame, or a frame and warnings."""

    def known(entry: Dataset, params: Mapping[str, Any]) -> int | None:
        if entry.row_count is None or name not in (*KEEP_ROWS, "sort"):
            return None
        limit = to_int(params.get("limit")) if name == "sort" else None
        return entry.row_count if limit is None else min(limit, entry.row_count)

    def run(call: Call) -> Response:
        entry = call.dataset()
        built = build(entry.frame, call.params)
        frame, warnings = built if isinstance(built, tuple) else (built, [])
        call.warnings += warnings
        frame = call.engine.cut([entry.id], call.target, frame)
        return call.finish(frame, call.target, f"{name}:{entry.id}", explain=explain and bool(to_bool(call.params.get("explain"))), rows=known(entry, call.params))

    operation(name, description, DATASET, into, *parameters, *([EXPLAIN] if explain else []))(run)


# Sources and sink


def _load(kind: str, read: Callable[[Call, str], DataFrame], directory: bool = False) -> Callable[[Call], Response]:
    def run(call: Call) -> Response:
        path = must_exist(call.engine.spark, text(call.params["path"]), call.engine.path_policy, directory)
        scanned = tree_size(call.engine.spark, path, ".parquet") if directory else size_of(call.engine.spark, path)
        return call.finish(read(call, path), str(call.params["dataset_id"]), f"{kind}:{path}", scanned)

    return run


operation("load_csv", "Registers a CSV file.", PATH, NEW_DATASET, Param("header", "boolean"), Param("delimiter"), Param("quote"), Param("null_string"), Param("columns", "object", description="Types by column name."), Param("sample_size", "integer", description="Rows that types are inferred from; -1 for all."))(_load("csv", lambda c, path: readers.read_csv(c.engine.spark, path, c.params)))
operation("load_json", "Registers a JSON file: an array, or an object a line.", PATH, NEW_DATASET, Param("format", allowed=("auto", "newline_delimited", "array"), default="auto"))(_load("json", lambda c, path: readers.read_json(c.engine.spark, path, c.params)))
operation("load_parquet", "Registers Parquet files.", PATH, NEW_DATASET, Param("hive_partitioning", "boolean"), Param("union_by_name", "boolean"))(_load("parquet", lambda c, path: readers.read_parquet(c.engine.spark, path, c.params)))


@operation("load_delta", "Registers a Delta table, latest or as of a version or time.", PATH, NEW_DATASET, Param("version", "integer", minimum=0), Param("timestamp"))
def _load_delta(call: Call) -> Response:
    version, moment = call.params.get("version"), text(call.params.get("timestamp"))
    if version is not None and moment is not None:
        raise FrameError(INVALID_TYPE, "'version' and 'timestamp' exclude each other.")
    if moment is not None:
        delta.parse_moment(moment)
    return _load("delta", lambda c, path: delta.read(c.engine.spark, path, to_int(version), moment), directory=True)(call)


@operation("export", "Writes a dataset to a file or table.", DATASET, PATH, Param("format", required=True, allowed=writers.FORMATS), Param("partition_by", "array"), Param("compression"), Param("array", "boolean", default=False), Param("many_files", "boolean", description="Parquet as a folder of files, written in parallel.", default=False), Param("mode", allowed=("error", "append", "overwrite"), default="error"), Param("header", "boolean"), Param("delimiter"), Param("quote"), Param("escape"))
def _export(call: Call) -> Response:
    entry = call.dataset()
    writers.export(entry.frame, call.params, call.engine.path_policy)
    rows = entry.row_count if entry.row_count is not None else entry.frame.count()
    call.warnings.append(f"Exported {rows} rows to {call.params['path']} ({call.params['format']}).")
    return Response.ok(entry.id, describe(entry.frame.schema), rows, [], call.stats(rows), call.warnings)


# Inspection


@operation("schema", "Describes a dataset without reading it.", DATASET)
def _schema(call: Call) -> Response:
    entry = call.dataset()
    return Response.ok(entry.id, describe(entry.frame.schema), entry.row_count or 0, [], call.stats(0), call.warnings)


@operation("profile", "Statistics of each column.", DATASET, Param("columns", "array"), Param("quantiles", "array"))
def _profile(call: Call) -> Response:
    entry = call.dataset()
    rows = quality.profile(entry.frame, call.params, rows=entry.row_count)
    schema = [ColumnSchema(k, quality.profile_type(k, rows[0])) for k in (rows[0] if rows else ())]
    return Response.ok(entry.id, schema, len(rows), rows[:PREVIEW_ROWS], call.stats(len(rows)), call.warnings)


@operation("preview", "Shows rows of a dataset.", DATASET, Param("mode", allowed=("head", "tail", "sample"), default="head"), Param("limit", "integer", minimum=1, maximum=MOST_PREVIEW_ROWS, default=PREVIEW_ROWS), Param("seed", "integer"))
def _preview(call: Call) -> Response:
    entry, mode, n = call.dataset(), call.params.get("mode") or "head", to_int(call.params.get("limit")) or PREVIEW_ROWS
    if mode == "sample" and call.params.get("seed") is None:
        raise FrameError(INVALID_ARGUMENT, "Mode 'sample' requires a 'seed'.")
    frame = entry.frame
    total = entry.row_count if entry.row_count is not None and mode != "tail" else frame.count()
    if mode == "sample":
        rows = relational.sample(frame, {"n": n, "seed": call.params["seed"]}).collect()
    else:
        rows = (frame.offset(max(0, total - n)) if mode == "tail" and total > n else frame).limit(n).collect()
    return Response.ok(entry.id, describe(frame.schema), total, plain_rows(rows, frame.columns), call.stats(len(rows)), call.warnings)


@operation("assert", "Checks expectations and reports on each.", DATASET, Param("expectations", "array", required=True))
def _assert(call: Call) -> Response:
    entry = call.dataset()
    rows = quality.check(entry.frame, call.params)
    failed = sum(not r["passed"] for r in rows)
    if failed:
        call.warnings.append(f"Assertion failed: {failed} of {len(rows)} expectations did not hold (see preview_rows).")
    return Response.ok(entry.id, [ColumnSchema(*c) for c in quality.REPORT_COLUMNS], len(rows), rows, call.stats(len(rows)), call.warnings)


# Transforms

transform("value_counts", "Values of a column with count and proportion.", grouping.value_counts, Param("column", required=True), Param("limit", "integer", minimum=1), Param("dropna", "boolean", default=True), explain=False)
transform("select", "Keeps columns, renamed or not.", relational.select, Param("columns", "array", required=True))
transform("filter", "Keeps rows that a predicate holds for.", relational.filter_rows, Param("predicate", "object", required=True))
transform("with_column", "Adds or replaces a column.", relational.with_column, Param("name", required=True), Param("expression", "object", required=True))
transform("rename", "Renames columns.", relational.rename, Param("columns", "object", required=True), into=INTO_REQUIRED)
transform("group_by", "Aggregates groups.", grouping.group_by, Param("group_by", "array", required=True), Param("aggregations", "array", required=True), Param("having", "object"))
transform("window", "Adds window functions.", windows.window, Param("functions", "array", required=True), Param("partition_by", "array"), Param("order_by", "array"), Param("frame", "object"))
transform("pivot", "Turns values of a column into columns.", reshape.pivot, Param("index", "array", required=True), Param("columns", required=True), Param("values", "any", required=True), Param("aggregation"))
transform("unpivot", "Turns columns into rows.", reshape.unpivot, Param("id_columns", "array", required=True), Param("value_columns", "array", required=True), Param("name_to", default="name"), Param("value_to", default="value"))
transform("unnest", "A row for each element of a list.", reshape.unnest, Param("column", required=True))
transform("sample", "A repeatable sample of n rows.", relational.sample, Param("n", "integer", required=True, minimum=1), Param("seed", "integer", required=True))
transform("sort", "Orders rows, and keeps the first ones if limited.", relational.sort, Param("by", "array", required=True), Param("limit", "integer", minimum=1))
transform("distinct", "Keeps one row of each kind.", relational.distinct, Param("columns", "array"), Param("keep", allowed=("first", "last"), default="first"), Param("order_by", "array"))
transform("fillna", "Fills nulls with values or neighbours.", missing.fillna, Param("value", "any"), Param("values", "object"), Param("method", allowed=("ffill", "bfill")), Param("order_by", "array"), Param("partition_by", "array"), Param("columns", "array"))
transform("dropna", "Drops rows with nulls.", missing.dropna, Param("columns", "array"), Param("how", allowed=("any", "all"), default="any"))


@operation("join", "Joins two datasets.", Param("left", required=True, pattern=ID_PATTERN), Param("right", required=True, pattern=ID_PATTERN), INTO_REQUIRED, Param("how", allowed=joins.KINDS, default="inner"), Param("on", "array"), Param("left_on", "array"), Param("right_on", "array"), Param("asof_op", allowed=(">=", "<="), default=">="), Param("suffix", default="_right"), EXPLAIN)
def _join(call: Call) -> Response:
    left, right = call.dataset("left"), call.dataset("right")
    frame = call.engine.cut([left.id, right.id], call.target, joins.join(left.frame, right.frame, call.params))
    return call.finish(frame, call.target, f"join:{left.id}+{right.id}", explain=bool(to_bool(call.params.get("explain"))))


@operation("union", "Stacks datasets.", Param("datasets", "array", required=True), INTO_REQUIRED, Param("by_name", "boolean", default=False), Param("distinct", "boolean", default=False), EXPLAIN)
def _union(call: Call) -> Response:
    ids = [str(x) for x in call.params["datasets"]] if is_array(call.params["datasets"]) else []
    if len(ids) < 2:
        raise FrameError(INVALID_ARGUMENT, "'datasets' must name at least two datasets.")
    frames = [call.engine.catalog.get(i).frame for i in ids]
    frame = call.engine.cut(ids, call.target, relational.union(frames, call.params))
    return call.finish(frame, call.target, f"union:{'+'.join(ids)}", explain=bool(to_bool(call.params.get("explain"))))


# Catalog


@operation("list", "Lists the session's datasets.")
def _list(call: Call) -> Response:
    rows = [{"dataset_id": e.id, "row_count": e.row_count, "column_count": len(e.frame.columns), "source": e.source} for e in call.engine.catalog]
    schema = [ColumnSchema("dataset_id", "VARCHAR", False), ColumnSchema("row_count", "BIGINT"), ColumnSchema("column_count", "BIGINT", False), ColumnSchema("source", "VARCHAR", False)]
    return Response.ok("session", schema, len(rows), rows, call.stats(len(rows)), call.warnings)


@operation("drop", "Forgets a dataset. Those derived from it go on.", DATASET)
def _drop(call: Call) -> Response:
    entry = call.engine.catalog.drop(str(call.params["dataset_id"]))
    call.warnings.append(f"Dataset '{entry.id}' dropped.")
    return Response.ok(entry.id, [], 0, [], call.stats(0), call.warnings)

