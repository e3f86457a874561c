"""Queries through the engine: files, Delta tables, inspection, the catalog and limits, each with SQL for the same rows.

Files go to a new folder below spark.checkpoint.dir, or, locally without that setting, below
the temporary folder. Where a result isn't rows of a table, the query reports facts about it.
"""

from __future__ import annotations

import json
import os
import tempfile
import threading
import uuid
from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine, Options
from .envelope import Response
from .queries import col, columns, cond, fn, keep, lit, query
from .sources.delta import Log
from .sources.stores import store_of


class Session:
    """An engine with some tables of a folder, and a folder for its files."""

    def __init__(self, spark: SparkSession, sf_dir: str, *tables: str):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
            base = "file://" + os.path.join(tempfile.gettempdir(), "lumenframe-queries")
        self.spark, self.folder, self.engine = spark, f"{base}/{uuid.uuid4().hex}", Engine(spark)
        for name in tables:
            self.do("load_parquet", path=f"{sf_dir}/{name}.parquet", dataset_id=name)

    def run(self, op: str, **params: Any) -> Response:
        return self.engine.execute(f"dataframe_{op}", params)

    def do(self, op: str, **params: Any) -> Response:
        r = self.run(op, **params)
        if not r.success:
            raise RuntimeError(f"{op}: {r.error_code} {r.message}")
        return r

    def steps(self, source: str, *steps: tuple[str, Mapping[str, Any]]) -> str:
        """Applies the steps one after another, each to the last one's dataset."""
        for op, params in steps:
            self.do(op, dataset_id=source, into="t", **params)
            source = "t"
        return source

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def frame(self, name: str) -> DataFrame:
        return self.engine.catalog.get(name).frame

    def there_and_back(self, source: str, name: str, fmt: str, load: Mapping[str, Any] | None = None, **params: Any) -> DataFrame:
        self.do("export", dataset_id=source, path=self.path(name), format=fmt, **params)
        self.do(f"load_{fmt}", path=self.path(name), dataset_id="back", **(load or {}))
        return self.frame("back")


def facts(spark: SparkSession, rows: list[tuple[str, Any]]) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in rows], "fact string, value string")


def facts_sql(*rows: tuple[str, Any]) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in rows) + ") AS t(fact, value)"


# Files

_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"
_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"
_CUSTOMER = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer"


@query("file_csv", _ORDERS)
def _csv(spark, d):
    return Session(spark, d, "orders").there_and_back("orders", "o.csv", "csv")


@query("file_csv_late_line_ends", "SELECT c_custkey, CASE WHEN c_custkey >= (SELECT max(c_custkey) FROM customer) - 2 THEN concat(c_name, chr(10), '\"', c_mktsegment, '\"') END AS note FROM customer")
def _csv_line_ends(spark, d):
    s = Session(spark, d, "customer")
    last = s.frame("customer").agg(F.max("c_custkey")).first()[0]
    note = {"op": "case", "when": [{"predicate": cond("c_custkey", "gte", last - 2), "then": fn("concat", col("c_name"), '\n"', col("c_mktsegment"), '"')}]}
    s.do("sort", dataset_id="customer", into="customer", by=[col("c_custkey")])
    s.steps("customer", *columns(("note", note)), keep("c_custkey", "note"))
    return s.there_and_back("t", "notes.csv", "csv")


@query("file_csv_dialect", "SELECT CAST(c_custkey AS INTEGER) AS column0, c_name AS column1, CASE WHEN c_nationkey <> 3 THEN c_mktsegment END AS column2 FROM customer")
def _csv_dialect(spark, d):
    s = Session(spark, d, "customer")
    segment = {"op": "case", "when": [{"predicate": cond("c_nationkey", "eq", 3), "then": lit("none;'given'")}], "else": col("c_mktsegment")}
    s.steps("customer", *columns(("segment", segment)), keep("c_custkey", "c_name", "segment"))
    return s.there_and_back("t", "c.txt", "csv", {"header": False, "delimiter": ";", "quote": "'", "null_string": "none;'given'", "columns": {"column0": "INTEGER"}, "sample_size": -1}, header=False, delimiter=";", quote="'")


@query("file_csv_gz", _ORDERS)
def _csv_gz(spark, d):
    s = Session(spark, d, "orders")
    s.frame("orders").write.options(header=True, compression="gzip", timestampNTZFormat="yyyy-MM-dd HH:mm:ss").csv(s.path("gz"))
    s.do("load_csv", path=f"{s.path('gz')}/*.csv.gz", dataset_id="back")
    return s.frame("back")


for _name, _array in (("file_json_lines", False), ("file_json_array", True)):

    @query(_name, _NATION)
    def _json(spark, d, array=_array):
        return Session(spark, d, "nation").there_and_back("nation", "n.json", "json", {"format": "array" if array else "newline_delimited"}, array=array)


@query("file_json_compressed", _NATION)
def _json_gz(spark, d):
    return Session(spark, d, "nation").there_and_back("nation", "n.json.gz", "json", compression="gzip")


@query("file_parquet", _CUSTOMER)
def _parquet(spark, d):
    return Session(spark, d, "customer").there_and_back("customer", "c.parquet", "parquet", compression="zstd")


@query("file_parquet_many_files", _CUSTOMER)
def _parquet_many(spark, d):
    return Session(spark, d, "customer").there_and_back("customer", "c.parquet", "parquet", many_files=True)


@query("file_parquet_partitioned", "SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus FROM lineitem")
def _parquet_partitioned(spark, d):
    s = Session(spark, d, "lineitem")
    s.steps("lineitem", keep("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"))
    return s.there_and_back("t", "lines", "parquet", {"hive_partitioning": True}, partition_by=["l_returnflag", "l_linestatus"])


@query("file_parquet_union_by_name", "SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS INTEGER) AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
def _parquet_by_name(spark, d):
    s = Session(spark, d, "nation", "region")
    for name in ("nation", "region"):
        s.do("export", dataset_id=name, path=s.path(f"all/{name}.parquet"), format="parquet")
    s.do("load_parquet", path=s.path("all/*.parquet"), dataset_id="back", union_by_name=True)
    return s.frame("back")


@query("file_export_modes", facts_sql(("first", "25"), ("again", "TARGET_EXISTS"), ("overwrite", "5"), ("rows", "5"), ("append", "INVALID_ARGUMENT")))
def _modes(spark, d):
    s, out = Session(spark, d, "nation", "region"), []
    to = {"path": s.path("x.csv"), "format": "csv"}
    for fact, r in (("first", s.run("export", dataset_id="nation", **to)), ("again", s.run("export", dataset_id="region", **to)), ("overwrite", s.run("export", dataset_id="region", mode="overwrite", **to)), ("rows", s.run("load_csv", path=to["path"], dataset_id="x")), ("append", s.run("export", dataset_id="region", mode="append", **to))):
        out.append((fact, r.row_count if r.success else r.error_code))
    return facts(spark, out)


_BAD_OPTIONS: dict[str, tuple[str, str, dict[str, Any]]] = {
    "array of csv": ("INVALID_ARGUMENT", "export", {"format": "csv", "array": True}),
    "compression of csv": ("INVALID_ARGUMENT", "export", {"format": "csv", "compression": "gzip"}),
    "compression text": ("INVALID_TYPE", "export", {"format": "parquet", "compression": "a b"}),
    "partitions of json": ("INVALID_ARGUMENT", "export", {"format": "json", "partition_by": ["r_name"]}),
    "header of parquet": ("INVALID_ARGUMENT", "export", {"format": "parquet", "header": True}),
    "long delimiter": ("INVALID_ARGUMENT", "export", {"format": "csv", "delimiter": ";;"}),
    "unknown partition": ("COLUMN_NOT_FOUND", "export", {"format": "parquet", "partition_by": ["zzz"]}),
    "unknown format": ("INVALID_ARGUMENT", "export", {"format": "xml"}),
    "missing file": ("FILE_NOT_FOUND", "load_csv", {}),
    "sample size": ("INVALID_ARGUMENT", "load_csv", {"sample_size": 0}),
    "version and time": ("INVALID_TYPE", "load_delta", {"version": 0, "timestamp": "2024-01-01"}),
}


@query("file_option_checks", facts_sql(*((k, code) for k, (code, _, _) in _BAD_OPTIONS.items())))
def _options(spark, d):
    s = Session(spark, d, "region")
    s.do("export", dataset_id="region", path=s.path("there.csv"), format="csv")
    path = {"sample size": s.path("there.csv")}
    return facts(spark, [(k, s.run(op, path=path.get(k, s.path("x")), dataset_id="region" if op == "export" else "x", **p).error_code) for k, (_, op, p) in _BAD_OPTIONS.items()])


@query("file_bytes_scanned", facts_sql(*((k, True) for k in ("csv", "json", "parquet", "delta"))))
def _bytes(spark, d):
    """Whether a load reports the sizes of the data files that it reads."""
    s, out = Session(spark, d, "customer"), []
    for fmt in ("csv", "json", "parquet", "delta"):
        path = s.path(f"c.{fmt}")
        s.do("export", dataset_id="customer", path=path, format=fmt)
        store = store_of(spark, path)
        at = store.absolute(path)
        size = sum(store.size(f"{at}/{f}") for f in store.files(at) if f.endswith(".parquet")) if store.is_dir(at) else store.size(at)
        out.append((fmt, s.do(f"load_{fmt}", path=path, dataset_id="x").stats.bytes_scanned == size))
    return facts(spark, out)


# Delta tables


def _named(source: str, key: str, name: str) -> tuple[tuple[str, Mapping[str, Any]], ...]:
    return (("select", {"columns": [{"column": key, "as": "k"}, {"column": name, "as": "name"}]}),)


def _versions(s: Session) -> str:
    """A table of nations, then with regions too."""
    path = s.path("t")
    s.do("export", dataset_id=s.steps("nation", *_named("nation", "n_nationkey", "n_name")), path=path, format="delta")
    s.do("export", dataset_id=s.steps("region", *_named("region", "r_regionkey", "r_name")), path=path, format="delta", mode="append")
    return path


@query("delta_versions", "SELECT 'v0' AS asked, n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT asked, n_nationkey, n_name FROM nation, (VALUES ('v1'), ('latest'), ('2100')) v(asked) UNION ALL SELECT asked, r_regionkey, r_name FROM region, (VALUES ('v1'), ('latest'), ('2100')) v(asked)")
def _delta_versions(spark, d):
    s = Session(spark, d, "nation", "region")
    path, frames = _versions(s), []
    for asked, how in (("v0", {"version": 0}), ("v1", {"version": 1}), ("latest", {}), ("2100", {"timestamp": "2100-01-01T00:00:00Z"})):
        s.do("load_delta", path=path, dataset_id="x", **how)
        frames.append(s.frame("x").select(F.lit(asked).alias("asked"), "k", "name"))
    return frames[0].unionAll(frames[1]).unionAll(frames[2]).unionAll(frames[3])


@query("delta_overwrite", "SELECT r_regionkey, r_name FROM region")
def _delta_overwrite(spark, d):
    s = Session(spark, d, "nation", "region")
    s.do("export", dataset_id="nation", path=s.path("t"), format="delta")
    return s.there_and_back("region", "t", "delta", mode="overwrite")


@query("delta_partitioned", "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority FROM orders")
def _delta_partitioned(spark, d):
    """With a null partition; half of the rows are appended."""
    s = Session(spark, d, "orders")
    s.steps("orders", *columns(("priority", fn("nullif", col("o_orderpriority"), "5-LOW"))), keep("o_orderkey", "o_totalprice", "priority"))
    s.do("filter", dataset_id="t", into="low", predicate=cond("o_totalprice", "lt", 150000))
    s.do("filter", dataset_id="t", into="high", predicate=cond("o_totalprice", "gte", 150000))
    s.do("export", dataset_id="low", path=s.path("t"), format="delta", partition_by=["priority"])
    return s.there_and_back("high", "t", "delta", mode="append")


@query("delta_refusals", facts_sql(("newer reader", "BACKEND_ERROR"), ("column mapping", "BACKEND_ERROR"), ("deletion vector", "BACKEND_ERROR"), ("file elsewhere", "BACKEND_ERROR"), ("checkpoint", "BACKEND_ERROR"), ("no table", "FILE_NOT_FOUND"), ("no version", "BACKEND_ERROR"), ("too early", "BACKEND_ERROR"), ("other columns", "SCHEMA_MISMATCH"), ("append to nothing", "FILE_NOT_FOUND"), ("removed file", "5")))
def _delta_refusals(spark, d):
    s, out = Session(spark, d, "nation", "region"), []

    def commit(name: str, version: int, *actions: Mapping[str, Any], file: str | None = None) -> str:
        store, path = store_of(spark, s.path(name)), s.path(name)
        at = store.absolute(path)
        store.mkdirs(f"{at}/_delta_log")
        store.create(f"{at}/_delta_log/{file or f'{version:020d}.json'}", [json.dumps(a) + "\n" for a in actions])
        return path

    for fact, action in (("newer reader", {"protocol": {"minReaderVersion": 3}}), ("column mapping", {"metaData": {"configuration": {"delta.columnMapping.mode": "name"}}}), ("deletion vector", {"add": {"path": "a.parquet", "deletionVector": {"x": 1}}}), ("file elsewhere", {"add": {"path": "s3://b/a.parquet"}})):
        out.append((fact, s.run("load_delta", path=commit(fact.replace(" ", "_"), 0, action), dataset_id="x").error_code))
    commit("old", 0, {"protocol": {"minReaderVersion": 1}})
    out.append(("checkpoint", s.run("load_delta", path=commit("old", 0, file="_last_checkpoint"), dataset_id="x").error_code))
    s.do("export", dataset_id="region", path=s.path("plain"), format="parquet", many_files=True)
    out.append(("no table", s.run("load_delta", path=s.path("plain"), dataset_id="x").error_code))
    path = _versions(s)
    out.append(("no version", s.run("load_delta", path=path, dataset_id="x", version=7).error_code))
    out.append(("too early", s.run("load_delta", path=path, dataset_id="x", timestamp="1999-01-01").error_code))
    out.append(("other columns", s.run("export", dataset_id="region", path=path, format="delta", mode="append").error_code))
    out.append(("append to nothing", s.run("export", dataset_id="region", path=s.path("plain"), format="delta", mode="append").error_code))
    log = Log(spark, path)
    gone = [{"remove": {"path": a["add"]["path"], "dataChange": True}} for a in log.actions(log.commits()[0]) if "add" in a]
    log.put(2, gone)
    out.append(("removed file", s.do("load_delta", path=path, dataset_id="x").row_count))
    return facts(spark, out)


@query("delta_concurrent_appends", "SELECT r_regionkey, r_name, CAST(5 AS BIGINT) AS copies, CAST(4 AS BIGINT) AS last_version FROM region")
def _delta_concurrent(spark, d):
    """Four appends at once to a table of one version."""
    s, path = Session(spark, d, "region"), ""
    path = s.path("t")
    s.do("export", dataset_id="region", path=path, format="delta")
    threads = [threading.Thread(target=s.run, args=("export",), kwargs={"dataset_id": "region", "path": path, "format": "delta", "mode": "append"}) for _ in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    s.do("load_delta", path=path, dataset_id="x")
    return s.frame("x").groupBy("r_regionkey", "r_name").agg(F.count("*").alias("copies")).withColumn("last_version", F.lit(max(Log(spark, path).commits())).cast("long"))


@query("delta_file_stats", "SELECT c_mktsegment AS segment, count(*) AS rows, min(c_custkey) AS low, max(c_custkey) AS high, CAST(count(*) FILTER (WHERE c_nationkey = 3) AS BIGINT) AS nulls FROM customer GROUP BY c_mktsegment")
def _delta_stats(spark, d):
    """Of each partition, from the log alone."""
    s = Session(spark, d, "customer")
    s.steps("customer", *columns(("nation", fn("nullif", col("c_nationkey"), 3))), keep("c_custkey", "nation", "c_mktsegment"))
    s.do("export", dataset_id="t", path=s.path("t"), format="delta", partition_by=["c_mktsegment"])
    log = Log(spark, s.path("t"))
    adds = [(a["add"]["partitionValues"]["c_mktsegment"], json.loads(a["add"]["stats"])) for a in log.actions(log.commits()[0]) if "add" in a]
    rows = [(k, x["numRecords"], x["minValues"]["c_custkey"], x["maxValues"]["c_custkey"], x["nullCount"]["nation"]) for k, x in adds]
    return spark.createDataFrame(rows, "segment string, n long, low long, high long, nulls long").groupBy("segment").agg(F.sum("n").alias("rows"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("nulls").alias("nulls"))


# Inspection, catalog, limits


@query("preview_modes", "SELECT 'head' AS mode, c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_custkey LIMIT 7) UNION ALL SELECT 'tail', c_custkey, c_name FROM (SELECT * FROM customer ORDER BY c_custkey DESC LIMIT 7) UNION ALL SELECT 'sample', c_custkey, c_name FROM customer")
def _previews(spark, d):
    """The sample is of all rows, so that it must be the table."""
    s = Session(spark, d, "customer")
    s.do("sort", dataset_id="customer", into="customer", by=[col("c_custkey")])
    rows = [(m, r["c_custkey"], r["c_name"]) for m in ("head", "tail") for r in s.do("preview", dataset_id="customer", mode=m, limit=7).preview_rows]
    n = s.do("schema", dataset_id="customer").row_count
    s.do("sample", dataset_id="customer", into="sampled", n=n, seed=5)
    return spark.createDataFrame(rows, "mode string, c_custkey long, c_name string").unionAll(s.frame("sampled").select(F.lit("sample").alias("mode"), "c_custkey", "c_name"))


@query("sample_properties", facts_sql(("rows", 50), ("distinct", 50), ("known", 50), ("repeatable", True), ("other seed differs", True), ("preview", 20), ("preview without seed", "INVALID_ARGUMENT")))
def _sample(spark, d):
    s, picked = Session(spark, d, "customer"), {}
    for into, seed in (("a", 7), ("b", 7), ("c", 8)):
        s.do("sample", dataset_id="customer", into=into, n=50, seed=seed)
        picked[into] = [r["c_custkey"] for r in s.frame(into).select("c_custkey").collect()]
    known = s.frame("a").join(s.frame("customer").select("c_custkey", "c_name"), ["c_custkey", "c_name"], "left_semi").count()
    preview = s.do("preview", dataset_id="customer", mode="sample", limit=20, seed=1)
    return facts(spark, [("rows", len(picked["a"])), ("distinct", len(set(picked["a"]))), ("known", known), ("repeatable", sorted(picked["a"]) == sorted(picked["b"])), ("other seed differs", sorted(picked["a"]) != sorted(picked["c"])), ("preview", len(preview.preview_rows)), ("preview without seed", s.run("preview", dataset_id="customer", mode="sample").error_code)])


@query("catalog_operations", facts_sql(("schema", "n_nationkey INTEGER, n_name VARCHAR, n_regionkey INTEGER"), ("schema rows", 25), ("list", "nation 25 3, region 5 2"), ("drop", True), ("list after", "region 5 2"), ("dropped", "DATASET_NOT_FOUND"), ("drop again", "DATASET_NOT_FOUND"), ("derived stays", 10)))
def _catalog(spark, d):
    s, out = Session(spark, d, "nation", "region"), []

    def listed() -> str:
        return ", ".join(f"{r['dataset_id']} {r['row_count']} {r['column_count']}" for r in s.do("list").preview_rows)

    schema = s.do("schema", dataset_id="nation")
    out += [("schema", ", ".join(f"{c.name} {c.type}" for c in schema.schema)), ("schema rows", schema.row_count), ("list", listed())]
    s.do("filter", dataset_id="nation", into="some", predicate=cond("n_regionkey", "lt", 2))
    some = s.frame("some")
    s.do("drop", dataset_id="some")
    out += [("drop", s.run("drop", dataset_id="nation").success), ("list after", listed()), ("dropped", s.run("schema", dataset_id="nation").error_code), ("drop again", s.run("drop", dataset_id="nation").error_code), ("derived stays", some.count())]
    return facts(spark, out)


@query("explain_and_limits", facts_sql(("plan", True), ("no plan", True), ("timeout", "CANCELLED"), ("cancelled before", "CANCELLED"), ("within limits", 25), ("memory warns", True)))
def _limits(spark, d):
    s = Session(spark, d, "nation", "lineitem")
    plan = s.do("filter", dataset_id="nation", into="x", predicate=cond("n_regionkey", "eq", 1), explain=True).stats.plan
    none = s.do("filter", dataset_id="nation", into="x", predicate=cond("n_regionkey", "eq", 1)).stats.plan
    stop = threading.Event()
    stop.set()
    slow = {"left": "lineitem", "right": "lineitem", "into": "x", "how": "cross"}
    timeout = s.engine.execute("dataframe_join", slow, Options(max_execution_time_ms=1))
    cancelled = s.engine.execute("dataframe_schema", {"dataset_id": "nation"}, Options(cancel=stop))
    fine = s.engine.execute("dataframe_sort", {"dataset_id": "nation", "into": "x", "by": [col("n_name")]}, Options(max_execution_time_ms=600_000, max_memory_bytes=1 << 30))
    return facts(spark, [("plan", bool(plan) and "Filter" in plan), ("no plan", none is None), ("timeout", timeout.error_code), ("cancelled before", cancelled.error_code), ("within limits", fine.row_count), ("memory warns", bool(fine.warnings))])


@query("aggregate_properties", facts_sql(("approx_count_distinct within 10 %", True), ("approx_quantile within 1 % of ranks", True), ("hash alike", True), ("hash of equal values", True), ("hash collisions", 0)))
def _properties(spark, d):
    """Of functions whose values engines needn't share."""
    s = Session(spark, d, "orders", "customer")
    s.do("group_by", dataset_id="orders", into="g", group_by=[], aggregations=[{"column": "o_custkey", "function": f, "alias": f} for f in ("count_distinct", "approx_count_distinct")] + [{"column": "o_totalprice", "function": "approx_quantile", "q": 0.5, "alias": "q"}])
    g = s.frame("g").first()
    below = s.frame("orders").agg(F.avg((F.col("o_totalprice") <= g["q"]).cast("double"))).first()[0]
    s.steps("customer", *columns(("h", fn("hash", col("c_name"))), ("same", fn("hash", fn("concat", col("c_name"), ""))), ("segment", fn("hash", col("c_mktsegment")))))
    h = s.frame("t").agg(F.count_distinct("c_name") - F.count_distinct("h"), F.count_distinct("c_mktsegment") == F.count_distinct("segment"), F.bool_and(F.col("h") == F.col("same"))).first()
    return facts(spark, [("approx_count_distinct within 10 %", abs(g["approx_count_distinct"] / g["count_distinct"] - 1) < 0.1), ("approx_quantile within 1 % of ranks", abs(below - 0.5) < 0.01), ("hash alike", h[2]), ("hash of equal values", h[1]), ("hash collisions", h[0])])
