"""Queries for the operations, aggregates and functions over the test tables, each with SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.dates import FORMATS
from .operators import grouping, joins, missing, quality, relational, reshape, windows
from .schema import quoted

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

STEPS: dict[str, Callable[[DataFrame, Mapping[str, Any]], Any]] = {
    "select": relational.select, "rename": relational.rename, "filter": relational.filter_rows, "with_column": relational.with_column,
    "sort": relational.sort, "distinct": relational.distinct, "sample": relational.sample, "group_by": grouping.group_by,
    "value_counts": grouping.value_counts, "window": windows.window, "pivot": reshape.pivot, "unpivot": reshape.unpivot,
    "unnest": reshape.unnest, "fillna": missing.fillna, "dropna": missing.dropna,
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(df: DataFrame, *steps: tuple[str, Mapping[str, Any]]) -> DataFrame:
    for op, params in steps:
        built = STEPS[op](df, params)
        df = built[0] if isinstance(built, tuple) else built
    return df


def chain(name: str, source: str, sql: str | None, *steps: tuple[str, Mapping[str, Any]]) -> None:
    """A query of one table through steps."""
    QUERIES[name] = lambda spark, sf_dir: run(table(spark, sf_dir, source), *steps)
    if sql:
        ORACLES[name] = sql


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def col(name: str) -> dict[str, Any]:
    return {"column": name}


def lit(x: Any) -> dict[str, Any]:
    return {"literal": x}


def fn(op: str, *args: Any, **more: Any) -> dict[str, Any]:
    return {"op": op, "args": [a if isinstance(a, Mapping) else lit(a) for a in args], **more}


def cond(column: str, op: str, value: Any = None, **more: Any) -> dict[str, Any]:
    return {"column": column, "op": op, **({"value": value} if value is not None else {}), **more}


def columns(*pairs: tuple[str, Mapping[str, Any]]) -> list[tuple[str, Mapping[str, Any]]]:
    return [("with_column", {"name": n, "expression": e}) for n, e in pairs]


def keep(*names: str) -> tuple[str, Mapping[str, Any]]:
    return "select", {"columns": list(names)}


def desc(name: str) -> dict[str, str]:
    return {"column": name, "direction": "desc"}


# Predicates

chain("filter_comparisons", "lineitem", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity >= 45 AND l_discount > 0.05 AND l_tax <= 0.04 AND l_returnflag <> 'N' AND l_linenumber < 4 AND l_linestatus = 'F'",
      ("filter", {"predicate": {"op": "and", "conditions": [cond("l_quantity", "gte", 45), cond("l_discount", "gt", 0.05), cond("l_tax", "lte", 0.04), cond("l_returnflag", "neq", "N"), cond("l_linenumber", "lt", 4), cond("L_LINESTATUS", "eq", "F")]}}),
      keep("l_orderkey", "l_linenumber", "l_quantity"))
chain("filter_in_between_not", "orders", "SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE (o_orderstatus IN ('F','O') OR o_totalprice BETWEEN 1000 AND 50000) AND NOT (o_orderpriority IN ('1-URGENT','5-LOW')) AND o_orderdate >= TIMESTAMP '1996-01-01'",
      ("filter", {"predicate": {"op": "and", "conditions": [{"op": "or", "conditions": [cond("o_orderstatus", "in", values=["F", "O"]), cond("o_totalprice", "between", low=1000, high=50000)]}, {"op": "not", "condition": cond("o_orderpriority", "in", values=["1-URGENT", "5-LOW"])}, cond("o_orderdate", "gte", "1996-01-01")]}}),
      keep("o_orderkey", "o_orderpriority", "o_totalprice"))
#: Operator, column, pattern, and SQL of the same condition. Each holds for some rows of the table and not for others.
_TEXT_OPS = (
    ("like", "p_type", "%ROM%", "p_type LIKE '%ROM%'"), ("ilike", "p_name", "%WID_ET", "p_name ILIKE '%WID_ET'"), ("starts_with", "p_brand", "Brand#1", "starts_with(p_brand, 'Brand#1')"),
    ("ends_with", "p_brand", "5", "ends_with(p_brand, '5')"), ("contains", "p_name", "ol", "contains(p_name, 'ol')"), ("matches", "p_name", "^(cold|l.rge) w", "regexp_matches(p_name, '^(cold|l.rge) w')"),
)
for _op, _column, _pattern, _where in _TEXT_OPS:
    chain(f"filter_{_op}", "part", f"SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE {_where}", ("filter", {"predicate": cond(_column, _op, _pattern)}), keep("p_partkey", "p_name", "p_brand", "p_type"))
chain("filter_value_column", "lineitem", "SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax AND l_linestatus < l_returnflag",
      ("filter", {"predicate": {"op": "and", "conditions": [cond("l_discount", "gt", value_column="l_tax"), cond("l_linestatus", "lt", value_column="l_returnflag")]}}), keep("l_orderkey", "l_linenumber", "l_discount", "l_tax"))
chain("filter_nulls", "events", "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS v FROM events) WHERE v IS NULL OR (v IS NOT NULL AND v > 50)",
      *columns(("v", {"op": "case", "when": [{"predicate": cond("event_type", "neq", "error"), "then": col("value")}]})),
      ("filter", {"predicate": {"op": "or", "conditions": [cond("v", "is_null"), {"op": "and", "conditions": [cond("v", "is_not_null"), cond("v", "gt", 50)]}]}}), keep("event_id", "v"))

# Projection and rows

chain("select_alias", "customer", "SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer", ("select", {"columns": [{"column": "c_custkey", "as": "id"}, {"column": "C_NAME", "as": "name"}, "c_acctbal"]}))
chain("rename_swap", "nation", "SELECT n_nationkey AS n_regionkey, n_name AS nation, n_regionkey AS n_nationkey FROM nation", ("rename", {"columns": {"n_nationkey": "n_regionkey", "n_regionkey": "n_nationkey", "n_name": "nation"}}))
chain("with_column_replace", "part", "SELECT p_partkey, upper(p_name) AS P_NAME, p_brand, p_type, p_size, p_retailprice, p_retailprice * 2 AS doubled FROM part",
      *columns(("P_NAME", fn("upper", col("p_name"))), ("doubled", fn("multiply", col("p_retailprice"), 2))))
chain("sort_limit", "lineitem", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 100",
      ("sort", {"by": [desc("l_extendedprice"), col("l_orderkey"), col("l_linenumber")], "limit": 100}), keep("l_orderkey", "l_linenumber", "l_extendedprice"))
chain("sort_nulls_first", "events", "SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN value END AS v FROM events) ORDER BY v DESC NULLS FIRST, event_id LIMIT 500",
      *columns(("v", {"op": "case", "when": [{"predicate": cond("event_type", "eq", "view"), "then": col("value")}]})), keep("event_id", "v"), ("sort", {"by": [desc("v") | {"nulls": "first"}, col("event_id")], "limit": 500}))
chain("distinct_rows", "lineitem", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem", keep("l_returnflag", "l_linestatus", "l_linenumber"), ("distinct", {}))
_LAST_ORDER = "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate {0}, o_orderkey {0}) AS rn FROM orders) WHERE rn = 1"
for _keep, _direction in (("first", "ASC"), ("last", "DESC")):
    chain(f"distinct_keep_{_keep}", "orders", _LAST_ORDER.format(_direction), keep("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice"),
          ("distinct", {"columns": ["o_custkey"], "keep": _keep, "order_by": [col("o_orderdate"), col("o_orderkey")]}))

@query("union_all_positional", "SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def _union_all(spark, d):
    return relational.union([run(table(spark, d, "nation"), ("select", {"columns": [{"column": "n_nationkey", "as": "k"}, {"column": "n_name", "as": "name"}]})), run(table(spark, d, "region"), keep("r_regionkey", "r_name"))], {})


@query("union_by_name_distinct", "SELECT l_returnflag AS flag, CAST(NULL AS VARCHAR) AS status FROM lineitem UNION SELECT NULL, o_orderstatus FROM orders")
def _union_by_name(spark, d):
    a = run(table(spark, d, "lineitem"), ("select", {"columns": [{"column": "l_returnflag", "as": "flag"}]}))
    b = run(table(spark, d, "orders"), ("select", {"columns": [{"column": "o_orderstatus", "as": "status"}]}))
    return relational.union([a, b], {"by_name": True, "distinct": True})


@query("union_widens_types", "SELECT CAST(p_size AS VARCHAR) AS v FROM part UNION ALL SELECT p_brand FROM part")
def _union_types(spark, d):
    p = table(spark, d, "part")
    return relational.union([run(p, ("select", {"columns": [{"column": "p_size", "as": "v"}]})), run(p, keep("p_brand"))], {})


# Aggregation

chain("pricing_summary", "lineitem", """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, avg(l_quantity) AS avg_qty, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus""",
      ("filter", {"predicate": cond("l_shipdate", "lte", "1998-09-02")}), *columns(("net", fn("multiply", col("l_extendedprice"), fn("subtract", 1, col("l_discount"))))),
      ("group_by", {"group_by": ["l_returnflag", "l_linestatus"], "aggregations": [{"column": "l_quantity", "function": "sum", "alias": "sum_qty"}, {"column": "net", "function": "sum", "alias": "revenue"}, {"column": "l_quantity", "function": "avg", "alias": "avg_qty"}, {"column": "*", "function": "count", "alias": "n"}]}),
      *columns(("revenue", fn("round", col("revenue"), 2))), ("sort", {"by": [col("l_returnflag"), col("l_linestatus")]}))


def _agg(function: str, column: str, alias: str | None = None, **more: Any) -> dict[str, Any]:
    return {"column": column, "function": function, "alias": alias or function, **more}


chain("group_counts", "orders", "SELECT o_orderpriority, count(o_custkey) AS c, count(DISTINCT o_custkey) AS d, min(o_totalprice) AS lo, max(o_orderdate) AS hi FROM orders GROUP BY o_orderpriority",
      ("group_by", {"group_by": ["o_orderpriority"], "aggregations": [_agg("count", "o_custkey", "c"), _agg("count_distinct", "o_custkey", "d"), _agg("min", "o_totalprice", "lo"), _agg("max", "o_orderdate", "hi")]}))
_SPREAD = ["stddev", "stddev_samp", "stddev_pop", "var", "var_samp", "var_pop"]
chain("group_spread", "lineitem", "SELECT l_returnflag, " + ", ".join(f"round({'variance' if f == 'var' else f}(l_quantity), 6) AS {f}" for f in _SPREAD) + " FROM lineitem GROUP BY l_returnflag",
      ("group_by", {"group_by": ["l_returnflag"], "aggregations": [_agg(f, "l_quantity") for f in _SPREAD]}), *columns(*[(f, fn("round", col(f), 6)) for f in _SPREAD]))
chain("group_quantiles", "orders", "SELECT o_orderstatus, median(o_totalprice) AS med, quantile_cont(o_totalprice, 0.9) AS q90 FROM orders GROUP BY o_orderstatus",
      ("group_by", {"group_by": ["o_orderstatus"], "aggregations": [_agg("median", "o_totalprice", "med"), _agg("quantile", "o_totalprice", "q90", q=0.9)]}))
chain("group_pairs", "lineitem", "SELECT l_linestatus, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_samp(l_quantity, l_extendedprice), 3) AS cv, arg_max(l_orderkey, l_extendedprice * 1000000 + l_orderkey) AS top, arg_min(l_orderkey, l_extendedprice * 1000000 + l_orderkey) AS low FROM lineitem GROUP BY l_linestatus",
      *columns(("by", fn("add", fn("multiply", col("l_extendedprice"), 1000000), col("l_orderkey")))),
      ("group_by", {"group_by": ["l_linestatus"], "aggregations": [_agg("corr", "l_quantity", "r", column2="l_extendedprice"), _agg("covar", "l_quantity", "cv", column2="l_extendedprice"), _agg("arg_max", "l_orderkey", "top", column2="by"), _agg("arg_min", "l_orderkey", "low", column2="by")]}),
      *columns(("r", fn("round", col("r"), 6)), ("cv", fn("round", col("cv"), 3))))
chain("group_bools_product", "nation", "SELECT n_regionkey, bool_and(n_nationkey > 3) AS a, bool_or(n_nationkey > 20) AS o, product(n_nationkey + 1) AS p FROM nation GROUP BY n_regionkey",
      *columns(("a", {"op": "case", "when": [{"predicate": cond("n_nationkey", "gt", 3), "then": lit(True)}], "else": lit(False)}), ("o", {"op": "case", "when": [{"predicate": cond("n_nationkey", "gt", 20), "then": lit(True)}], "else": lit(False)}), ("k", fn("add", col("n_nationkey"), 1))),
      ("group_by", {"group_by": ["n_regionkey"], "aggregations": [_agg("bool_and", "a", "a"), _agg("bool_or", "o", "o"), _agg("product", "k", "p")]}))
chain("group_list", "nation", "SELECT n_regionkey, unnest(list(CASE WHEN n_nationkey % 4 > 0 THEN n_name END)) AS names FROM nation GROUP BY n_regionkey",
      *columns(("k", fn("modulo", col("n_nationkey"), 4)), ("name", {"op": "case", "when": [{"predicate": cond("k", "gt", 0), "then": col("n_name")}]})),
      ("group_by", {"group_by": ["n_regionkey"], "aggregations": [_agg("list", "name", "names")]}), ("unnest", {"column": "names"}))
chain("group_mode", "orders", "SELECT o_orderstatus, mode(CASE WHEN o_orderkey % 3 > 0 THEN 'often' ELSE o_orderpriority END) AS m FROM orders GROUP BY o_orderstatus",
      *columns(("k", fn("modulo", col("o_orderkey"), 3)), ("v", {"op": "case", "when": [{"predicate": cond("k", "gt", 0), "then": lit("often")}], "else": col("o_orderpriority")})),
      ("group_by", {"group_by": ["o_orderstatus"], "aggregations": [_agg("mode", "v", "m")]}))
chain("group_having", "orders", "SELECT o_custkey, count(*) AS n, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND o_custkey > 100",
      ("group_by", {"group_by": ["o_custkey"], "aggregations": [_agg("count", "*", "n"), _agg("sum", "o_totalprice", "total")], "having": {"op": "and", "conditions": [cond("n", "gte", 12), cond("o_custkey", "gt", 100)]}}), *columns(("total", fn("round", col("total"), 2))))
ORACLES["group_having"] = "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) >= 12 AND o_custkey > 100"
chain("group_total", "lineitem", "SELECT CAST(sum(l_linenumber) AS BIGINT) AS s, count(*) AS n FROM lineitem", ("group_by", {"group_by": [], "aggregations": [_agg("sum", "l_linenumber", "s"), _agg("count", "*", "n")]}))
chain("group_first_last", "orders", "SELECT o_orderkey, first(o_orderpriority) AS f, last(o_totalprice) AS l FROM orders GROUP BY o_orderkey", ("group_by", {"group_by": ["o_orderkey"], "aggregations": [_agg("first", "o_orderpriority", "f"), _agg("last", "o_totalprice", "l")]}))
chain("value_counts", "events", "SELECT event_type, count(*) AS count, count(*) / sum(count(*)) OVER () AS proportion FROM events GROUP BY event_type", ("value_counts", {"column": "event_type"}))
chain("value_counts_limit", "customer", "SELECT c_nationkey, count(*) AS count, count(*) / sum(count(*)) OVER () AS proportion FROM customer GROUP BY c_nationkey ORDER BY count DESC, c_nationkey LIMIT 5", ("value_counts", {"column": "c_nationkey", "limit": 5}))

# Windows

_OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"
_BY_CUSTOMER = {"partition_by": ["o_custkey"], "order_by": [col("o_orderdate"), col("o_orderkey")]}
_KEPT = keep("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
chain("window_ranks", "orders", f"SELECT o_orderkey, row_number() {_OVER} AS rn, rank() {_OVER} AS rk, dense_rank() {_OVER} AS dr, percent_rank() {_OVER} AS pr, ntile(3) {_OVER} AS nt FROM orders", _KEPT,
      ("window", {"functions": [{"function": "row_number", "alias": "rn"}, {"function": "rank", "alias": "rk"}, {"function": "dense_rank", "alias": "dr"}, {"function": "percent_rank", "alias": "pr"}, {"function": "ntile", "alias": "nt", "args": [3]}], **_BY_CUSTOMER}), keep("o_orderkey", "rn", "rk", "dr", "pr", "nt"))
chain("window_offsets", "orders", f"SELECT o_orderkey, lag(o_totalprice) {_OVER} AS a, lead(o_totalprice, 2) {_OVER} AS b, first_value(o_orderkey) {_OVER} AS f, last_value(o_orderkey) {_OVER} AS l FROM orders", _KEPT,
      ("window", {"functions": [{"function": "lag", "column": "o_totalprice", "alias": "a"}, {"function": "lead", "column": "o_totalprice", "alias": "b", "args": [2]}, {"function": "first_value", "column": "o_orderkey", "alias": "f"}, {"function": "last_value", "column": "o_orderkey", "alias": "l"}], **_BY_CUSTOMER}), keep("o_orderkey", "a", "b", "f", "l"))
_FRAME = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
chain("window_rolling", "orders", f"SELECT o_orderkey, round(sum(o_totalprice) {_FRAME}, 2) AS s, round(avg(o_totalprice) {_FRAME}, 4) AS m, min(o_totalprice) {_FRAME} AS lo, max(o_totalprice) {_FRAME} AS hi, count(o_orderkey) {_FRAME} AS n FROM orders", _KEPT,
      ("window", {"functions": [{"function": f, "column": "o_orderkey" if f == "count" else "o_totalprice", "alias": a} for f, a in (("sum", "s"), ("avg", "m"), ("min", "lo"), ("max", "hi"), ("count", "n"))], "frame": {"start": {"preceding": 2}, "end": "current_row"}, **_BY_CUSTOMER}),
      *columns(("s", fn("round", col("s"), 2)), ("m", fn("round", col("m"), 4))), keep("o_orderkey", "s", "m", "lo", "hi", "n"))
chain("window_total", "customer", "SELECT c_custkey, max(c_acctbal) OVER (PARTITION BY c_nationkey) AS top FROM customer", ("window", {"functions": [{"function": "max", "column": "c_acctbal", "alias": "top"}], "partition_by": ["c_nationkey"]}), keep("c_custkey", "top"))

_AHEAD = "OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN {} AND {})"
_FRAMES = (("1 FOLLOWING", "3 FOLLOWING", {"following": 1}, {"following": 3}), ("UNBOUNDED PRECEDING", "UNBOUNDED FOLLOWING", "unbounded_preceding", "unbounded_following"), ("2 PRECEDING", "1 FOLLOWING", {"preceding": 2}, {"following": 1}), ("CURRENT ROW", "UNBOUNDED FOLLOWING", "current_row", "unbounded_following"), ("UNBOUNDED PRECEDING", "CURRENT ROW", "unbounded_preceding", "current_row"))
chain("window_frames", "orders", "SELECT o_orderkey, " + ", ".join(f"count(o_orderkey) {_AHEAD.format(a, b)} AS n{k}, max(o_totalprice) {_AHEAD.format(a, b)} AS x{k}, first_value(o_orderkey) {_AHEAD.format(a, b)} AS f{k}, last_value(o_orderkey) {_AHEAD.format(a, b)} AS l{k}" for k, (a, b, _, _) in enumerate(_FRAMES)) + " FROM orders",
      *[("window", {"functions": [{"function": "count", "column": "o_orderkey", "alias": f"n{k}"}, {"function": "max", "column": "o_totalprice", "alias": f"x{k}"}, {"function": "first_value", "column": "o_orderkey", "alias": f"f{k}"}, {"function": "last_value", "column": "o_orderkey", "alias": f"l{k}"}], "frame": {"start": a, "end": b}, **_BY_CUSTOMER}) for k, (_, _, a, b) in enumerate(_FRAMES)],
      keep("o_orderkey", *[f"{c}{k}" for k in range(len(_FRAMES)) for c in "nxfl"]))
for _nulls in ("first", "last"):
    chain(f"window_nulls_{_nulls}", "events", f"SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY v DESC NULLS {_nulls.upper()}, event_id) AS rn FROM (SELECT *, CASE WHEN user_id % 2 = 0 THEN value END AS v FROM events)",
          *columns(("k", fn("modulo", col("user_id"), 2)), ("v", {"op": "case", "when": [{"predicate": cond("k", "eq", 0), "then": col("value")}]})),
          ("window", {"functions": [{"function": "row_number", "alias": "rn"}], "partition_by": ["event_type"], "order_by": [desc("v") | {"nulls": _nulls}, col("event_id")]}), keep("event_id", "rn"))
chain("window_unordered", "customer", "SELECT c_custkey, rank() OVER (PARTITION BY c_nationkey) AS rk, dense_rank() OVER (PARTITION BY c_nationkey) AS dr, percent_rank() OVER (PARTITION BY c_nationkey) AS pr, count(c_custkey) OVER (PARTITION BY c_nationkey) AS n FROM customer",
      ("window", {"functions": [{"function": "rank", "alias": "rk"}, {"function": "dense_rank", "alias": "dr"}, {"function": "percent_rank", "alias": "pr"}, {"function": "count", "column": "c_custkey", "alias": "n"}], "partition_by": ["c_nationkey"]}), keep("c_custkey", "rk", "dr", "pr", "n"))
chain("window_unordered_numbers", "customer", "SELECT c_nationkey, row_number() OVER (PARTITION BY c_nationkey) AS rn FROM customer",
      ("window", {"functions": [{"function": "row_number", "alias": "rn"}], "partition_by": ["c_nationkey"]}), keep("c_nationkey", "rn"))

# Joins


def _join(name: str, left: str, right: str, sql: str, params: Mapping[str, Any], after: tuple = (), l_steps: tuple = (), r_steps: tuple = ()) -> None:
    QUERIES[name] = lambda spark, d: run(joins.join(run(table(spark, d, left), *l_steps), run(table(spark, d, right), *r_steps), params), *after)
    ORACLES[name] = sql


_join("join_inner", "orders", "customer", "SELECT o_orderkey, o_custkey, c_name, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey", {"left_on": ["o_custkey"], "right_on": ["c_custkey"]}, (keep("o_orderkey", "o_custkey", "c_name", "c_nationkey"),))
_join("join_left_filtered", "customer", "orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey", {"how": "left", "left_on": ["c_custkey"], "right_on": ["o_custkey"]}, (keep("c_custkey", "o_orderkey"),), (), (("filter", {"predicate": cond("o_totalprice", "gt", 400000)}),))
for _how in ("right", "full"):
    _join(f"join_{_how}_coalesced_key", "nation", "region", f"SELECT coalesce(k, rk) AS k, n_name, r_name FROM (SELECT n_nationkey AS k, n_name FROM nation WHERE n_nationkey > 2) {_how.upper()} JOIN (SELECT r_regionkey AS rk, r_name FROM region) ON k = rk",
          {"how": _how, "left_on": ["k"], "right_on": ["r_regionkey"]}, (), (("filter", {"predicate": cond("n_nationkey", "gt", 2)}), ("select", {"columns": [{"column": "n_nationkey", "as": "k"}, "n_name"]})))
for _how, _sql in (("semi", "IN"), ("anti", "NOT IN")):
    _join(f"join_{_how}", "customer", "orders", f"SELECT c_custkey, c_name FROM customer WHERE c_custkey {_sql} (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
          {"how": _how, "left_on": ["c_custkey"], "right_on": ["o_custkey"]}, (keep("c_custkey", "c_name"),), (), (("filter", {"predicate": cond("o_totalprice", "gt", 300000)}),))
_join("join_cross_suffix", "region", "region", "SELECT a.r_regionkey, a.r_name, b.r_regionkey AS r_regionkey_right, b.r_name AS r_name_right FROM region a, region b", {"how": "cross"})
_join("join_on_suffix", "nation", "nation", "SELECT a.n_nationkey, a.n_name, a.n_regionkey, b.n_name AS n_name_b, b.n_regionkey AS n_regionkey_b FROM nation a JOIN nation b ON a.n_nationkey = b.n_nationkey", {"on": ["n_nationkey"], "suffix": "_b"})
_PURCHASES, _VIEWS = (("filter", {"predicate": cond("event_type", "eq", "purchase")}), keep("event_id", "user_id", "ts")), (("filter", {"predicate": cond("event_type", "eq", "view")}), ("select", {"columns": [{"column": "user_id", "as": "user_id"}, {"column": "ts", "as": "vts"}, {"column": "event_id", "as": "view_id"}]}))
_join("join_asof_latest", "events", "events", "SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
      {"how": "asof", "left_on": ["user_id", "ts"], "right_on": ["user_id", "vts"]}, (), _PURCHASES, _VIEWS)
_join("join_asof_next", "events", "events", "SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts <= v.ts",
      {"how": "asof", "left_on": ["user_id", "ts"], "right_on": ["user_id", "vts"], "asof_op": "<="}, (), _PURCHASES, _VIEWS)


for _op, _name in ((">=", "latest"), ("<=", "next")):
    _join(f"join_asof_{_name}_of_all", "events", "events", f"SELECT p.event_id, p.user_id, p.ts, v.event_id AS view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.ts {_op} v.ts",
          {"how": "asof", "left_on": ["ts"], "right_on": ["vts"], "asof_op": _op}, (), _PURCHASES, (_VIEWS[0], ("select", {"columns": [{"column": "ts", "as": "vts"}, {"column": "event_id", "as": "view_id"}]})))


@query("revenue_by_nation", "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _revenue(spark, d):
    lines = run(table(spark, d, "lineitem"), *columns(("net", fn("multiply", col("l_extendedprice"), fn("subtract", 1, col("l_discount"))))), keep("l_orderkey", "net"))
    a = joins.join(lines, run(table(spark, d, "orders"), keep("o_orderkey", "o_custkey")), {"left_on": ["l_orderkey"], "right_on": ["o_orderkey"]})
    b = joins.join(a, run(table(spark, d, "customer"), keep("c_custkey", "c_nationkey")), {"left_on": ["o_custkey"], "right_on": ["c_custkey"]})
    c = joins.join(b, run(table(spark, d, "nation"), keep("n_nationkey", "n_name")), {"left_on": ["c_nationkey"], "right_on": ["n_nationkey"]})
    return run(c, ("group_by", {"group_by": ["n_name"], "aggregations": [_agg("sum", "net", "revenue")]}), *columns(("revenue", fn("round", col("revenue"), 2))))


# Reshape

chain("pivot_count", "orders", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority",
      ("pivot", {"index": ["o_orderpriority"], "columns": "o_orderstatus", "values": "o_orderkey", "aggregation": "count"}))
_CELLS = ", ".join(f"round(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 2) AS \"{s}_total\", max(o_orderkey) FILTER (WHERE o_orderstatus = '{s}') AS \"{s}_max(o_orderkey)\"" for s in "FOP")
chain("pivot_several", "orders", f"SELECT o_orderpriority, {_CELLS} FROM orders GROUP BY o_orderpriority",
      ("pivot", {"index": ["o_orderpriority"], "columns": "o_orderstatus", "values": [{"column": "o_totalprice", "aggregation": "sum", "alias": "total"}, {"column": "o_orderkey", "aggregation": "max"}]}),
      *columns(*[(f"{s}_total", fn("round", col(f"{s}_total"), 2)) for s in "FOP"]))
chain("unpivot_nulls", "lineitem", "SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, 'l_quantity' AS name, l_quantity AS value FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_discount', nullif(l_discount, 0.0) FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_tax', nullif(l_tax, 0.0) FROM lineitem) WHERE value IS NOT NULL",
      *columns(("l_discount", fn("nullif", col("l_discount"), 0.0)), ("l_tax", fn("nullif", col("l_tax"), 0.0))), ("unpivot", {"id_columns": ["l_orderkey", "l_linenumber"], "value_columns": ["l_quantity", "l_discount", "l_tax"]}))
chain("unnest_list", "embeddings", "SELECT vec_id, label, unnest(embedding) AS embedding FROM embeddings", ("unnest", {"column": "embedding"}))



@query("struct_fields", "SELECT n_nationkey, n_name AS a, n_nationkey * 2 AS b, n_name AS name, n_nationkey * 2 AS twice FROM nation")
def _structs(spark, d):
    """A struct's fields by expression, and all of them by unnest."""
    nested = table(spark, d, "nation").select("n_nationkey", F.struct(F.col("n_name").alias("name"), (F.col("n_nationkey") * 2).alias("twice")).alias("s"))
    picked = columns(("a", {"op": "struct_field", "field": "NAME", "args": [col("s")]}), ("b", {"op": "struct_field", "field": "twice", "args": [col("s")]}))
    return run(nested, *picked, ("unnest", {"column": "s"}))


# Missing data

_GAPS = columns(("v", {"op": "case", "when": [{"predicate": cond("event_type", "neq", "error"), "then": col("value")}]}))
_GAPS_SQL = "(SELECT event_id, user_id, ts, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"
_GAP_KEYS = keep("event_id", "user_id", "ts", "v")
chain("fillna_value", "events", f"SELECT event_id, user_id, ts, coalesce(v, -1.5) AS v FROM {_GAPS_SQL}", *_GAPS, _GAP_KEYS, ("fillna", {"values": {"v": "-1.5"}}))
for _method, _pick, _rows in (("ffill", "last_value", "UNBOUNDED PRECEDING AND CURRENT ROW"), ("bfill", "first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING")):
    chain(f"fillna_{_method}", "events", f"SELECT event_id, user_id, ts, coalesce(v, {_pick}(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN {_rows})) AS v FROM {_GAPS_SQL}", *_GAPS, _GAP_KEYS,
          ("fillna", {"method": _method, "order_by": ["ts", "event_id"], "partition_by": ["user_id"], "columns": ["v"]}))
chain("dropna_any", "events", f"SELECT event_id, user_id, ts, v FROM {_GAPS_SQL} WHERE v IS NOT NULL", *_GAPS, _GAP_KEYS, ("dropna", {"columns": ["v", "user_id"]}))

chain("dropna_all", "events", f"SELECT event_id, v, w FROM (SELECT event_id, v, CASE WHEN user_id > 5 THEN user_id END AS w FROM {_GAPS_SQL}) WHERE v IS NOT NULL OR w IS NOT NULL", *_GAPS,
      *columns(("w", {"op": "case", "when": [{"predicate": cond("user_id", "gt", 5), "then": col("user_id")}]})), keep("event_id", "v", "w"), ("dropna", {"columns": ["v", "w"], "how": "all"}))

# Functions


def _functions(name: str, source: str, key: str, exprs: Mapping[str, tuple[Mapping[str, Any], str]], where: str = "") -> None:
    chain(name, source, f"SELECT {key}, " + ", ".join(f"{sql} AS {alias}" for alias, (_, sql) in exprs.items()) + f" FROM {source} {where}", *columns(*[(a, e) for a, (e, _) in exprs.items()]), keep(key, *exprs))


_functions("functions_numeric", "part", "p_partkey", {
    "a": (fn("add", col("p_size"), col("p_partkey"), 1), "CAST(p_size + p_partkey + 1 AS BIGINT)"), "b": (fn("subtract", col("p_retailprice"), 10.5), "p_retailprice - 10.5"),
    "c": (fn("divide", col("p_size"), 4), "p_size / 4"), "d": (fn("modulo", col("p_partkey"), 7), "CAST(p_partkey % 7 AS BIGINT)"), "e": (fn("round", fn("multiply", col("p_retailprice"), 1.5), 1), "round(p_retailprice * 1.5, 1)"),
    "f": (fn("abs", fn("subtract", col("p_size"), 25)), "CAST(abs(p_size - 25) AS INTEGER)"), "g": (fn("floor", col("p_retailprice")), "floor(p_retailprice)"), "h": (fn("ceil", col("p_retailprice")), "ceil(p_retailprice)"),
    "i": (fn("power", col("p_size"), 2), "power(p_size, 2)"), "j": (fn("round", fn("ln", col("p_size")), 9), "round(ln(p_size), 9)"), "k": (fn("clip", col("p_size"), 10, 20), "CAST(least(greatest(p_size, 10), 20) AS INTEGER)"),
})
_functions("functions_text", "part", "p_partkey", {
    "a": (fn("concat", col("p_brand"), "-", col("p_type")), "concat(p_brand, '-', p_type)"), "b": (fn("upper", col("p_name")), "upper(p_name)"), "c": (fn("lower", col("p_type")), "lower(p_type)"),
    "d": (fn("trim", fn("concat", "  ", col("p_name"), " ")), "trim(concat('  ', p_name, ' '))"), "e": (fn("substring", col("p_name"), 2, 3), "substring(p_name, 2, 3)"), "f": (fn("length", col("p_name")), "length(p_name)"),
    "g": (fn("replace", col("p_type"), "A", "_"), "replace(p_type, 'A', '_')"), "h": (fn("split_part", col("p_brand"), "#", 2), "split_part(p_brand, '#', 2)"), "i": (fn("lpad", col("p_brand"), 12, "*"), "lpad(p_brand, 12, '*')"),
    "j": (fn("rpad", col("p_brand"), 4, "*"), "rpad(p_brand, 4, '*')"), "k": (fn("substring", col("p_name"), -3), "substring(p_name, -3)"),
})
_functions("functions_regex", "pages", "page_id", {
    "a": (fn("regexp_replace", col("url"), "[a-e]+", "<\\0>"), "regexp_replace(url, '[a-e]+', '<\\0>')"), "b": (fn("regexp_replace", col("url"), "^(https?)://(\\w+)", "\\2+\\1"), "regexp_replace(url, '^(https?)://(\\w+)', '\\2+\\1')"),
    "c": (fn("regexp_extract", col("url"), "://([^/]+)/([a-z]+)", 2), "regexp_extract(url, '://([^/]+)/([a-z]+)', 2)"), "d": (fn("regexp_extract", col("url"), "[0-9]+"), "regexp_extract(url, '[0-9]+')"),
    "e": (fn("regexp_matches", col("url"), "\\.com/"), "regexp_matches(url, '\\.com/')"), "f": (fn("split_part", col("url"), "/", -1), "split_part(url, '/', -1)"),
})
_functions("functions_choice", "customer", "c_custkey", {
    "a": (fn("coalesce", fn("nullif", col("c_nationkey"), 3), -1), "CAST(coalesce(nullif(c_nationkey, 3), -1) AS INTEGER)"), "b": (fn("greatest", col("c_acctbal"), 100.0, fn("nullif", col("c_acctbal"), col("c_acctbal"))), "greatest(c_acctbal, 100.0)"),
    "c": (fn("least", col("c_acctbal"), 100.0), "least(c_acctbal, 100.0)"),
    "d": ({"op": "case", "when": [{"predicate": cond("c_acctbal", "gte", 5000), "then": lit("high")}, {"predicate": cond("c_acctbal", "gte", 0), "then": lit("mid")}], "else": lit("low")}, "CASE WHEN c_acctbal >= 5000 THEN 'high' WHEN c_acctbal >= 0 THEN 'mid' ELSE 'low' END"),
})
_functions("functions_cast", "orders", "o_orderkey", {
    "a": (fn("cast", col("o_totalprice"), to="BIGINT"), "CAST(o_totalprice AS BIGINT)"), "b": (fn("cast", col("o_orderkey"), to="VARCHAR"), "CAST(o_orderkey AS VARCHAR)"), "c": (fn("try_cast", col("o_orderpriority"), to="INTEGER"), "TRY_CAST(o_orderpriority AS INTEGER)"),
    "d": (fn("try_cast", fn("split_part", col("o_orderpriority"), "-", 1), to="INTEGER"), "TRY_CAST(split_part(o_orderpriority, '-', 1) AS INTEGER)"), "e": (fn("cast", col("o_orderdate"), to="DATE"), "CAST(o_orderdate AS DATE)"),
    "f": (fn("cast", fn("divide", col("o_orderkey"), 2), to="INTEGER"), "CAST(o_orderkey / 2 AS INTEGER)"),
})
_functions("functions_list", "lineitem", "l_orderkey", {
    "a": (fn("list_length", fn("array", col("l_quantity"), col("l_tax"))), "CAST(len([l_quantity, l_tax]) AS BIGINT)"), "b": (fn("list_contains", fn("array", col("l_quantity"), 17.0), 17.0), "list_contains([l_quantity, 17.0], 17.0)"), "c": (fn("list_contains", fn("array", col("l_linenumber"), 9), 3), "list_contains([l_linenumber, 9], 3)"),
})
_UNITS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second", "millisecond", "microsecond", "decade", "century")
_functions("functions_date_part", "events", "event_id", {u: (fn("date_part", u, col("ts")), f"CAST(date_part('{u}', ts) AS BIGINT)") for u in (*_UNITS, "millennium")})
_functions("functions_date_trunc", "events", "event_id", {f"t_{u}": (fn("date_trunc", u + "s", col("ts")), f"CAST(date_trunc('{u}', ts) AS TIMESTAMP)") for u in _UNITS if u not in ("century", "microsecond")})
_functions("functions_date_diff", "lineitem", "l_orderkey", {f"d_{u}": (fn("date_diff", u, fn("strptime", "1995-06-17 11:30:00", "%Y-%m-%d %H:%M:%S"), col("l_shipdate")), f"date_diff('{u}', TIMESTAMP '1995-06-17 11:30:00', l_shipdate)") for u in ("year", "quarter", "month", "day", "hour", "minute", "second")})
_functions("functions_date_add", "orders", "o_orderkey", {f"a_{u}": (fn("date_add", u, 5, col("o_orderdate")), f"CAST(o_orderdate + INTERVAL 5 {u} AS TIMESTAMP)") for u in ("year", "month", "day", "hour", "minute", "second")})
_FAR = ("week", "decade", "century", "millennium", "millisecond", "microsecond")
for _sign, _edge in (("before", "1899-11-30 22:10:05.25"), ("after", "2031-05-06 07:08:09.000001")):
    _functions(f"functions_date_diff_{_sign}", "events", "event_id", {f"d_{u}": (fn("date_diff", u, fn("strptime", _edge, "%Y-%m-%d %H:%M:%S.%f"), col("ts")), f"date_diff('{u}', TIMESTAMP '{_edge}', ts)") for u in (*_FAR, "year", "quarter", "month", "day", "hour", "minute", "second")})

#: Java's letters for those of strptime, to write the texts that are read.
_LETTERS = {"%Y": "yyyy", "%y": "yy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%f": "SSSSSS", "%b": "MMM", "%B": "MMMM"}
_FORMATS = sorted(FORMATS)


def _java(fmt: str) -> str:
    out = re.sub("([TZ])", r"'\1'", fmt)
    return re.sub("%[a-zA-Z]", lambda m: _LETTERS[m[0]], out)


@query("functions_strptime", "SELECT event_id, " + ", ".join(f"strptime(strftime(ts + INTERVAL (event_id % 40000) DAY, '{f}'), '{f}') AS t{k}" for k, f in enumerate(_FORMATS)) + " FROM events")
def _strptime(spark, d):
    """All formats, on texts written in them from times of more than a century."""
    ts = F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 40000).cast("int"))
    texts = table(spark, d, "events").select("event_id", *[F.date_format(ts, _java(f)).alias(f"x{k}") for k, f in enumerate(_FORMATS)])
    return run(texts, *columns(*[(f"t{k}", fn("strptime", col(f"x{k}"), f)) for k, f in enumerate(_FORMATS)]), keep("event_id", *[f"t{k}" for k in range(len(_FORMATS))]))


# Inspection


#: Table, column, type as a profile names it, and whether it has a mean and quantiles.
_PROFILED = (("lineitem", "l_quantity", "DOUBLE", True), ("lineitem", "l_linenumber", "INTEGER", True), ("lineitem", "l_returnflag", "VARCHAR", False), ("lineitem", "l_shipdate", "TIMESTAMP", False), ("events", "v", "DOUBLE", True))
_PROFILE_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", '{kind}' AS type, count(*) - count({c}) AS null_count, count(*) AS "rows", count({c}) AS count, {f"round(avg({c}), 6)" if number else "CAST(NULL AS DOUBLE)"} AS mean, {f"round(stddev_samp({c}), 6)" if number else "NULL"} AS std, CAST(min({c}) AS {"DOUBLE" if number else "VARCHAR"})::VARCHAR AS min, CAST(max({c}) AS {"DOUBLE" if number else "VARCHAR"})::VARCHAR AS max, {f"quantile_cont({c}, 0.25)" if number else "NULL"} AS q_0_25, {f"quantile_cont({c}, 0.5)" if number else "NULL"} AS q_0_5, true AS distinct_is_near FROM {t if t != "events" else "(SELECT CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"}"""
    for t, c, kind, number in _PROFILED
)


def _shown(x: Any) -> str | None:
    return None if x is None else str(float(x)) if isinstance(x, (int, float)) else str(x).replace("T", " ")


@query("profile", _PROFILE_SQL)
def _profile(spark, d):
    """Numbers, texts and times, with nulls; the distinct count is an estimate, so it is compared within 10 %."""
    frames = {"lineitem": table(spark, d, "lineitem"), "events": run(table(spark, d, "events"), *_GAPS)}
    out = []
    for t, df in frames.items():
        names = [c for of, c, _, _ in _PROFILED if of == t]
        exact = df.agg(F.count("*").alias("rows"), *[F.count_distinct(quoted(c)).alias(c) for c in names]).first()
        for r in quality.profile(df, {"columns": names, "quantiles": [0.25, 0.5]}):
            mean, std = (None if r[k] is None else round(r[k], 6) for k in ("mean", "std"))
            near = abs(r["distinct_count"] - exact[r["column"]]) <= 0.1 * exact[r["column"]]
            out.append((r["column"], r["type"], r["null_count"], exact["rows"], r["count"], mean, std, _shown(r["min"]), _shown(r["max"]), r.get("q_0.25"), r.get("q_0.5"), near))
    return spark.createDataFrame(out, "`column` string, type string, null_count long, `rows` long, count long, mean double, std double, min string, max string, q_0_25 double, q_0_5 double, distinct_is_near boolean")


@query("assert_report", """SELECT 'not_null' AS expectation, 'o_custkey' AS "column", count(*) = 0 AS passed, count(*) AS violations FROM orders WHERE o_custkey IS NULL
UNION ALL SELECT 'unique', 'o_custkey', count(*) = 0, count(*) FROM (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 1)
UNION ALL SELECT 'in_range', 'o_totalprice', count(*) = 0, count(*) FROM orders WHERE o_totalprice < 1000 OR o_totalprice > 300000
UNION ALL SELECT 'in_set', 'o_orderstatus', count(*) = 0, count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')
UNION ALL SELECT 'matches', 'o_orderpriority', count(*) = 0, count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-')
UNION ALL SELECT 'row_count', NULL, count(*) >= 10, CASE WHEN count(*) >= 10 THEN 0 ELSE 1 END FROM orders""")
def _assert(spark, d):
    rows = quality.check(table(spark, d, "orders"), {"expectations": [{"type": "not_null", "column": "o_custkey"}, {"type": "unique", "column": "o_custkey"}, {"type": "in_range", "column": "o_totalprice", "min": 1000, "max": 300000}, {"type": "in_set", "column": "o_orderstatus", "values": ["F", "O"]}, {"type": "matches", "column": "o_orderpriority", "pattern": "^[1-5]-"}, {"type": "row_count", "min": 10}]})
    return spark.createDataFrame([(r["expectation"], r["column"], r["passed"], r["violations"]) for r in rows], "expectation string, `column` string, passed boolean, violations long")
