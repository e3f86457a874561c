"""Where Spark and the contract's SQL differ: one case for each difference."""

import math

import pytest

from lumenframe import errors

from .test_operations import code, make, ok

NAN, INF = float("nan"), float("inf")


def fn(op, *args, **more):
    return {"op": op, "args": [a if isinstance(a, dict) else {"literal": a} for a in args], **more}


def col(name):
    return {"column": name}


@pytest.fixture
def one(engine, spark):
    make(engine, spark, "t", [(1, "hello", None, [1, None], 2.5, "2024-01-31 10:20:30.123456", "2024-02-01", "-0.5")], "i int, s string, n string, xs array<int>, d double, ts string, da string, neg string")
    ok(engine, "with_column", dataset_id="t", name="ts", expression=fn("cast", col("ts"), to="TIMESTAMP"))
    ok(engine, "with_column", dataset_id="t", name="da", expression=fn("cast", col("da"), to="DATE"))
    return engine


CASES = [
    (fn("divide", 1, 0), INF), (fn("divide", -1, 0), -INF), (fn("divide", 0, 0), NAN), (fn("divide", 7, 2), 3.5), (fn("ln", 0), -INF), (fn("ln", -1), NAN), (fn("floor", 2.7), 2.0), (fn("ceil", col("i")), 1.0),
    (fn("round", -2.5), -3.0), (fn("round", 2.345, 2), 2.35), (fn("modulo", -7, 3), -1), (fn("concat", col("n"), "x", 5), "x5"), (fn("concat", col("n"), col("n")), ""),
    (fn("substring", col("s"), 0, 3), "he"), (fn("substring", col("s"), -3, 2), "ll"), (fn("substring", col("s"), 3, -1), "e"), (fn("substring", col("s"), 4), "lo"), (fn("substring", col("s"), 9, 2), ""), (fn("substring", col("s"), -9, 2), "he"),
    (fn("split_part", "a-b-c", "-", -1), "c"), (fn("split_part", "a-b", "-", 0), ""), (fn("split_part", "a-b", "-", 9), ""), (fn("split_part", "abc", "", 2), "b"), (fn("lpad", "ab", 4), "  ab"), (fn("rpad", "abc", 2, "x"), "ab"),
    (fn("regexp_replace", "aXbXc", "X", "$1\\0"), "a$1XbXc"), (fn("regexp_replace", "abc", "", "Z"), "Zabc"), (fn("regexp_replace", "aa\nbb", "b(b)", "<\\1\\\\>"), "aa\n<b\\>"), (fn("regexp_replace", "abab", "^(a)(b)", "\\2\\1"), "baab"), (fn("regexp_replace", "xay", "(?i)A", "_"), "x_y"),
    (fn("regexp_extract", "ab12", "[0-9]+"), "12"), (fn("regexp_extract", "ab", "[0-9]+"), ""), (fn("regexp_matches", "abc", "b"), True), (fn("length", col("xs")), 2), (fn("length", "é😀"), 2),
    (fn("coalesce", col("n"), 5), "5"), (fn("greatest", 1, {"literal": None}, 3), 3), (fn("clip", fn("nullif", 1, 1), 2, 3), 2), (fn("list_contains", col("xs"), 9), False), (fn("list_contains", col("xs"), 1), True), (fn("list_contains", col("xs"), {"literal": None}), None), (fn("list_length", fn("array", 1, 2.5)), 2),
    (fn("cast", 2.5, to="INTEGER"), 2), (fn("cast", 3.5, to="BIGINT"), 4), (fn("cast", "3.7", to="INT"), 4), (fn("cast", fn("cast", "2.5", to="DECIMAL(5,1)"), to="INTEGER"), 3), (fn("try_cast", "x", to="INTEGER"), None), (fn("try_cast", "2020-13-01", to="DATE"), None),
    (fn("date_part", "second", col("ts")), 30), (fn("date_part", "milliseconds", col("ts")), 30123), (fn("date_part", "microsecond", col("ts")), 30123456), (fn("date_part", "century", col("ts")), 21), (fn("date_part", "millennium", col("da")), 3), (fn("date_part", "decade", col("ts")), 202), (fn("date_part", "week", col("ts")), 5),
    (fn("date_trunc", "months", col("da")), "2024-02-01T00:00:00"), (fn("date_trunc", "decade", col("ts")), "2020-01-01T00:00:00"), (fn("date_trunc", "centuries", col("ts")), "2000-01-01T00:00:00"), (fn("date_trunc", "hour", col("ts")), "2024-01-31T10:00:00"),
    (fn("date_diff", "month", col("ts"), col("da")), 1), (fn("date_diff", "day", col("ts"), col("da")), 1), (fn("date_diff", "year", col("da"), col("ts")), 0), (fn("date_diff", "hour", col("ts"), col("da")), 14), (fn("date_diff", "week", col("da"), fn("date_add", "day", -6, col("da"))), 0), (fn("date_diff", "weeks", col("da"), fn("date_add", "day", -7, col("da"))), -1),
    (fn("date_diff", "microseconds", col("ts"), fn("date_add", "second", 1, col("ts"))), 1_000_000), (fn("date_add", "month", 1, col("ts")), "2024-02-29T10:20:30.123456"), (fn("date_add", "days", 1.5, col("da")), "2024-02-02T12:00:00"), (fn("subtract", col("da"), fn("cast", "2024-01-01", to="DATE")), 31),
    (fn("strptime", "07-Jan-68", "%d-%b-%y"), "2068-01-07T00:00:00"), (fn("strptime", "07-Jan-69", "%d-%b-%y"), "1969-01-07T00:00:00"), (fn("strptime", "1:02:03.5", "%H:%M:%S.%f"), "1900-01-01T01:02:03.500000"), (fn("strptime", "20240203040506", "%Y%m%d%H%M%S"), "2024-02-03T04:05:06"), (fn("strptime", "3/4/2021", "%m/%d/%Y"), "2021-03-04T00:00:00"), (fn("strptime", "March 4, 2021", "%B %d, %Y"), "2021-03-04T00:00:00"),
    ({"op": "case", "when": [{"predicate": {"column": "i", "op": "gt", "value": 5}, "then": {"literal": "big"}}]}, None), ({"literal": 3_000_000_000}, 3_000_000_000),
]


def test_values(one):
    """All cases as columns of one row."""
    last = "t"
    for k, (e, _) in enumerate(CASES):
        r = one.execute("dataframe_with_column", {"dataset_id": last, "name": "v", "expression": e, "into": "v"})
        assert r.success, (k, e, r.message)
        got, want = r.preview_rows[0]["v"], CASES[k][1]
        same = (isinstance(got, float) and isinstance(want, float) and (math.isnan(got) and math.isnan(want) or got == want)) or (got == want and isinstance(got, bool) == isinstance(want, bool))
        assert same, (e, got, want)


@pytest.mark.parametrize(
    "e,expected",
    [
        (fn("date_trunc", "fortnight", col("ts")), errors.INVALID_PREDICATE), (fn("date_trunc", col("s"), col("ts")), errors.INVALID_PREDICATE), (fn("date_part", "nanosecond", col("ts")), errors.BACKEND_ERROR), (fn("date_add", "week", 1, col("ts")), errors.INVALID_PREDICATE), (fn("strptime", "x", "%c"), errors.INVALID_PREDICATE),
        (fn("cast", 1, to="INT; DROP"), errors.INVALID_TYPE), (fn("cast", 1, to="NOPE"), errors.INVALID_TYPE), (fn("cast", "x", to="INTEGER"), errors.BACKEND_ERROR), (fn("add", col("nope"), 1), errors.COLUMN_NOT_FOUND), (fn("modulo", 1, 0), errors.BACKEND_ERROR), (fn("strptime", "soon", "%Y-%m-%d"), errors.BACKEND_ERROR),
    ],
)
def test_refusals(one, e, expected):
    assert code(one, "with_column", dataset_id="t", name="v", expression=e, into="v") == expected


def test_like_has_no_escape_and_text_ops_need_text(engine, spark):
    make(engine, spark, "t", [("a\\b", 1), ("axb", 2), (None, 3), ("a%b", 4)], "s string, i int")

    def ids(**p):
        return sorted(r["i"] for r in ok(engine, "filter", dataset_id="t", predicate=p, into="f").preview_rows)

    assert ids(column="s", op="like", value="a\\_") == [1] and ids(column="s", op="like", value="a\\b") == [1] and ids(column="s", op="like", value="a_b") == [1, 2, 4]
    assert ids(column="s", op="eq", value=None) == [] and ids(op="not", condition={"column": "s", "op": "eq", "value": "axb"}) == [1, 4]
    assert ids(column="s", op="contains", value="%") == [4] and ids(column="S", op="ilike", value="A%B") == [1, 2, 4]
    assert code(engine, "filter", dataset_id="t", predicate={"column": "i", "op": "contains", "value": "1"}, into="f") == errors.BACKEND_ERROR


def test_nulls_last_both_ways_and_nan_highest(engine, spark):
    make(engine, spark, "t", [(1, None), (2, NAN), (3, 1.0)], "i int, v double")
    for direction, order in (("asc", [3, 2, 1]), ("desc", [2, 3, 1])):
        assert [r["i"] for r in ok(engine, "sort", dataset_id="t", by=[{"column": "v", "direction": direction}], into="s").preview_rows] == order
    assert [r["i"] for r in ok(engine, "sort", dataset_id="t", by=[{"column": "v", "nulls": "first"}], into="s").preview_rows][0] == 1


def test_avg_of_decimals_is_floating(engine, spark):
    from decimal import Decimal

    make(engine, spark, "t", [(Decimal("1.10"),), (Decimal("2.20"),)], "d decimal(10,2)")
    r = ok(engine, "group_by", dataset_id="t", group_by=[], aggregations=[{"column": "d", "function": f} for f in ("avg", "median", "sum")], into="g")
    assert [c.type for c in r.schema] == ["DOUBLE", "DECIMAL(10,2)", "DECIMAL(20,2)"]
