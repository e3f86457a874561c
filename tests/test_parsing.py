import pytest

from lumenframe import errors, typenames
from lumenframe.envelope import Response, Stats
from lumenframe.errors import FrameError
from lumenframe.params import Param, check
from lumenframe.plans import expressions, predicates


def code(call, *args):
    with pytest.raises(FrameError) as e:
        call(*args)
    return e.value.code


@pytest.mark.parametrize("op", ["eq", "neq", "gt", "gte", "lt", "lte", "like", "ilike", "starts_with", "ends_with", "contains", "matches"])
def test_value_conditions(op):
    assert predicates.parse({"column": "a", "op": op, "value": None}) == predicates.Condition("a", op)
    assert predicates.parse({"column": "a", "op": op, "value_column": "b"}).value_column == "b"
    assert code(predicates.parse, {"column": "a", "op": op}) == errors.INVALID_PREDICATE
    assert code(predicates.parse, {"column": "a", "op": op, "value": 1, "value_column": "b"}) == errors.INVALID_PREDICATE


def test_nested_predicates():
    tree = {"op": "and", "conditions": [{"column": "s", "op": "eq", "value": "x"}, {"op": "or", "conditions": [{"column": "r", "op": "in", "values": ["E"]}, {"op": "not", "condition": {"column": "a", "op": "lt", "value": 0}}]}]}
    node = predicates.parse(tree)
    assert node.op == "and" and node.conditions[1].op == "or" and isinstance(node.conditions[1].conditions[1], predicates.Not)


@pytest.mark.parametrize(
    "node",
    [{}, {"op": "xor"}, {"op": "and"}, {"op": "and", "conditions": []}, {"op": "and", "conditions": "x"}, {"op": "or", "conditions": [1]}, {"op": "not"}, {"column": "", "op": "eq", "value": 1}, {"column": "a"}, {"column": "a", "op": "in"}, {"column": "a", "op": "in", "values": []}, {"column": "a", "op": "between", "low": 1}, {"column": "a", "op": "near", "value": 1}, "x"],
)
def test_malformed_predicates(node):
    assert code(predicates.parse, node) == errors.INVALID_PREDICATE


def test_expression_nodes():
    assert expressions.parse({"column": "a"}) == expressions.ColumnRef("a")
    assert expressions.parse({"literal": None}) == expressions.Literal(None)
    assert expressions.parse({"op": "cast", "to": "DATE", "args": [{"column": "a"}]}) == expressions.Cast("DATE", expressions.ColumnRef("a"))
    assert expressions.parse({"op": "try_cast", "to": "DATE", "args": [{"column": "a"}]}).safe
    assert expressions.parse({"op": "struct_field", "field": "f", "args": [{"column": "a"}]}).field == "f"
    case = expressions.parse({"op": "case", "when": [{"predicate": {"column": "a", "op": "is_null"}, "then": {"literal": 1}}], "else": {"literal": 2}})
    assert len(case.whens) == 1 and case.otherwise == expressions.Literal(2)


@pytest.mark.parametrize(
    "node",
    [{}, {"column": " "}, {"op": "sinh", "args": [{"literal": 1}]}, {"op": "add", "args": [{"literal": 1}]}, {"op": "add"}, {"op": "abs", "args": [{"literal": 1}, {"literal": 1}]}, {"op": "cast", "args": [{"literal": 1}]}, {"op": "cast", "to": "INT", "args": []}, {"op": "case"}, {"op": "case", "when": []}, {"op": "case", "when": [{"then": {"literal": 1}}]}, {"op": "struct_field", "args": [{"column": "a"}]}, 3],
)
def test_malformed_expressions(node):
    assert code(expressions.parse, node) == errors.INVALID_PREDICATE


@pytest.mark.parametrize(
    "param,value,expected",
    [
        (Param("p", required=True), None, errors.INVALID_TYPE), (Param("p", allowed=("a",)), "A", errors.INVALID_ARGUMENT), (Param("p", "integer"), True, errors.INVALID_TYPE), (Param("p", "integer"), "x", errors.INVALID_TYPE),
        (Param("p", "number"), "x", errors.INVALID_TYPE), (Param("p", "boolean"), 2, errors.INVALID_TYPE), (Param("p", "array"), "x", errors.INVALID_TYPE), (Param("p", "array"), {}, errors.INVALID_TYPE), (Param("p", "object"), [], errors.INVALID_TYPE),
        (Param("p", "integer", minimum=1), 0, errors.INVALID_TYPE), (Param("p", "integer", maximum=5), 6, errors.INVALID_TYPE), (Param("p", pattern="^a$"), "b", errors.INVALID_TYPE),
    ],
)
def test_parameter_checks(param, value, expected):
    assert code(check, {"p": value}, [param]) == expected


def test_accepted_parameters():
    check({"a": "12", "b": "true", "c": (1,), "d": {}, "e": 1.5, "unknown": object()}, [Param("a", "integer"), Param("b", "boolean"), Param("c", "array"), Param("d", "object"), Param("e", "number"), Param("f")])


def test_type_names_round_trip():
    for name in ("BOOLEAN", "TINYINT", "SMALLINT", "INTEGER", "BIGINT", "FLOAT", "DOUBLE", "VARCHAR", "BLOB", "DATE", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE", "DECIMAL(12,2)"):
        assert typenames.render(typenames.parse(name)) == name
    assert typenames.render(typenames.parse("decimal")) == "DECIMAL(18,3)"
    assert code(typenames.parse, "MAP") == errors.INVALID_TYPE


def test_envelopes():
    ok = Response.ok("d", [], 3, [{"a": 1}], Stats(1, 2, 3)).to_envelope()
    assert ok["preview_truncated"] and ok["success"] and "plan" not in ok["stats"]
    assert Response.error("X", "m").to_envelope() == {"success": False, "error_code": "X", "message": "m"}
