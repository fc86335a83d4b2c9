"""Schemas as straight functions: the walk's errors, without a walk for records that are right."""

import json

import pytest

from mendframe.operators import nested as N
from mendframe.operators import walk as W

from .test_walk import TREE

SCHEMAS = [
    TREE,
    {"type": "object", "required": ["a", "b"], "properties": {"a": {"type": ["integer", "null"], "minimum": 2}, "b": {"enum": ["x", 1, None, [2]]}, "c": True}, "additionalProperties": False},
    {"properties": {"a": {"oneOf": [{"type": "integer"}, {"minimum": 3}]}, "b": {"anyOf": [{"type": "string"}, {"const": 1}]}, "c": {"not": {"type": "string"}}}, "if": {"required": ["a"]}, "then": {"maxProperties": 1}, "else": {"minProperties": 1}},
    {"type": "array", "minItems": 1, "prefixItems": [{"type": "string"}], "items": {"allOf": [{"type": "number"}, {"exclusiveMaximum": 5, "multipleOf": 0.5}]}, "uniqueItems": True, "contains": {"type": "string"}},
    {"patternProperties": {"^a": {"type": "string"}}, "additionalProperties": {"type": "integer"}, "propertyNames": {"maxLength": 1}, "dependentRequired": {"a": ["c"]}, "dependentSchemas": {"b": {"required": ["a"]}}},
    {"$ref": "#/$defs/no"}, False, True, {"properties": {"a'\"\\\n": {"type": "string"}}, "additionalProperties": False}, {"properties": {"x": {"properties": {"y": {"type": "null"}}, "additionalProperties": False}}, "additionalProperties": False},
]
VALUES = [
    {}, {"a": 1}, {"a": 2.0, "b": [2]}, {"a": True, "b": True, "c": "s", "d": 0}, {"a": None, "b": "x"}, {"b": 1, "aa": 3}, {"a'\"\\\n": 3, "z": 1}, {"x": {"y": 1, "z": 2}, "q": 1}, [], ["a", 1, 1.0, 7, 0.3], ["b", "b"], "t", 3, 4.5, True, None,
    {"v": 1, "left": {"v": "x", "right": {"w": 3}}, "right": 5},
]


@pytest.mark.parametrize("schema", SCHEMAS, ids=range(len(SCHEMAS)))
def test_straight_equals_walk(schema):
    rows = [(at, op, json.loads(arg), to) for at, op, arg, to in W.compiled(schema)]
    walk, plain = W.Walk(rows), W.Walk(rows)
    assert walk.straight
    plain.straight = None
    for v in VALUES:
        assert W.errors_of_text(walk, json.dumps(v)) == W.errors_of_text(plain, json.dumps(v)), v


def test_right_records_need_no_walk(monkeypatch):
    walk = W.Walk([(at, op, json.loads(arg), to) for at, op, arg, to in W.compiled(TREE)])
    seen = []
    monkeypatch.setattr(W.Walk, "visit", lambda *a: seen.append(a))
    tree = {"v": 1}
    for _ in range(200):
        tree = {"v": 1, "left": tree, "right": {"v": 2}}
    assert W.errors_of_text(walk, json.dumps(tree)) == [] and not seen


def test_circles_stay_with_the_walk():
    for schema in ({"$defs": {"a": {"anyOf": [{"$ref": "#/$defs/a"}, {"type": "string"}]}}, "$ref": "#/$defs/a"}, {"unevaluatedProperties": False}):
        walk = W.Walk([(at, op, json.loads(arg), to) for at, op, arg, to in W.compiled(schema)])
        assert walk.straight is None and W.errors_of_text(walk, "3") == ([] if "$ref" not in schema else W.errors_of_text(walk, "3"))


def test_text_after_a_value_is_no_json(spark):
    df = spark.createDataFrame([(1, '{"a": 1} x'), (2, '{"a": 1.50, "b": 1e7}')], "i int, t string")
    out = {r.i: r for r in N.validated_json(df, "t", {"additionalProperties": False}).collect()}
    assert [e.expected for e in out[1].errors] == ["JSON value"] and out[2].errors[0].value == '{"a":1.5,"b":1.0E7}'
