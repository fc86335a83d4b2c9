import json

import pytest
from pyspark.sql import functions as F

from mendframe.operators import nested as N

DEFS = {"$defs": {"A": {"type": "string"}}}
#: schema, value, (path, expected) of each error
CASES = [
    ({"type": "integer"}, "x", [("$input", "integer")]),
    ({"type": "integer"}, 1.0, []),
    ({"type": ["string", "null"]}, 1, [("$input", "(null | string)")]),
    ({"type": ["string", "null"]}, None, []),
    ({"properties": {"a": {"type": "number", "minimum": 0}}, "required": ["a", "b"]}, {"a": -1}, [("$input.a", "integer & Minimum<0>"), ("$input.b", "required property")]),
    ({"properties": {"a": {"type": "string"}}}, {"a": None}, [("$input.a", "string")]),
    ({"type": "array", "items": {"type": "integer", "maximum": 2.5}}, [1, 3, "x"], [("$input[1]", "number & Maximum<2.5>"), ("$input[2]", "integer")]),
    ({"properties": {"a": {"items": {"properties": {"b": {"enum": ["x", 1]}}}}}}, {"a": [{"b": "x"}, {"b": 1}, {"b": "1"}]}, [("$input.a[2].b", 'one of ["x",1]')]),
    ({"properties": {"a": True}, "additionalProperties": False}, {"a": 1, "b": 2, "c": 3}, [("$input", "no extraneous properties")]),
    ({"properties": {"a": True}, "additionalProperties": {"type": "string"}}, {"a": 1, "b": 2}, [("$input.b", "string")]),
    ({"patternProperties": {"^n_": {"type": "number"}}, "additionalProperties": False}, {"n_a": "x", "n_b": 1}, [("$input.n_a", "number")]),
    ({"minItems": 2, "uniqueItems": True}, [1], [("$input", "array & MinItems<2>")]),
    ({"maxItems": 2, "uniqueItems": True}, [{"a": 1}, {"a": 1}, 2], [("$input", "array & MaxItems<2>"), ("$input", "array & UniqueItems")]),
    ({"minProperties": 1, "maxProperties": 1}, {"a": 1, "b": 1}, [("$input", "object & MaxProperties<1>")]),
    ({"minProperties": 1}, {}, [("$input", "object & MinProperties<1>")]),
    ({"minLength": 2, "maxLength": 3, "pattern": "^a"}, "b", [("$input", "string & MinLength<2>"), ("$input", 'string & Pattern<"^a">')]),
    ({"format": "email"}, "a@b", [("$input", 'string & Format<"email">')]),
    ({"multipleOf": 0.1}, 0.3, []),
    ({"multipleOf": 5}, 7, [("$input", "number & MultipleOf<5>")]),
    ({"exclusiveMinimum": 1, "exclusiveMaximum": 3}, 3, [("$input", "integer & ExclusiveMaximum<3>")]),
    ({"const": {"b": 1, "a": [None]}}, {"a": [None], "b": 1}, []),
    ({"const": "x"}, "y", [("$input", 'const "x"')]),
    ({"anyOf": [{"type": "string"}, {"type": "number"}]}, True, [("$input", "union type")]),
    ({"oneOf": [{"type": "string"}, {"minLength": 5}]}, "longer", [("$input", "oneOf match")]),
    ({"oneOf": [{"type": "string"}, {"type": "number"}]}, "x", []),
    ({"not": {"type": "string"}}, "x", [("$input", "value NOT matching the sub-schema")]),
    ({"allOf": [{"required": ["a"]}, {"required": ["b"]}]}, {"a": 1}, [("$input.b", "required property")]),
    ({"if": {"properties": {"status": {"const": "shipped"}}}, "then": {"required": ["tracking"]}, "else": {"required": ["reason"]}}, {"status": "shipped"}, [("$input.tracking", "required property")]),
    ({"if": {"properties": {"status": {"const": "shipped"}}}, "then": {"required": ["tracking"]}, "else": {"required": ["reason"]}}, {"status": "x"}, [("$input.reason", "required property")]),
    ({"prefixItems": [{"type": "string"}, {"type": "number"}], "items": False}, ["a", "b", 1], [("$input[1]", "number"), ("$input", "array with at most 2 items")]),
    ({"items": [{"type": "string"}], "additionalItems": {"type": "number"}}, ["a", "b"], [("$input[1]", "number")]),
    ({"contains": {"type": "number"}}, ["a"], [("$input", "array & Contains")]),
    ({"propertyNames": {"pattern": "^[a-z]+$"}}, {"A": 1}, [("$input", "valid property name at $input")]),
    ({"dependentRequired": {"a": ["b"]}}, {"a": 1}, [("$input.b", "required property")]),
    ({**DEFS, "properties": {"x": {"$ref": "#/$defs/A"}}}, {"x": 1}, [("$input.x", "string")]),
    ({"properties": {"x": {"$ref": "#/$defs/B"}}}, {"x": 1}, [("$input.x", "resolvable $ref")]),
    ({"$ref": "#/$defs/A", "$defs": {"A": {"$ref": "#/$defs/B"}, "B": {"$ref": "#/$defs/A"}}}, 1, [("$input", "non-circular $ref")]),
    ({"type": "strin"}, 1, [("$input", "valid schema")]),
    ({"properties": {"a": {"pattern": "(["}}}, {"a": "x"}, [("$input", "valid schema")]),
    (False, 1, [("$input", "never (false schema)")]),
    (True, 1, []),
    ({"type": "object"}, [], [("$input", "object")]),
    ({"required": ["a"]}, "no object", []),
    ({"properties": {"a'b": {"type": "string"}}}, {"a'b": 1}, [("$input.a'b", "string")]),
]


def test_keywords(spark):
    df = spark.createDataFrame([(json.dumps(v),) for _, v, _ in CASES], "text string").coalesce(1)
    values = df.select(F.monotonically_increasing_id().alias("i"), F.parse_json("text").alias("v"))
    for lo in range(0, len(CASES), 15):
        part = CASES[lo : lo + 15]
        rows = values.where((F.col("i") >= lo) & (F.col("i") < lo + 15)).select("i", F.coalesce(*[F.when(F.col("i") == lo + k, N.errors_of_json(s, F.col("v"))) for k, (s, _, _) in enumerate(part)]).alias("e")).collect()
        got = {r.i: sorted((e.path, e.expected) for e in r.e) for r in rows}
        for k, (schema, value, want) in enumerate(part):
            assert got[lo + k] == sorted(want), (schema, value)


def test_strict_and_texts(spark):
    schema = {"properties": {"a": {"items": {"properties": {"b": True}}}}, "required": ["a"]}
    rows = [(1, '{"a": [{"b": 1, "c": 2}], "d": 3}'), (2, "{"), (3, None), (4, "{}"), (5, '{"a": null}')]
    out = {r.i: r for r in N.validated_json(spark.createDataFrame(rows, "i int, text string"), "text", N.strict(schema)).collect()}
    assert sorted((e.path, e.description) for e in out[1].errors) == [("$input", "unexpected property 'd'"), ("$input.a[0]", "unexpected property 'c'")]
    assert [e.expected for e in out[2].errors] == ["JSON value"] == [e.expected for e in out[3].errors]
    assert [e.path for e in out[4].errors] == ["$input.a"] and out[4].errors[0].value == "null" and "`a`" in out[4].errors[0].description and out[5].valid


def test_recursive_schema(spark):
    tree = {"$ref": "#/$defs/N", "$defs": {"N": {"properties": {"v": {"type": "integer"}, "n": {"$ref": "#/$defs/N"}}}}}
    df = spark.createDataFrame([('{"v":1,"n":{"v":2,"n":{"v":"x"}}}',)], "text string")
    assert [e.path for e in N.validated_json(df, "text", tree).first().errors] == ["$input.n.n.v"]


def test_empty_table(spark):
    assert N.validated_json(spark.createDataFrame([], "text string"), "text", {"type": "object"}).count() == 0


@pytest.mark.parametrize("bad", [{"type": 3}, {"minimum": "x"}, 5])
def test_faults(bad):
    assert N.fault(bad)


def test_errors_without_values(spark):
    df = spark.createDataFrame([('{"a": 1, "b": "x"}',), ("{",), (None,), ('{"a": "y"}',)], "text string")
    schema = {"properties": {"a": {"type": "string"}, "b": {"type": "number"}}, "required": ["a"]}
    told = lambda **kw: [[(e.path, e.expected, e.value) for e in r.errors] for r in N.validated_json(df, "text", schema, **kw).collect()]
    full, bare = told(), told(values=False)
    assert [[e[:2] for e in r] for r in full] == [[e[:2] for e in r] for r in bare]
    assert full[0] != bare[0] and all(v is None for r in bare for _, _, v in r)
