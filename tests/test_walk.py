"""Schemas as rows of instructions: recursion by data, evaluated names, schemas by key."""

import json
import random

import pytest
from pyspark.sql import functions as F

from mendframe.operators import nested as N
from mendframe.operators import walk as W

TREE = {"$ref": "#/$defs/Node", "$defs": {"Node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer", "maximum": 90}, "left": {"$ref": "#/$defs/Node"}, "right": {"$ref": "#/$defs/Node"}}}}}


def found(schema, value):
    walk = W.Walk([(at, op, json.loads(arg), to) for at, op, arg, to in W.compiled(schema)])
    return [(e["path"], e["expected"]) for e in W.errors_of_text(walk, json.dumps(value))]


def test_trees_of_any_depth_and_branching(spark):
    def grow(r, depth, path):
        v = r.randrange(100)
        node, wrong = {"v": v}, [(f"{path}.v", "integer & Maximum<90>")] if v > 90 else []
        for side in ("left", "right"):
            if depth and r.random() < 0.9:
                node[side], more = grow(r, depth - 1, f"{path}.{side}")
                wrong += more
        return node, wrong

    r = random.Random(3)
    rows = [grow(r, d, "$input") for d in (0, 1, 5, 10) for _ in range(5)]
    deep, path = {"v": 99}, "$input" + ".right" * 400
    for _ in range(400):
        deep = {"v": 1, "right": deep}
    rows.append((deep, [(path + ".v", "integer & Maximum<90>")]))
    df = spark.createDataFrame([(i, json.dumps(t)) for i, (t, _) in enumerate(rows)], "i int, t string")
    got = {x.i: sorted((e.path, e.expected) for e in x.errors) for x in N.validated_json(df, "t", TREE).collect()}
    assert got == {i: sorted(w) for i, (_, w) in enumerate(rows)}


CASES = [
    # unevaluatedProperties sees what passed beside it, through allOf, anyOf, oneOf, if, references and dependent schemas.
    ({"allOf": [{"properties": {"a": True}}], "properties": {"b": True}, "unevaluatedProperties": False}, {"a": 1, "b": 2}, []),
    ({"allOf": [{"properties": {"a": True}}], "unevaluatedProperties": False}, {"a": 1, "c": 2}, [("$input", "no extraneous properties")]),
    ({"anyOf": [{"properties": {"a": {"type": "string"}}, "required": ["a"]}, {"properties": {"b": True}, "required": ["b"]}], "unevaluatedProperties": False}, {"a": 1, "b": 2}, [("$input", "no extraneous properties")]),
    ({"anyOf": [{"properties": {"a": True}}, {"properties": {"b": True}}], "unevaluatedProperties": False}, {"a": 1, "b": 2}, []),
    ({"oneOf": [{"properties": {"k": {"const": 1}, "x": True}, "required": ["k"]}, {"properties": {"k": {"const": 2}, "y": True}, "required": ["k"]}], "unevaluatedProperties": False}, {"k": 2, "y": 0}, []),
    ({"oneOf": [{"properties": {"k": {"const": 1}, "x": True}, "required": ["k"]}, {"properties": {"k": {"const": 2}, "y": True}, "required": ["k"]}], "unevaluatedProperties": False}, {"k": 2, "x": 0}, [("$input", "no extraneous properties")]),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"x": True}}, "else": {"properties": {"y": True}}, "unevaluatedProperties": False}, {"k": 1, "x": 3}, []),
    ({"if": {"properties": {"k": {"const": 1}}, "required": ["k"]}, "then": {"properties": {"x": True}}, "else": {"properties": {"y": True}}, "unevaluatedProperties": False}, {"k": 2, "y": 3}, [("$input", "no extraneous properties")]),
    ({"$ref": "#/$defs/P", "$defs": {"P": {"properties": {"a": True}}}, "unevaluatedProperties": {"type": "integer"}}, {"a": "t", "z": "t"}, [("$input.z", "integer")]),
    ({"not": {"not": {"properties": {"a": True}}}, "unevaluatedProperties": False}, {"a": 1}, [("$input", "no extraneous properties")]),
    ({"dependentSchemas": {"a": {"properties": {"b": True}}}, "properties": {"a": True}, "unevaluatedProperties": False}, {"a": 1, "b": 1}, []),
    ({"properties": {"in": {"properties": {"a": True}}}, "unevaluatedProperties": False}, {"in": {"a": 1}, "a": 1}, [("$input", "no extraneous properties")]),
    ({"prefixItems": [True], "unevaluatedItems": False}, [1, 2], [("$input", "no extraneous items")]),
    ({"prefixItems": [True], "contains": {"type": "string"}, "unevaluatedItems": False}, [1, "a"], []),
    ({"allOf": [{"prefixItems": [True, {"type": "null"}]}], "unevaluatedItems": {"type": "string"}}, [1, None, "s", 4], [("$input[3]", "string")]),
    ({"items": True, "unevaluatedItems": False}, [1, 2], []),
    # Pointers, anchors, counts, numbers and options.
    ({"properties": {"x": {"$ref": "#/properties/y"}, "y": {"type": "integer"}}}, {"x": "t", "y": 1}, [("$input.x", "integer")]),
    ({"items": {"$ref": "#n"}, "$defs": {"q": {"$anchor": "n", "type": "null"}}}, [None, 1], [("$input[1]", "null")]),
    ({"$ref": "other.json"}, 1, [("$input", "resolvable $ref")]),
    ({"contains": {"type": "integer"}, "minContains": 2, "maxContains": 3}, [1, "a"], [("$input", "array & Contains")]),
    ({"contains": {"type": "integer"}, "minContains": 0}, ["a"], []),
    ({"contains": {"type": "integer"}, "maxContains": 1}, [1, 2], [("$input", "array & Contains")]),
    ({"type": "integer"}, 12345678901234567890123, []),
    ({"multipleOf": 0}, 3, []),
    ({"multipleOf": 1e-12}, 3.5, []),
    ({"multipleOf": 0.1}, 0.35, [("$input", "number & MultipleOf<0.1>")]),
    ({"enum": [{"a": 1.0}]}, {"a": 1}, []),
    ({"enum": [1]}, True, [("$input", "one of [1]")]),
    ({"uniqueItems": True}, [{"a": 1, "b": 2}, {"b": 2, "a": 1.0}], [("$input", "array & UniqueItems")]),
    ({"uniqueItems": True}, [1, True, "1"], []),
    ({"format": "ipv6"}, "1:2:3:4:5:6:7:12345678", [("$input", 'string & Format<"ipv6">')]),
    ({"format": "regex"}, "[z-a]", [("$input", 'string & Format<"regex">')]),
    ({"properties": {"next": {"$ref": "#"}}, "additionalProperties": False}, {"next": {"next": {"n": 1}}}, [("$input.next.next", "no extraneous properties")]),
    ({"allOf": [{"$ref": "#"}], "type": "string"}, 1, [("$input", "string")]),  # a way back to the same value
]


def test_names_of_digits_are_places(spark):
    schema = {"properties": {"0": {"type": "null"}, "a": {"required": ["7"]}}, "patternProperties": {"^[1-9]": {"type": "string"}}}
    text = '{"0": 1, "12": 2, "1x": 3, "a": {}}'
    want = [("$input.1x", "string"), ("$input.a.7", "required property"), ("$input[0]", "null"), ("$input[12]", "string")]
    assert sorted(found(schema, json.loads(text))) == want
    row = N.validated_json(spark.createDataFrame([(text,)], "t string"), "t", schema).first()
    assert sorted((e.path, e.expected) for e in row.errors) == want


@pytest.mark.parametrize("case", range(len(CASES)))
def test_keywords(case):
    schema, value, wanted = CASES[case]
    assert found(schema, value) == wanted


def test_equals_the_compiled_column(spark):
    """Random schemas without recursion give the same errors by both ways."""
    r = random.Random(8)

    def schema(d):
        kind = r.choice(["type", "num", "str", "obj", "arr", "any", "one", "not", "if", "enum"])
        if d == 0 or kind == "type":
            return {"type": r.choice(["integer", "number", "string", "object", "array", "boolean", "null", ["string", "null"]])}
        if kind == "num":
            return {"minimum": r.randrange(-2, 4), "exclusiveMaximum": r.randrange(2, 9), "multipleOf": r.choice([1, 2, 0.5])}
        if kind == "str":
            return {"minLength": r.randrange(3), "maxLength": r.randrange(1, 4), "pattern": r.choice(["^a", "b$", "[0-9]"])}
        if kind == "obj":
            return {"properties": {k: schema(d - 1) for k in r.sample("abc", 2)}, "required": r.sample("abcd", 1), "additionalProperties": r.choice([True, False, {"type": "integer"}]), "maxProperties": 3}
        if kind == "arr":
            return {"prefixItems": [schema(d - 1)], "items": r.choice([False, schema(d - 1)]), "minItems": r.randrange(3), "uniqueItems": r.random() < 0.5, "contains": {"type": r.choice(["string", "integer"])}}
        if kind == "enum":
            return {"enum": r.sample([1, "a", None, True, 2.5, [1]], 3)}
        return {"any": {"anyOf": [schema(d - 1), schema(d - 1)]}, "one": {"oneOf": [schema(d - 1), schema(d - 1)]}, "not": {"not": schema(d - 1)}, "if": {"if": schema(d - 1), "then": schema(d - 1), "else": schema(d - 1)}}[kind]

    def value(d):
        return r.choice([lambda: r.randrange(-3, 9), lambda: r.choice([0.5, 2.0, 2.5]), lambda: r.choice(["", "a", "ab", "b1", "abc9"]), lambda: None, lambda: True, lambda: [value(d - 1) for _ in range(r.randrange(4))] if d else [], lambda: {k: value(d - 1) for k in r.sample("abcd", r.randrange(4))} if d else {}])()

    texts = [json.dumps(value(2)) for _ in range(60)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for _ in range(8):
        s = schema(2)
        columns = df.select("t", F.transform(N.errors_of_json(s, F.parse_json("t")), lambda e: F.struct(e["path"], e["expected"])).alias("e")).collect()
        for row in columns:
            assert sorted((e[0], e[1]) for e in row.e) == sorted(found(s, json.loads(row.t))), (s, row.t)


SCHEMAS = [("a", json.dumps({"properties": {"n": {"maximum": 5}}})), ("b", json.dumps(TREE)), ("broken", "{"), ("wrong", json.dumps({"type": "nothing"}))]
RECORDS = [
    (1, "a", '{"n":1}', 0), (2, "a", '{"n":9,"n":2}', 1), (3, "a", '{"n":7}', 0), (4, "b", '{"v":91,"left":{}}', 0), (5, "none", "1", 0), (6, None, "1", 0), (7, "a", None, 0), (8, "b", "{v", None), (9, "broken", "1", 0),
    (10, "wrong", "1", 0), (3, "a", '{"n":7}', 0), (11, "b", "", 0),
]
WANTED = {
    1: [], 2: [], 3: ["integer & Maximum<5>"], 4: ["integer & Maximum<90>", "required property"], 5: ["known schema"], 6: ["known schema"], 7: ["JSON value"], 8: ["JSON value"], 9: ["valid schema"], 10: ["valid schema"], 11: ["JSON value"],
}


@pytest.mark.parametrize("bounds", [{}, {"shipped": 0}, {"shipped": 0, "spread": 2}])
def test_schemas_by_key(spark, bounds):
    """Shipped, shuffled and spread programs give the same; columns with internal names pass through."""
    schemas = spark.createDataFrame(SCHEMAS, "k string, schema string")
    records = spark.createDataFrame(RECORDS, "_row int, k string, t string, errors int").withColumnRenamed("errors", "_part")
    out = W.validated_by(records, "t", "k", schemas, **bounds)
    assert out.columns == ["_row", "k", "t", "_part", "errors", "valid"]
    rows = out.collect()
    assert len(rows) == len(RECORDS) and all(sorted(e.expected for e in x.errors) == WANTED[x["_row"]] and x.valid == (not x.errors) for x in rows)
    assert W.validated_by(records.limit(0), "t", "k", schemas, **bounds).count() == 0
    assert W.validated_by(records, "t", "k", schemas.limit(0), **bounds).where("not valid").count() == len(RECORDS)
