"""Packages and versions in files, versions as of a time, random records."""

import datetime
import json

from pyspark.sql import functions as F

from mendframe.functions.formats import SUPPORTED
from mendframe.operators import nested as N
from mendframe.operators import packages as P
from mendframe.operators import versions as V
from mendframe.operators.random_json import random_json
from mendframe.sources import packages as S


def test_packages_from_files(spark, tmp_path):
    texts = {
        "full.json": json.dumps({"schema": {"type": "object", "properties": {"a": {"type": "integer"}, "b": {}}}, "relations": [{"field_a": "a", "operator": "lt", "field_b": "b"}, {"field_a": 3}], "rules": [{"logic": {"==": [1, 1]}}, {"description": "d"}], "counterexamples": [{"a": "x"}, {"a": "1"}]}),
        "plain.json": '{"type": "string",\n "minLength": 1}', "odd.json": '{"schema": {"title": "no type"}}', "broken.json": "{", "empty.json": "",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    rows = {r.file: r for r in S.read_packages(spark, str(tmp_path)).collect()}
    full = rows["full.json"]
    assert full.package and [tuple(r) for r in full.relations] == [("a", "lt", "b")] and [tuple(r) for r in full.rules] == [("unnamed rule", '{"==":[1,1]}')] and len(full.counterexamples) == 2
    assert not rows["plain.json"].package and json.loads(rows["plain.json"].schema)["minLength"] == 1 and not rows["odd.json"].package and rows["broken.json"].bad == "{"
    found = sorted((r.file, r.code, r.message) for r in P.findings(S.read_packages(spark, str(tmp_path)), "file").collect())
    assert [x for x in found if x[0] == "full.json"] == [
        ("full.json", "CE001", "Counterexample 2 passed validation — schema may be too loose"), ("full.json", "LINT002", "schema has properties but no 'required' array"), ("full.json", "LINT003", "property 'b' has no type constraint")
    ]
    assert ("broken.json", "LINT000", "not JSON") in found and ("odd.json", "LINT001", "schema has no top-level type constraint") in found and not any(x[0] == "plain.json" for x in found)


def at(second):
    return datetime.datetime(2024, 1, 1 + second // 100) + datetime.timedelta(seconds=second % 100)


def test_versions_in_time(spark, tmp_path):
    body = lambda n: json.dumps({"properties": {"a": {"maximum": n}}})
    path = str(tmp_path)
    versions = spark.createDataFrame([("s", v, at(v * 10), "Manual", body(v)) for v in (1, 2, 3)] + [("t", 1, at(10), "Generated", body(0))], S.VERSIONS)
    S.append_versions(versions, path)
    S.append_pointers(versions.select("store", "at", "version"), path)
    asked = spark.createDataFrame([("s", at(35), 1), ("s", at(210), 2), ("s", at(240), 9), ("t", at(40), 0), ("none", at(40), 1), ("s", at(41), None)], "store string, at timestamp, version int")
    back = V.rolled_back(asked, versions)
    errors = {(r.store, r.version): r.error for r in back.collect()}
    assert errors == {("s", 1): None, ("s", 2): None, ("s", 9): "version 9 out of range (1..=3)", ("t", 0): "version 0 out of range (1..=1)", ("none", 1): "version 1 out of range (1..=0)", ("s", None): "version null out of range (1..=3)"}
    S.append_pointers(back.where("error is null"), path)
    held, pointers = S.read_versions(spark, path)
    requests = spark.createDataFrame([("s", at(x), x) for x in (0, 10, 19, 20, 34, 35, 39, 209, 210, 299)] + [("t", at(50), -1), (None, at(50), -2), ("s", None, -3)], "store string, at timestamp, current int")
    got = {r.current: r.current_version for r in V.as_of(requests, pointers).collect()}
    assert got == {0: None, 10: 1, 19: 1, 20: 2, 34: 3, 35: 1, 39: 1, 209: 1, 210: 2, 299: 2, -1: 1, -2: None, -3: None}
    early, before = S.read_versions(spark, path, "2024-01-01 00:00:25")
    assert early.count() == 3 and before.count() == 3 and held.count() == 4
    assert sorted((r["from"], r["to"], r.field, r.old, r.new) for r in V.changelog(held).collect()) == [(1, 2, "maximum", "1.0", "2.0"), (2, 3, "maximum", "2.0", "3.0")]


def test_random_records_are_valid(spark):
    kinds = [{"type": "string", "format": f} for f in [*SUPPORTED, "datetime", "unknown"]]
    schema = {
        "$defs": {"Node": {"type": "object", "properties": {"v": {"type": "number", "minimum": -2.5, "maximum": 2.5}, "kids": {"type": "array", "minItems": 0, "maxItems": 2, "items": {"anyOf": [{"type": "null"}, {"$ref": "#/$defs/Node"}]}}}, "required": ["v"]}},
        "type": "object",
        "properties": {
            "tree": {"$ref": "#/$defs/Node"}, "texts": {"type": "array", "prefixItems": [], "items": {"type": "string", "minLength": 30, "maxLength": 70}, "minItems": 1}, "c": {"const": {"x": [1]}}, "e": {"enum": ["é", 1.5, None]}, "n": {"type": "integer", "maximum": -3, "minimum": -9}, "b": {"type": "boolean"},
            "o": {"oneOf": [{"type": "integer", "minimum": 500}, {"type": "string", "maxLength": 0}]}, **{f"f{i}": k for i, k in enumerate(kinds)},
        },
        "required": ["tree", "texts", "c", "e", "n", "b", "o"],
    }
    made = spark.range(300).select("id", random_json(schema, F.col("id")).alias("t")).cache()
    bad = N.validated_json(made, "t", schema).where("not valid").select("t", "errors").limit(2).collect()
    assert not bad, bad
    texts = {r.id: r.t for r in made.collect()}
    assert len(set(texts.values())) == 300
    assert {type(json.loads(t)["o"]) for t in texts.values()} == {int, str} and max(t.count('"kids"') for t in texts.values()) > 3
