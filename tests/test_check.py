import json

import pyarrow as pa
from pyspark.sql import functions as F

from mendframe.operators import check as C
from mendframe.operators import walk as W

S = {"type": "string"}
#: schema, value, coerced value, types of change
CASES = [
    ({"type": "object", "properties": {"age": {"type": "integer"}, "role": {**S, "enum": ["admin", "user"]}}}, {"age": "25", "role": "Admin"}, {"age": 25, "role": "admin"}, ["string_to_int", "enum_case"]),
    ({"type": "object", "properties": {"role": {**S, "default": "user"}, "n": {"type": "integer", "default": 0}}}, {"n": None}, {"role": "user", "n": 0}, ["default_fill", "default_fill"]),
    ({"type": "object", "properties": {"n": {"type": "integer", "minimum": 10, "default": 5}}}, {}, {"n": 5}, ["default_fill"]),
    ({"type": "array", "items": S}, {"0": "a", "1": "b", "2": "c"}, ["a", "b", "c"], ["unknown"]),
    ({"type": "array", "items": S}, {"a": 1}, [{"a": 1}], ["unknown"]),
    ({"type": "array", "items": {"type": "integer"}}, "7", [7], ["string_to_array"]),
    ({"type": "array", "items": {"type": "integer"}}, ["1", 2, "x"], [1, 2, "x"], ["string_to_int"]),
    ({"type": "array"}, {}, [], ["unknown"]),
    ({**S, "enum": ["1", "2"]}, 1, "1", ["number_to_string"]),
    ({"type": "integer", "enum": [1, 2]}, "2", 2, ["string_to_int"]),
    ({"type": "number"}, "1,234.5", 1234.5, ["string_to_number"]),
    ({"type": "number"}, "1.5k", 1500.0, ["string_to_number"]),
    ({"type": "number"}, "1d", "1d", []),
    ({"type": "boolean"}, "YES", True, ["string_to_bool"]),
    ({"type": "null"}, "N", None, ["string_to_null"]),
    (S, True, "true", ["bool_to_string"]),
    (S, "  x ", "x", ["enum_case"] if "  x ".lower() == "x" else ["string_trim"]),
    (S, {"a": 1}, {"a": 1}, []),
    ({"type": "object", "properties": {"o": {"type": "object", "properties": {"n": {"type": "integer"}}}}}, {"o": '{"n": "3"}'}, {"o": {"n": 3}}, ["string_to_object"]),
    ({"type": "object", "properties": {"a": S}, "additionalProperties": {"type": "integer"}}, {"a": "x", "b": "4"}, {"a": "x", "b": 4}, []),
    ({"anyOf": [S, {"type": "integer"}]}, "5", "5", []),
    ({"anyOf": [{"type": "integer"}, {"type": "null"}]}, "5", 5, ["string_to_int"]),
    ({"oneOf": [{"type": "array", "items": {"type": "integer"}}, {"type": "integer"}]}, ["5"], [5], ["unknown"]),
    ({"const": 5}, "5", "5", []),
    ({"$ref": "#/$defs/A", "$defs": {"A": {"type": "integer"}}}, "5", 5, ["string_to_int"]),
]


def test_coercions(spark):
    df = spark.createDataFrame([(json.dumps(v),) for _, v, _, _ in CASES], "text string").coalesce(1)
    df = df.select(F.monotonically_increasing_id().alias("i"), F.parse_json("text").alias("v"))
    pick = lambda f: F.coalesce(*[F.when(F.col("i") == k, f(s)) for k, (s, _, _, _) in enumerate(CASES)])
    typed = df.withColumn("c", F.parse_json(pick(lambda s: C.coerced(s, F.col("v")))))
    rows = typed.select("i", F.to_json("c").alias("text"), pick(lambda s: C.coercions(s, F.col("v"), F.col("c"))).alias("log")).collect()
    for r in rows:
        schema, value, want, kinds = CASES[r.i]
        assert json.loads(r.text) == want, (schema, value, r.text)
        assert [x.type for x in r.log] == kinds, (schema, value, r.log)


def test_coercion_along_the_data_equals_the_columns():
    for schema, value, want, _ in CASES:
        walk = W.Coercion([(at, op, json.loads(arg), to) for at, op, arg, to in W.compiled(schema)])
        assert W.same(walk.coerced(0, value), want), (schema, value, walk.coerced(0, value))


def test_check_from_text(spark):
    schema = {"type": "object", "properties": {"name": S, "age": {"type": "integer", "minimum": 0, "maximum": 150}, "email": {**S, "format": "email"}, "role": {**S, "enum": ["admin", "user"]}}, "required": ["name", "age"]}
    rows = [(1, 'Sure! ```json\n{name: "A", age: "25", role: "Admin",}\n```'), (2, '{"age": 200, "email": "x", "role": "none"}'), (3, ""), (4, None), (5, '{"name": "B", "age": []}'), (6, "no json")]
    out = {r.i: r for r in C.checked(spark.createDataFrame(rows, "i int, text string"), "text", schema).collect()}
    assert out[1].valid and json.loads(out[1].json) == {"name": "A", "age": 25, "role": "admin"} and [c.field for c in out[1].changes] == ["age", "role"]
    assert sorted(out[2].codes) == ["V001", "V002", "V003", "V004"] and not out[2].valid
    assert out[3].codes == ["P001"] == out[4].codes and out[6].codes == ["P002"] and not out[6].valid
    assert out[5].codes == ["V005"]
    closed = C.checked(spark.createDataFrame([(1, '{"name": "A", "age": 1, "x": 2}')], "i int, text string"), "text", schema, closed=True).first()
    assert [e.expected for e in closed.errors] == ["no extraneous properties"]
    many = {"type": "object", "required": list("abcdef")}
    assert C.checked(spark.createDataFrame([("{}",)], "text string"), "text", many).first().codes.count("V100") == 1


def test_field_confidence(spark):
    schema = {"properties": {"a": {"type": "integer"}, "b": {**S, "enum": ["x"]}, "c": {"type": "array", "items": S}, "d": {**S, "default": "q"}, "e": {"type": "boolean"}, "f": {"type": "integer"}}}
    df = spark.createDataFrame([('{"a": "5", "b": "X", "c": "s", "e": "yes", "f": "no"}',)], "text string").select(F.parse_json("text").alias("v"))
    df = df.withColumn("c", F.parse_json(C.coerced(schema, F.col("v")))).withColumn("e", C.errors_of_json(schema, F.col("c")))
    got = {r.field: (r.confidence, r.status) for r in df.select(F.inline(C.field_confidence(schema, F.col("v"), F.col("c"), F.col("e")))).collect()}
    assert got == {"a": (1.0, "coerced"), "b": (0.9, "coerced"), "c": (0.9, "coerced"), "d": (0.6, "coerced"), "e": (0.7, "coerced"), "f": (0.0, "invalid")}


def test_typed_values_equal_the_columns():
    from mendframe.operators.typed import Typed

    for schema, value, want, kinds in CASES:
        value = W.decode(json.dumps(value))
        near = Typed(schema).coerced(value)
        assert W.same(near, want) and [k for _, _, _, k in Typed(schema).changes(value, near)] == kinds, (schema, value, near)
    assert Typed({"items": {"type": "string"}, "type": "array"}).text("[7.50, 1e7, true, null]") == '["7.5","1.0E7","true",null]'


def test_checked_keeps_numbers_and_reads_a_text_once(spark):
    rows = [(1, '{"n": "1,5", "x": 0.1234567890123456789, "y": 1.50, "z": 1e7}'), (2, '{"x": 1e999}'), (3, '{"n": 1} tail'), (4, "[" * 600 + "1")]
    df = C.checked(spark.createDataFrame(rows, "i int, text string"), "text", {"properties": {"n": {"type": "integer"}}})
    out = {r.i: r for r in df.collect()}
    assert out[1].json == '{"n":15,"x":0.1234567890123456789,"y":1.5,"z":1.0E7}' and out[1].changes[0].coerced == "15"
    assert json.loads(out[2].json) == {"x": 0} and json.loads(out[3].json) == {"n": 1} and out[4].codes == ["P006"]
    assert df._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1


def test_texts_that_repeat_in_a_batch_are_checked_once(monkeypatch):
    """So many orders' attempts have the same few texts; nulls are checked too."""
    schema = {"type": "object", "properties": {"qty": {"type": "integer", "maximum": 30}}, "required": ["qty"]}
    typed, walk = C.Typed(schema), C.Walk([(at, op, json.loads(arg), to) for at, op, arg, to in W.compiled(schema)])
    texts = ['{"qty": "7"}', None, "no idea", "{qty: 40,}", '{"qty": 1}'] * 100
    alone = [C.checked_batch(typed, walk, pa.array([t], pa.string())).to_pylist()[0] for t in texts[:5]]
    asked, own = [], C.typed_rows
    monkeypatch.setattr(C, "typed_rows", lambda typed, walk, t: asked.append(t) or own(typed, walk, t))
    assert C.checked_batch(typed, walk, pa.array(texts, pa.string())).to_pylist() == alone * 100
    assert len(asked) == 5
    assert C.checked_batch(typed, walk, pa.array([], pa.string())).to_pylist() == []


def test_large_tables_are_spread_too(spark, tmp_path, monkeypatch):
    from mendframe import stage

    spark.range(40_000).coalesce(1).write.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(stage, "SPLIT", 10_000)
    assert stage.spread(spark.read.parquet(str(tmp_path / "t"))).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
