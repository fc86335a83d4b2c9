import json

from pyspark.sql import functions as F

from mendframe.functions.coerce import to_boolean, to_enum, to_number
from mendframe.functions.formats import is_format
from mendframe.functions.guards import sanitized, url_code
from mendframe.functions.repair import parsed, repair
from mendframe.operators import schemas as S
from mendframe.operators import validate as V
from mendframe.streaming.quality import repair_loop, route, windowed_rates


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, f):
    return [r[0] for r in column(spark, values).orderBy("i").select(f(F.col("v"))).collect()]


def test_repair_recovers(spark):
    cases = {
        '{"a": 1, "b": 2, }': {"a": 1, "b": 2}, '{"a": {"b": [1, 2': {"a": {"b": [1, 2]}}, 'Sure! ```json\n{"a": 1}\n``` Done!': {"a": 1}, "{a: 1, $b_2: 'x'}": None,
        '{"a": tru, "b": yes, "c": off}': {"a": True, "b": True, "c": False}, '{"a": 1, // note\n "b": /* x */ 2}': {"a": 1, "b": 2}, "Here is the JSON: {\"name\": \"Zoë\"} ok": {"name": "Zoë"},
        '{"a": "unclosed': {"a": "unclosed"}, '{"a": "q\\"q", "b": [1,,2,]}': {"a": 'q"q', "b": [1, 2]}, '{"u": "\\u0041"}': {"u": "A"}, '{"a": -.5, "b": 1.}': {"a": -0.5, "b": 1},
    }
    for (text, want), got in zip(cases.items(), apply(spark, list(cases), repair)):
        if want is not None:
            assert json.loads(got) == want, text
    assert apply(spark, [None, "", "no brackets", "   "], repair) == [None] * 4
    simple = {"42 apples": "42", '"a" b': '"a"', "tru": "true", "Off": "false", "// c\n nul": "null", ' {"a": [1, 2.50]} ': '{"a": [1, 2.50]}', 'say "{x}": {"b":1,}': '{"b":1}', "{1:2}": "{}", '{"a": "\\ud800x"': '{"a":"x"}'}
    assert apply(spark, list(simple), repair) == list(simple.values())
    long = "[" + ",".join('{a: "x", b: yes,}' for _ in range(20000))
    assert len(json.loads(apply(spark, [long], repair)[0])) == 20000
    codes = [tuple(r[0]) for r in column(spark, ['{"a" 1}', "{1:2}", "", "x", None]).orderBy("i").select(F.struct(parsed("v")["code"], F.size(parsed("v")["errors"]))).collect()]
    assert codes == [(None, 1), (None, 1), ("P001", 1), ("P002", 1), (None, 0)]


def test_coercions(spark):
    assert apply(spark, ["1,234", "1.5k", "2M", " 7 ", "1d", "", None, "x"], to_number) == [1234.0, 1500.0, 2e6, 7.0, None, None, None, None]
    assert apply(spark, ["tru", "YES", "f", "Off", "n", "maybe", "", None], to_boolean) == [True, True, False, False, False, None, None, None]
    assert apply(spark, ["Admin", " user ", "x", None], lambda c: to_enum(c, ["admin", "user"])) == ["admin", "user", "x", None]


def test_formats(spark):
    for name, good, bad in [
        ("email", "a.b@c.io", "a@b"), ("ipv4", "192.168.0.1", "1.2.3.256"), ("ipv6", "fe80::1", "1:2:3"), ("ipv6", "::ffff:1.2.3.4", ":::"), ("duration", "P1DT2H", "P"), ("uuid", "urn:uuid:00000000-0000-0000-0000-000000000000", "0"),
        ("date", "2024-02-31", "2024-13-01"), ("json-pointer", "/a~1b", "a"), ("byte", "aGk=", "a"), ("idn-hostname", "bücher.de", "-a.de"), ("hostname", "a-b.c", "a_b"), ("uri-reference", "#x", "x y"),
        ("date", "2024-01-01", "2024-01-01\n"), ("url", "http://ab", "http://a"), ("regex", "a(b|[c)])*\\(", "(["), ("regex", "", "a\\"), ("regex", "(?:x)+", "*a"), ("regex", "()", ")("), ("ipv6", "::1", "::1\n"),
    ]:
        assert apply(spark, [good, bad], lambda c: is_format(c, name)) == [True, False], name
    assert apply(spark, ["x" * 10001, "x"], lambda c: is_format(c, "password")) == [False, True]


def test_guards(spark):
    urls = ["http://172.16.0.1/", "http://172.32.0.1/", "http://0177.0.0.1/", "https://x.localhost", "gopher://x", "https://ok.example.com/a", "http://0xff/", "http://a_b/"]
    assert apply(spark, urls, url_code) == ["SEC003", None, "SEC005", "SEC002", "SEC001", None, "SEC005", "SEC005"]
    assert apply(spark, ["please Ignore Above; ignore the above"], sanitized) == ["please [filtered]; [filtered]"]


def test_schema_rows_follow_references(spark):
    body = {"$defs": {"A": {"type": "object", "properties": {"z": {"type": "integer", "minimum": 1}}, "required": ["z"]}}, "properties": {"a": {"$ref": "#/$defs/A"}, "b": {"enum": ["x", 1]}}, "required": ["b"]}
    rows = S.flat_properties(spark.createDataFrame([("s", json.dumps(body)), ("t", "{"), ("u", None)], "schema_id string, body string")).collect()
    assert [(r.path, r.type, r.minimum, r.required, r["values"]) for r in sorted(rows, key=lambda r: r.path)] == [("a.z", "integer", 1.0, True, None), ("b", None, None, True, ["x", "1"])]
    loop = {"$ref": "#/$defs/A", "$defs": {"A": {"$ref": "#/$defs/A"}}}
    assert S.flattened(loop) == []


def test_random_rows_satisfy_their_schema(spark):
    props = [{"path": "n", "type": "integer", "minimum": 3, "maximum": 9}, {"path": "e", "type": "string", "format": "email"}, {"path": "k", "values": ["a", "b"]}, {"path": "d", "type": "string", "format": "date"}]
    df = S.random_rows(spark, props, 200)
    schema = {"properties": {"n": {"minimum": 3, "maximum": 9}, "e": {"format": "email"}, "k": {"enum": ["a", "b"]}, "d": {"format": "date"}}, "required": ["n", "e", "k", "d"]}
    assert V.validated(df, schema).where("not valid").count() == 0
    assert df.collect() == S.random_rows(spark, props, 200).collect()


def test_rules(spark):
    df = spark.createDataFrame([(1, 5.0, None, ["a"]), (2, 0.0, "x", [])], "id int, a double, s string, l array<string>")
    odd = "odd: rule evaluation error: unknown operator no_such"
    rules = [("positive", {">": [{"var": "a"}, 0]}), ("odd", {"no_such": [1]}), ("has s", {"!": [{"missing": ["s"]}]})]
    got = [r[0] for r in df.orderBy("id").select(V.rule_errors(rules)).collect()]
    assert got == [[odd, "has s"], ["positive", odd]]


def test_rules_by_type(spark):
    df = spark.createDataFrame([("shipped", None, 3.0, 0, ""), ("shipped", "T1", 0.0, 7, "x"), ("new", None, None, None, None)], "status string, tracking string, total double, n int, t string")
    shipped = {"if": [{"==": [{"var": "status"}, "shipped"]}, {"!!": [{"var": "tracking"}]}, True]}
    cases = [
        (shipped, [False, True, True]), ({"!!": [{"var": "n"}]}, [False, True, False]), ({"!": [{"var": "t"}]}, [True, False, True]), ({"var": "total"}, [True, False, False]), ({"var": "no_such"}, [False] * 3),
        ({"if": [{"var": "tracking"}, {"var": "tracking"}, False]}, [False, True, False]), ({"==": [{"var": "n"}, {"+": [3, 4]}]}, [False, True, False]), ({"in": [{"var": "status"}, ["new", "old"]]}, [False, False, True]),
        ({"missing_some": [1, ["tracking", "t"]]}, [True, False, True]), ({"<": [-1, {"var": "n"}, 5]}, [True, False, False]), ({"==": [{"substr": [{"var": "status"}, -4, -2]}, "pp"]}, [True, True, False]),
        ({"some": [[1, 2], {">": [{"var": ""}, 1]}]}, [True] * 3), ({"==": [{"reduce": [[1, 2, 3], {"+": [{"var": "current"}, {"var": "accumulator"}]}, 0]}, 6]}, [True] * 3), ({"and": [{"var": "tracking"}, True]}, [False, True, False]),
        ({"none": [{"filter": [[1, 2], {">": [{"var": ""}, 2]}]}, {"==": [{"var": ""}, 1]}]}, [True] * 3), ({"!=": [{"var": "status"}, "new"]}, [True, True, False]), ({"==": [{"/": [{"var": "n"}, 0]}, None]}, [True] * 3),
    ]
    got = df.coalesce(1).select(*[V.rule_errors([("r", rule)], df.columns).alias(f"c{i}") for i, (rule, _) in enumerate(cases)]).collect()
    for i, (rule, want) in enumerate(cases):
        assert [not row[i] for row in got] == want, rule


def test_feedback_keeps_every_error(spark):
    schema = {"properties": {"a": {"minimum": 1}, "b": {"enum": ["x"]}}, "required": ["a"]}
    df = V.validated(spark.createDataFrame([(None, "y"), (1, "x")], "a int, b string"), schema)
    (text,) = [r.feedback for r in V.feedback(df, ["a"], []).collect()]
    assert '"description":"The value at `$input.a` is `undefined`."' in text and text.endswith('```\n\n**Unmappable validation errors:**\n```json\n[\n  {"path":"$input.b","expected":"one of ["x"]"}\n]\n```')
    both = V.cross_field_document(V.relation_errors([("a", "gt", "b")]), V.rule_errors([("r", False)]))
    assert json.loads(spark.createDataFrame([(1, 2)], "a int, b int").select(both).first()[0])["diagnostics"] == [{"code": "REL001", "message": "a must be gt b"}, {"code": "RULE001", "message": "r"}]


def test_empty_and_null_records(spark):
    schema = {"properties": {"a": {"minimum": 1}}, "required": ["a"]}
    df = spark.createDataFrame([(None,), (0.5,), (2.0,)], "a double")
    got = {r.a: [e.expected for e in r.errors] for r in V.validated(df, schema).collect()}
    assert got == {None: ["required property"], 0.5: ["integer & Minimum<1>"], 2.0: []}
    empty = df.limit(0)
    assert V.success_rate(V.validated(empty, schema)).first()["rate"] == 0.0
    assert V.top_failing(V.validated(empty, schema), 3).collect() == []


def test_compressed_feedback(spark):
    text = "\n".join(['x // [{"path":"p","expected":"number"}]'] * 30)
    out = V.compressed(spark.createDataFrame([(1, text), (2, "short")], "id int, text string"), ["id"], "text").orderBy("id").collect()
    assert out[0].text.split("\n")[2] == "  (28 more 'number' errors omitted)" and len(out[0].text.split("\n")) == 3
    assert out[1].text == "short"


def test_streams(spark, tmp_path):
    schema = {"properties": {"value": {"minimum": 10}}, "required": ["value"]}
    source = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(source)
    kind = spark.read.parquet(source).schema
    query = route(spark.readStream.schema(kind).parquet(source), schema, ["event_id"], str(tmp_path / "good"), str(tmp_path / "bad"), str(tmp_path / "cp"))
    query.awaitTermination()
    good, bad = spark.read.parquet(str(tmp_path / "good")).count(), spark.read.parquet(str(tmp_path / "bad")).count()
    assert good + bad == 1000 and good == spark.read.parquet(source).where("value >= 10").count()
    batch = windowed_rates(spark.read.parquet(source), schema, "ts")
    assert batch.agg(F.sum("total")).first()[0] == 1000


def test_repair_loop(spark):
    schema = {"properties": {"a": {"minimum": 3}}, "required": ["a"]}
    passed, failed = repair_loop(lambda df: df.withColumn("a", F.col("a") + 1), spark.createDataFrame([(2,), (1,), (-9,)], "a int"), schema, 2)
    assert sorted(map(tuple, passed.collect())) == [(3, 1), (3, 2)] and [r.a for r in failed.collect()] == [-7]


def test_rules_that_used_to_stop(spark):
    df = spark.createDataFrame([([5, 0], "1", 1)], "l array<int>, s string, n int")
    cases = [({"and": []}, False), ({"var": "l.0"}, True), ({"var": "l.1"}, False), ({"var": "l.9"}, False), ({"===": [1, "1"]}, False), ({"==": [1, "1"]}, True), ({"!==": [1, "1"]}, True), ({"if": [{"+": [1, -1]}, False, True]}, True), ({"or": [{"cat": ["", ""]}, {"var": "n"}]}, True)]
    got = df.select(*[V.rule_errors([("r", rule)], df.columns).alias(f"c{i}") for i, (rule, _) in enumerate(cases)]).first()
    assert [not x for x in got] == [want for _, want in cases]


def test_formats_by_rule(spark):
    good = {"ipv6": ["1:2:3:4:5:6:7:8", "::", "::1", "1::", "1::8", "1:2:3:4:5:6:1.2.3.4", "::ffff:1.2.3.4", "ABCD::1"], "regex": ["[a-z]", "a{2,10}", "\\p{Lu}+", "[z\\-a]", "x{3}", "\\P{L}", "[A-Za-z0-9_]"]}
    bad = {"ipv6": ["1:2:3:4:5:6:7:12345678", "1:2:3:4:5:6:7", "1::2::3", ":1", "1:", "1:2:3:4:5:6:7:8:9", "1:::2", "g::1", "::1.2.3.999", "1:2:3:4:5:6:7::8:9"], "regex": ["[z-a]", "a{2,1}", "\\p{Foo}", "(", "[", "*"]}
    for texts, want in ((good, True), (bad, False)):
        for name, values in texts.items():
            assert apply(spark, values, lambda c: is_format(c, name)) == [want] * len(values), name


def test_flat_multiples(spark):
    schema = {"properties": {"a": {"multipleOf": 0}, "b": {"multipleOf": 1e-12}, "c": {"multipleOf": 0.1}}}
    df = V.validated(spark.createDataFrame([(3.0, 3.5, 0.3), (3.0, 3.5, 0.35)], "a double, b double, c double"), schema)
    assert [[e.expected for e in r.errors] for r in df.orderBy("c").collect()] == [[], ["number & MultipleOf<0.1>"]]


def test_flat_types(spark):
    schema = {"properties": {"i": {"type": "integer"}, "d": {"type": "integer"}, "n": {"type": "number"}, "b": {"type": "boolean"}}}
    df = V.validated(spark.createDataFrame([("x", 1.5, "1e3", "yes"), ("7", 2.0, "?", "true"), (None, None, None, None)], "i string, d double, n string, b string"), schema)
    assert [[e.path for e in r.errors] for r in df.collect()] == [["$input.i", "$input.d", "$input.b"], ["$input.n"], []]
