"""Records printed with nested errors, and fields by path."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mendframe.operators import feedback as R
from mendframe.operators import fields as P


def error(path, expected, description=None):
    return {"path": path, "expected": expected, "value": "null", "description": description}


def test_errors_are_read_a_field_at_a_time():
    of = pa.list_(pa.struct([(n, pa.string()) for n in ("path", "expected", "value", "description")]))
    rows = [[error("$input.a", "x"), error("$input.b", "y", "z")], None, [], [error("$input.c", "w")]]
    shown = [[{k: e[k] for k in ("path", "expected", "description")} for e in r or []] for r in rows]
    assert R.lists_of_errors(pa.array(rows, of)) == shown
    assert R.lists_of_errors(pa.array(rows, of).slice(1)) == shown[1:]


def test_printed():
    value = {"b": [{"x": 1}, None, [], {}], "a": {"in": "q\"\n"}, "e": {}}
    errors = [
        error("$input", "root"), error("$input.a.in", "number"), error("$input.a.gone", "required property", 'say "so"\nnow'), error("$input.b", "array & MaxItems<2>"), error("$input.b[0].x", "string"), error("$input.b[0].x", "one of [2]"),
        error("$input.b[1]", "object"), error("$input.b[2][]", "item"), error("$input.e", "closed"), error("$input.z.y", "nowhere"),
    ]
    assert R.printed(json.dumps(value), errors) == """```json
{ // ❌ [{"path":"$input","expected":"root"}]
  "a": {
    "in": "q\\"\\n", // ❌ [{"path":"$input.a.in","expected":"number"}]
    "gone": undefined // ❌ [{"path":"$input.a.gone","expected":"required property","description":"say \\"so\\"\\nnow"}]
  },
  "b": [ // ❌ [{"path":"$input.b","expected":"array & MaxItems<2>"}]
    {
      "x": 1 // ❌ [{"path":"$input.b[0].x","expected":"string"},{"path":"$input.b[0].x","expected":"one of [2]"}]
    },
    undefined, // ❌ [{"path":"$input.b[1]","expected":"object"}]
    [
      undefined // ❌ [{"path":"$input.b[2][]","expected":"item"}]
    ],
    {}
  ],
  "e": {} // ❌ [{"path":"$input.e","expected":"closed"}]
}
```

**Unmappable validation errors:**
```json
[
  {"path":"$input.z.y","expected":"nowhere"}
]
```"""
    assert R.printed("7", [error("$input", "string")]) == '```json\n7 // ❌ [{"path":"$input","expected":"string"}]\n```'
    assert R.printed("[]", []) == "```json\n[]\n```"


@pytest.mark.parametrize(
    ("path", "want"),
    [("a.b[0].c", ["a", "b", 0, "c"]), ("[2][]", [2, None]), ("a[]b", ["a", None, "b"]), ("", []), ("a.[0]", ["a", 0]), ("a[", "unclosed bracket in: a["), ("a[-1]", "invalid index: -1"), (".", "empty key in: ."), ("a..b", "empty key in: a..b"), ("a.", "empty key in: a."), ("[0]]", [0, "]"])],
)
def test_steps(path, want):
    if isinstance(want, list):
        assert P.steps(path) == want
    else:
        with pytest.raises(ValueError) as e:
            P.steps(path)
        assert str(e.value) == want


def test_extracted(spark):
    text = json.dumps({"s": "plain", "n": None, "t": True, "i": 42, "o": {"k": 1}, "l": ["x", 1, {"y": 2}], "m": [[1, 2], [3]], "e": [], "d": {"'q\"": 5}, "r": [{"a": 1}, {"b": 2}, 7]})
    cases = {
        "s": ("plain", None), "n": ("null", None), "t": ("true", None), "i": ("42", None), "o": ('{"k":1}', None), "l": ('x\n1\n{"y":2}', None), "m[]": ("[1,2]\n[3]", None), "m[][]": ("1\n2\n3", None), "m[1]": ("3", None), "e[]": ("", None), "e": ("", None), "r[].a": (None, "field not found: a"),
        "o.k.z": (None, "field not found: z"), "l[9]": (None, "index out of bounds: 9"), "o[0]": (None, "expected array"), "o[]": (None, "expected array for []"), "d.'q\"": ("5", None), "x[": (None, "unclosed bracket in: x["), "e[].zz": ("", None),
    }
    df = spark.createDataFrame([(text,), (None,), ("{",)], "t string")
    rows = df.select("t", *[P.extracted(df.t, p).alias(str(i)) for i, p in enumerate(cases)]).collect()
    for i, (path, want) in enumerate(cases.items()):
        assert tuple(rows[0][str(i)]) == want, path
        assert all(r[str(i)].text is None and (r[str(i)].error == "invalid JSON" or "unclosed" in r[str(i)].error) for r in rows[1:])


def test_paths_parse_a_text_once(spark):
    from mendframe.operators.fields import extracted, extracted_from

    paths = ["a", "a[]", "b.c", "d[].e", "f", "g"]
    df = spark.createDataFrame([('{"a": [1.50, "x", null, {"k": "v"}], "b": {"c": "t"}, "d": [{"e": [1]}, {"e": true}], "f": null, "g": "[1]"}',), ("no",), (None,)], "t string").withColumn("v", F.try_parse_json("t"))
    rows = df.select(*[extracted(F.col("t"), p).alias(f"t{i}") for i, p in enumerate(paths)], *[extracted_from(F.col("v"), p).alias(f"v{i}") for i, p in enumerate(paths)]).collect()
    assert all(r[f"t{i}"] == r[f"v{i}"] for r in rows for i in range(len(paths)))
    assert [rows[0][f"v{i}"].text for i in range(6)] == ['1.5\nx\nnull\n{"k":"v"}', '1.5\nx\nnull\n{"k":"v"}', "t", "[1]\ntrue", "null", "[1]"]
