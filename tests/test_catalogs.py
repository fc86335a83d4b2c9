"""Diagnostics, partial schemas, cases on relations, similar fields against all pairs."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from mendframe.operators import catalogs as C
from mendframe.operators import packages as P


def test_diagnostics(spark):
    rows = [("a", None), ("b", "{"), ("c", '{"properties": {"x": {"type": "string"}}}'), ("d", '{"type": "object", "required": []}'), ("e", "true")]
    out = C.diagnostics(P.loaded(spark.createDataFrame(rows, "k string, text string"), "text"), "k").select("k", "code", C.as_text().alias("t"), C.as_json().alias("j")).collect()
    assert sorted((r.k, r.code) for r in out) == [("a", "S001"), ("b", "S002"), ("c", "S003"), ("c", "S004"), ("e", "S003")]
    b = next(r for r in out if r.k == "b")
    assert b.t.startswith("[error][S002] Schema is not valid JSON\n  context: schema: b\n  help: Regenerate") and json.loads(b.j)["severity"] == "error"
    assert json.loads(next(r.j for r in out if r.code == "S004"))["context"] is None


def test_partial_and_cases(spark):
    df = spark.createDataFrame([('{"required":["a"],"properties":{"b":{"required":["c"]}}}',), ("true",), ("[1]",), ("{",), (None,)], "t string")
    assert [r[0] for r in df.select(C.partial(F.col("t"))).collect()] == ['{"properties":{"b":{"required":["c"]}}}', "true", "[1]", None, None]
    rel = spark.createDataFrame([("a", "gte", "b"), ("x", "eq", "y"), ("p", "lt", "q"), (None, "lte", "z")], "field_a string, operator string, field_b string")
    got = sorted((r.description, r.value, r.valid) for r in C.relation_cases(rel.where("field_a is not null")).collect())
    assert got == [("b<a (safe)", '{"b":9,"a":10}', True), ("b==a (boundary)", '{"b":10,"a":10}', True), ("b>a (violation)", '{"b":11,"a":10}', False), ("x!=y (violation +1)", '{"x":11,"y":10}', False), ("x!=y (violation -1)", '{"x":9,"y":10}', False), ("x==y (correct)", '{"x":10,"y":10}', True)]


def test_similar_fields_recall(spark):
    r = np.random.Generator(np.random.PCG64(3))
    base = r.standard_normal((120, 32))
    rows = [(f"f{i}", v.tolist()) for i, v in enumerate(base)]
    for i, v in enumerate(base):  # one near each, at cosines from 0.7 on
        rows.append((f"g{i}", (v + r.standard_normal(32) * random.Random(i).uniform(0.1, 1.0)).tolist()))
    rows += [(f"copy{i}", base[0].tolist()) for i in range(300)] + [("zero", [0.0] * 32), ("none", None), ("short", [1.0, 2.0]), ("empty", []), (None, base[1].tolist()), ("nan", [float("nan")] * 32)]
    pairs, members = C.similar_fields(spark.createDataFrame(rows, "name string, vector array<double>"))
    x = base / np.linalg.norm(base, axis=1, keepdims=True)
    near = np.array([v for n, v in rows[120:240]])
    near /= np.linalg.norm(near, axis=1, keepdims=True)
    all_ = [(n, v) for n, v in zip([f"f{i}" for i in range(120)] + [f"g{i}" for i in range(120)], np.concatenate([x, near]))]
    name = {"f0": "copy0"}  # the least name of the class of copies
    want = {tuple(sorted((name.get(a, a), name.get(b, b)))) for i, (a, v) in enumerate(all_) for b, w in all_[i + 1 :] if v @ w >= 0.8}
    got = {(p.a, p.b) for p in pairs.collect()}
    assert got <= want and len(got) >= 0.9 * len(want) > 50
    classes = {m.name: m["class"] for m in members.collect()}
    assert classes["copy7"] == "copy0" == classes["f0"] and "zero" not in classes and "nan" not in classes and len(classes) == 541
    assert C.unifiable(spark.createDataFrame([], "name string, vector array<double>")).count() == 0


def test_vectors_are_made_above_distinct(spark):
    rows = spark.range(100).select(F.concat(F.lit("n"), (F.col("id") % 3).cast("string")).alias("name")).distinct()
    pairs, _ = C.similar_fields(rows.select("name", C.name_vector(F.col("name")).alias("vector")))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate [name") :].split("\n")
    assert not any("md5" in line for line in below[1 : next(i for i, line in enumerate(below) if "Range" in line) + 1])
