"""Groups of failed fields, corrections, attempts in batches and in a stream."""

import json
import time

from pyspark.sql import functions as F

from mendframe.operators import check as C
from mendframe.operators import retry as R
from mendframe.streaming.quality import guarded_stream

SCHEMA = {"type": "object", "properties": {"age": {"type": "integer", "minimum": 0}, "name": {"type": "string"}, "end": {"type": "integer"}}, "required": ["name", "age"]}


def test_groups_are_one_hop_from_their_first_field(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "d"]), (2, []), (3, None), (4, ["c", "a"])], "i int, f array<string>")
    groups = {r.i: r.g for r in df.select("i", R.field_groups(F.col("f"), [("b", "gte", "a"), ("b", "lt", "c")]).alias("g")).collect()}
    assert groups == {1: [["a", "b"], ["c"], ["d"]], 2: [], 3: [], 4: [["c"], ["a"]]}
    assert df.where("i = 1").select(R.field_groups(F.col("f"), [])).first()[0] == [["a"], ["b"], ["c"], ["d"]]


def test_corrections(spark):
    old = json.dumps({"name": "Bo", "age": -5, "end": 9})
    rows = [(1, old, '{"age": "25"}', ["age"]), (2, old, '{"age": -1}', ["age"]), (3, old, "nothing", ["age"]), (4, old, '{"age": 10}', ["age"]), (5, old, '{"name": 7}', ["age"]), (6, old, None, ["age"]), (7, old, "[1]", ["age"])]
    out = {r.i: r for r in R.retried(spark.createDataFrame(rows, "i int, o string, c string, f array<string>"), "o", "c", "f", SCHEMA, [("end", "gte", "age")]).collect()}
    assert out[1].retry_error == "merge introduced new errors: end" and out[1].merged is None
    assert out[2].still_failed == ["age"] and json.loads(out[2].merged)["age"] == -1 and out[2].merged_fields == ["age"]
    assert out[3].retry_error == "invalid JSON" == out[6].retry_error
    assert out[4].retry_error == "merge introduced new errors: end"
    assert out[5].merged_fields == [] and out[5].still_failed == ["age"] and json.loads(out[5].merged) == json.loads(old) == json.loads(out[7].merged)


ATTEMPT = "k string, attempt int, seconds double, t string"


def test_attempts(spark):
    good, bad = '{"name":"a","age":1}', '{"name":"a","age":-1}'
    rows = [
        ("first", 0, 0.0, good), ("first", 1, 1.0, bad), ("second", 0, 0.0, bad), ("second", 1, 5.0, good), ("second", 1, 5.0, good), ("never", 0, 0.0, bad), ("never", 1, 1.0, bad), ("never", 2, 2.0, bad), ("beyond", 0, 0.0, bad), ("beyond", 1, 1.0, bad), ("beyond", 2, 2.0, bad), ("beyond", 3, 3.0, good),
        ("slow", 0, 0.0, bad), ("slow", 1, 99.0, good), ("mute", 0, 0.0, "?"), ("odd", -1, 0.0, good), (None, 0, 0.0, good),
    ]
    out = {r.k: r for r in R.guarded(C.checked(spark.createDataFrame(rows, ATTEMPT), "t", SCHEMA), ["k"], 2, 60).collect()}
    assert {k: (r.status, r.attempts, r.codes) for k, r in out.items()} == {
        "first": ("passed", 1, []), "second": ("passed", 2, ["V002"]), "never": ("failed", 3, ["V002"] * 3), "beyond": ("failed", 3, ["V002"] * 3), "slow": ("timeout", 1, ["V002", "G002"]), "mute": ("failed", 1, ["P002", "G003"]), None: ("passed", 1, []),
    }
    assert "Minimum<0>" in out["never"].feedback and out["second"].feedback is None and json.loads(out["second"].json)["age"] == 1 and "odd" not in out


def test_attempts_in_a_stream(spark, tmp_path):
    good, bad = '{"name":"a","age":1}', '{"name":"a","age":-1}'
    source = str(tmp_path / "in")
    batches = [
        [("a", 0, bad), ("b", 1, bad), ("c", 1, "?"), ("d", 2, good)], [("a", 5, good), ("b", 6, bad), ("c", 6, bad), ("a", 7, bad)], [("late", 100, good), ("b", 8, good)], [("end", 400, good)], [("end", 900, bad)],
    ]
    got = []
    kind = "k string, at timestamp, t string"
    checked = C.checked(spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(source) if spark.createDataFrame([], kind).write.parquet(source) is None else None, "t", SCHEMA)
    out = guarded_stream(checked.select("k", "at", "valid", "json", "codes", "feedback"), "k", "at", 2, 60)
    query = out.writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(lambda df, i: got.extend(tuple(r) for r in df.select("k", "status", "attempts", F.array_join("codes", ",")).collect()))
    for rows in batches:
        spark.createDataFrame([(k, s + 10, t) for k, s, t in rows], "k string, s long, t string").select("k", F.timestamp_seconds("s").alias("at"), "t").coalesce(1).write.mode("append").parquet(source)
        query.trigger(availableNow=True).start().awaitTermination()
        time.sleep(0.1)
    assert [x for x in got if x[0] == "a"] == [("a", "retry", 1, "V002"), ("a", "passed", 2, "V002")]
    assert ("d", "passed", 1, "") in got and ("late", "passed", 1, "") in got
    # b and c failed twice; nothing came in time, so their timers ended them.
    assert [x for x in got if x[0] == "c"] == [("c", "retry", 1, "P002"), ("c", "retry", 2, "V002"), ("c", "timeout", 2, "P002,V002,G002")]
    assert [x[1] for x in got if x[0] == "b"][:2] == ["retry", "retry"] and [x[1] for x in got if x[0] == "b"][-1] in ("timeout", "passed")
