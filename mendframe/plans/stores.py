"""Versions as of a time, their differences, and random records; from brands, events and orders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested as N
from ..operators import versions as V
from ..operators.random_json import random_json
from .tables import table

_N = "CAST(substring_index(p_brand, '#', -1) AS INT)"


def _brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").groupBy(F.col("p_brand").alias("store")).agg(F.min(F.expr(_N)).alias("n"), F.max("p_size").alias("size"))


def _versions(spark: SparkSession, d: str) -> DataFrame:
    """Three versions of a schema a brand: a's maximum grows (not for even brands), b comes with the second, c turns into a number with the third."""
    v = F.col("version")
    body = F.concat(
        F.lit('{"required":["a"],"properties":{"a":{"type":"integer","maximum":'), (F.col("size") + F.when(F.col("n") % 2 == 0, 0).otherwise(v)).cast("string"), F.lit("}"), F.when(v >= 2, ',"b":{"type":"boolean"}').otherwise(""),
        F.lit(',"c":{"type":"'), F.when(v == 3, "number").otherwise("string"), F.lit('"}}}'),
    )
    return _brands(spark, d).withColumn("version", F.explode(F.array(*map(F.lit, (1, 2, 3))))).select("store", "n", "version", F.timestamp_seconds(v * 10).alias("at"), body.alias("body"))


def _pointers(spark: SparkSession, d: str) -> DataFrame:
    """A push at 10, 20 and 30 seconds; even brands ask to go back to version n modulo 5 at 35."""
    versions = _versions(spark, d)
    back = _brands(spark, d).where("n % 2 = 0").select("store", F.timestamp_seconds(F.lit(35)).alias("at"), (F.col("n") % 5).cast("int").alias("version"))
    return versions.select("store", "at", "version").unionByName(V.rolled_back(back, versions).where("error is null").drop("error"))


def versions_as_of(spark: SparkSession, d: str) -> DataFrame:
    """How many events met which version of their brand's schema."""
    requests = table(spark, d, "events").select(F.concat(F.lit("Brand#"), (F.col("user_id") % 27).cast("string")).alias("store"), F.timestamp_seconds(F.col("event_id") % 50).alias("at"))
    return V.as_of(requests, _pointers(spark, d)).groupBy("store", "current_version").agg(F.count("*").alias("n"))


def version_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changelog of all stores, and a difference that skips a version or names none."""
    versions = _versions(spark, d)
    far = _brands(spark, d).select("store", F.lit(1).alias("from"), F.when(F.col("n") % 3 == 0, 4).otherwise(3).alias("to"))
    return V.changelog(versions).unionByName(V.version_diff(far, versions))


RANDOM = {
    "type": "object",
    "$defs": {"Part": {"type": "object", "properties": {"size": {"type": "integer", "minimum": -5, "maximum": 5}, "made": {"type": "string", "format": "date"}}}},
    "properties": {
        "id": {"type": "integer", "minimum": 10, "maximum": 99}, "rate": {"type": "number", "minimum": 1, "maximum": 3}, "kind": {"enum": ["a", 2, None]}, "name": {"type": "string", "minLength": 3, "maxLength": 40},
        "parts": {"type": "array", "minItems": 0, "maxItems": 2, "items": {"$ref": "#/$defs/Part"}}, "either": {"anyOf": [{"type": "boolean"}, {"type": "string", "format": "ipv4"}]},
    },
    "required": ["id", "rate", "kind", "name", "parts", "either"],
}


def random_records(spark: SparkSession, d: str) -> DataFrame:
    """A random record an order, and whether the schema it was made of accepts it."""
    made = table(spark, d, "orders").select("o_orderkey", random_json(RANDOM, F.col("o_orderkey")).alias("record"))
    return N.validated_json(made, "record", RANDOM).select("o_orderkey", "record", "valid")


QUERIES = {f.__name__: f for f in (versions_as_of, version_changes, random_records)}

_BRANDS = "b AS (SELECT p_brand AS store, split_part(p_brand, '#', 2)::INT AS n, max(p_size) AS size FROM part GROUP BY 1, 2)"


def _draw(path: str) -> str:
    return f"('0x' || substr(md5('7:' || o_orderkey || ':{path}'), 1, 12))::BIGINT"


def _word(i: int) -> str:
    return f"translate(md5('7:' || o_orderkey || ':$.name#{i}'), '0123456789', 'ghijklmnop')"


def _part(i: int) -> str:
    at = f"$.parts[{i}]"
    day = "||'-'||".join(f"lpad(({_draw(f'{at}.made/{what}')} % {n} + {base})::VARCHAR, {width}, '0')" for what, n, width, base in (("year", 20, 4, 2010), ("month", 12, 2, 1), ("day", 28, 2, 1)))
    return f"""'{{"size":' || (-5 + {_draw(at + '.size/int')} % 11) || ',"made":"' || {day} || '"}}'"""


ORACLES = {
    "versions_as_of": f"""WITH {_BRANDS}, p AS (SELECT store, 10 * v AS at, v FROM b, (VALUES (1), (2), (3)) x(v) UNION ALL SELECT store, 35, n % 5 FROM b WHERE n % 2 = 0 AND n % 5 BETWEEN 1 AND 3),
      r AS (SELECT 'Brand#' || user_id % 27 AS store, event_id % 50 AS at FROM events)
      SELECT r.store, p.v AS current_version, count(*) AS n FROM r ASOF LEFT JOIN p ON r.store = p.store AND r.at >= p.at GROUP BY 1, 2""",
    "version_changes": f"""WITH {_BRANDS}, s AS (SELECT * FROM b, (VALUES (1, 2), (2, 3), (1, 3)) x("from", "to") WHERE NOT ("from" = 1 AND "to" = 3 AND n % 3 = 0))
      SELECT store, "from", "to", 'a' AS path, 'changed' AS change, 'maximum' AS field, (size + "from")::DOUBLE::VARCHAR AS old, (size + "to")::DOUBLE::VARCHAR AS new, NULL AS error FROM s WHERE n % 2 <> 0
      UNION ALL SELECT store, "from", "to", 'b', 'added', NULL, NULL, NULL, NULL FROM s WHERE "from" = 1 UNION ALL SELECT store, "from", "to", 'c', 'changed', 'type', '"string"', '"number"', NULL FROM s WHERE "to" = 3
      UNION ALL SELECT store, 1, 4, NULL, NULL, NULL, NULL, NULL, 'to version 4 out of range (1..=3)' FROM b WHERE n % 3 = 0""",
    "random_records": f"""SELECT o_orderkey, '{{"id":' || (10 + {_draw('$.id/int')} % 90) || ',"rate":' || ((100 + {_draw('$.rate/num')} % 201) / 100.0::DOUBLE)::DECIMAL(18, 2) || ',"kind":' || ['"a"', '2', 'null'][{_draw('$.kind/enum')} % 3 + 1]
      || ',"name":"' || substr({_word(0)} || {_word(1)}, 1, (3 + {_draw('$.name/length')} % 38)::INT) || '","parts":[' || CASE {_draw('$.parts/items')} % 3 WHEN 0 THEN '' WHEN 1 THEN {_part(0)} ELSE {_part(0)} || ',' || {_part(1)} END || '],"either":'
      || CASE {_draw('$.either/union')} % 2 WHEN 0 THEN CASE WHEN {_draw('$.either/bool')} % 2 = 0 THEN 'false' ELSE 'true' END ELSE '"' || {" || '.' || ".join(f"{_draw(f'$.either/o{i}')} % 256" for i in range(4))} || '"' END || '}}' AS record, true AS valid FROM orders""",
}
