"""Tools, calls and diagnostics over the small tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tools as T
from .properties import _props_sql, props
from .tables import table


def api_tools(spark: SparkSession, d: str) -> DataFrame:
    """Operations of an API document for each nation."""
    n = F.col("n_nationkey").cast("string")
    body = F.concat(F.lit('{"paths":{"/n/'), n, F.lit('":{"get":{"summary":"read '), n, F.lit('","parameters":[{"name":"q","required":true,"schema":{"type":"integer"}},{"name":"r"}]},"post":{"operationId":"make-'), n, F.lit('"},"head":{}}}}'))
    out = T.api_tools(table(spark, d, "nation").select("n_nationkey", body.alias("body")), ["n_nationkey"])
    return out.withColumn("parameters", F.array_join(F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"))), ","))


def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    """Line items as calls of three functions, one of them without a handler."""
    name = F.element_at(F.array(*[F.lit(x) for x in ("price", "ship", "lost", "price")]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    calls = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("call_id"), name.alias("name"), F.col("l_quantity").alias("quantity"), F.col("l_partkey").alias("item"))
    schemas = {"price": {"properties": {"quantity": {"minimum": 10}}, "required": ["quantity"]}, "ship": {"properties": {"item": {"maximum": 100000}}}}
    return T.dispatched(calls, schemas, {"price": lambda c: (F.col("item") * 2 + F.floor("quantity")).cast("long")}).groupBy("name", "error").agg(F.count("*").alias("n"), F.sum(F.col("result").cast("long")).alias("total"))


def constrained_descriptions(spark: SparkSession, d: str) -> DataFrame:
    return props(table(spark, d, "part")).select("schema_id", "path", T.constrained_description().alias("description"))


def parse_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of texts with and without JSON."""
    k = F.col("event_id") % 6
    text = F.when(k == 0, F.lit("  ")).when(k == 1, F.concat(F.lit("well, "), "event_type")).when(k == 2, F.lit("tru")).when(k == 3, F.concat(F.lit("x "), "props")).when(k == 4, F.lit("12 of them")).otherwise(F.lit(None).cast("string"))
    rows = table(spark, d, "events").select(k.alias("kind"), T.parse_code(text).alias("code"))
    return rows.groupBy("kind", "code").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (api_tools, tool_calls, constrained_descriptions, parse_codes)}
ORACLES = {
    "api_tools": """SELECT n_nationkey, '_n_' || n_nationkey AS name, 'get /n/' || n_nationkey || ' - read ' || n_nationkey AS description, 'get' AS method, '/n/' || n_nationkey AS path, 'q:integer:true,r:string:false' AS parameters FROM nation
      UNION ALL SELECT n_nationkey, 'make_' || n_nationkey, 'post /n/' || n_nationkey || ' - ', 'post', '/n/' || n_nationkey, '' FROM nation""",
    "tool_calls": """WITH c AS (SELECT ['price', 'ship', 'lost', 'price'][(l_linenumber % 4 + 1)::INT] AS name, l_quantity AS q, l_partkey AS p FROM lineitem),
      r AS (SELECT name, CASE WHEN name = 'price' AND q >= 10 THEN p * 2 + floor(q)::BIGINT END AS result, CASE name WHEN 'lost' THEN 'function ''lost'' not found' WHEN 'ship' THEN 'no dispatcher for ''ship''' ELSE CASE WHEN q < 10 THEN '$input.quantity: expected integer & Minimum<10>' END END AS error FROM c)
      SELECT name, error, count(*) AS n, sum(result)::BIGINT AS total FROM r GROUP BY 1, 2""",
    "constrained_descriptions": f"""WITH p AS {_props_sql('true')}, s AS (SELECT *, concat_ws(', ', 'minimum: ' || minimum::BIGINT, 'maximum: ' || maximum::BIGINT, 'format: ' || format, CASE WHEN values IS NOT NULL THEN 'allowed: [' || list_aggregate(list_transform(values, lambda v: '"' || v || '"'), 'string_agg', ', ') || ']' END) AS said FROM p)
      SELECT schema_id, path, CASE WHEN said = '' THEN description ELSE coalesce(description || ' ', '') || '@constraints ' || said END AS description FROM s""",
    "parse_codes": "SELECT event_id % 6 AS kind, CASE event_id % 6 WHEN 0 THEN 'P001' WHEN 1 THEN 'P002' WHEN 5 THEN 'P001' END AS code, count(*) AS n FROM events GROUP BY 1, 2",
}
