"""Nested records: orders with their line items as JSON, events as damaged text checked in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import check as C
from ..operators import nested as N
from ..operators import validate as V
from ..stage import spread
from .tables import table

ITEM = {
    "type": "object",
    "properties": {"n": {"type": "integer", "maximum": 6}, "qty": {"type": "number", "minimum": 5}, "flag": {"type": "string", "enum": ["A", "N"]}, "price": {"type": "number", "exclusiveMaximum": 90000}},
    "required": ["n", "flag"],
    "additionalProperties": False,
}
ORDER = {
    "type": "object",
    "$defs": {"Item": ITEM},
    "properties": {"id": {"type": "integer"}, "total": {"type": "number"}, "status": {"type": "string"}, "items": {"type": "array", "minItems": 2, "maxItems": 5, "items": {"$ref": "#/$defs/Item"}}},
    "required": ["id", "total"],
    "if": {"properties": {"status": {"const": "F"}}},
    "then": {"required": ["closed"]},
    "anyOf": [{"required": ["items"]}, {"properties": {"id": {"multipleOf": 2}}}],
}


def _order_texts(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey, text: an order as JSON; every third lacks its total, prices of third lines are texts, fifth lines have a field too many."""
    n = F.col("l_linenumber")
    price = F.when(n % 4 == 3, F.concat(F.lit('"'), F.col("l_extendedprice").cast("string"), F.lit('"'))).otherwise(F.col("l_extendedprice").cast("string"))
    text = F.concat(F.lit('{"n":'), n.cast("string"), F.lit(',"qty":'), F.col("l_quantity").cast("string"), F.lit(',"flag":"'), "l_returnflag", F.lit('","price":'), price, F.when(n % 5 == 0, ',"more":1').otherwise(""), F.lit("}"))
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", text.alias("text"))
    items = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["text"]), ",").alias("items"))
    o, k = table(spark, d, "orders").join(items, "o_orderkey", "left"), F.col("o_orderkey")
    total = F.when(k % 3 != 0, F.concat(F.lit('"total":'), F.col("o_totalprice").cast("string"), F.lit(","))).otherwise("")
    parts = F.when(F.col("items").isNotNull(), F.concat(F.lit(',"items":['), "items", F.lit("]"))).otherwise("")
    return o.select("o_orderkey", F.concat(F.lit("{"), total, F.lit('"id":'), k.cast("string"), F.lit(',"status":"'), "o_orderstatus", F.lit('"'), parts, F.lit("}")).alias("text"))


def nested_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every error of every order with its line items, by path."""
    out = N.validated_json(_order_texts(spark, d), "text", ORDER, values=False)
    return out.select("o_orderkey", F.explode("errors").alias("e")).select("o_orderkey", "e.path", "e.expected")


EVENT = {
    "type": "object",
    "properties": {"id": {"type": "integer", "minimum": 10}, "type": {"type": "string", "enum": ["click", "error", "login", "logout", "purchase", "view", "signup"]}, "tags": {"type": "array", "items": {"type": "string"}}, "ok": {"type": "boolean", "default": False}},
    "required": ["id", "type"],
}


def _event_texts(spark: SparkSession, d: str) -> DataFrame:
    k, t, n = F.col("event_id"), F.col("event_type"), F.col("event_id").cast("string")
    text = (
        F.when(k % 5 == 0, F.concat(F.lit('So:\n```json\n{"id": "'), n, F.lit('", type: "'), F.upper(t), F.lit('", ok: yes,}\n```'))).when(k % 5 == 1, F.concat(F.lit('{"id": '), n, F.lit(', "type": " '), t, F.lit(' ", "tags": "x"')))
        .when(k % 5 == 2, F.concat(F.lit('{"id": '), n, F.lit(', "ok": "off"}'))).when(k % 5 == 3, F.concat(F.lit("nothing on "), t)).otherwise(F.lit('{"id": "many", "type": "none", "ok": true'))
    )
    return spread(table(spark, d, "events")).select("event_id", text.alias("text"))


def checked_events(spark: SparkSession, d: str) -> DataFrame:
    """Damaged texts repaired, coerced and validated: how many have which codes and changes."""
    out = C.checked(_event_texts(spark, d), "text", EVENT)
    changes = F.array_join(F.transform("changes", lambda c: F.concat(c["field"], F.lit(":"), c["type"])), ",")
    rows = out.select((F.col("event_id") % 5).alias("kind"), F.array_join(F.sort_array("codes"), ",").alias("codes"), F.coalesce(changes, F.lit("")).alias("changes"), "valid")
    return rows.groupBy("kind", "codes", "changes", "valid").agg(F.count("*").alias("n"))


def field_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Mean confidence by field and status of the events that are objects."""
    texts = _event_texts(spark, d).where("event_id % 5 <> 3").select(C.parsed("text")["json"].alias("json"))
    typed = texts.withColumn("near", C.coerced_text(EVENT, F.col("json"))).withColumns({"v": F.try_parse_json("json"), "c": F.try_parse_json("near"), "errors": C.errors_of_text(EVENT, F.col("near"))})
    return typed.select(F.inline(C.field_confidence(EVENT, F.col("v"), F.col("c"), F.col("errors")))).groupBy("field", "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


def rule_documents(spark: SparkSession, d: str) -> DataFrame:
    """Orders that break rules over texts and numbers, each with its document."""
    o = table(spark, d, "orders").withColumn("tracking", F.when(F.col("o_orderkey") % 3 != 0, F.concat(F.lit("T"), "o_custkey")))
    shipped = {"if": [{"==": [{"var": "o_orderstatus"}, "F"]}, {"!!": [{"var": "tracking"}]}, True]}
    named = {"!": [{"missing": ["o_orderpriority", "tracking"]}]}
    dear = {"or": [{"<": [{"var": "o_totalprice"}, 300000]}, {"in": [{"var": "o_orderpriority"}, ["1-URGENT", "2-HIGH"]]}]}
    rules = V.rule_errors([("finished orders are tracked", shipped), ("nothing is missing", named), ("dear orders are urgent", dear), ("discount is known", {"==": [{"var": "no_such"}, None]})], o.columns)
    return o.select("o_orderkey", V.cross_field_document(V.relation_errors([("o_orderkey", "gt", "o_custkey")]), rules).alias("document")).where("document is not null")


QUERIES = {f.__name__: f for f in (nested_errors, checked_events, field_confidence, rule_documents)}
_ITEMS = "i AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place, * FROM lineitem JOIN orders ON o_orderkey = l_orderkey), p AS (SELECT *, '$input.items[' || place || ']' AS path FROM i), c AS (SELECT k, count(*) AS n FROM i GROUP BY 1)"
ORACLES = {
    "nested_errors": f"""WITH {_ITEMS}
      SELECT k AS o_orderkey, path || '.n' AS path, 'integer & Maximum<6>' AS expected FROM p WHERE l_linenumber > 6 UNION ALL SELECT k, path || '.qty', 'integer & Minimum<5>' FROM p WHERE l_quantity < 5 UNION ALL SELECT k, path || '.flag', 'one of ["A","N"]' FROM p WHERE l_returnflag NOT IN ('A', 'N')
      UNION ALL SELECT k, path || '.price', 'number' FROM p WHERE l_linenumber % 4 = 3 UNION ALL SELECT k, path || '.price', 'integer & ExclusiveMaximum<90000>' FROM p WHERE l_linenumber % 4 <> 3 AND l_extendedprice >= 90000 UNION ALL SELECT k, path, 'no extraneous properties' FROM p WHERE l_linenumber % 5 = 0
      UNION ALL SELECT k, '$input.items', 'array & MinItems<2>' FROM c WHERE n < 2 UNION ALL SELECT k, '$input.items', 'array & MaxItems<5>' FROM c WHERE n > 5
      UNION ALL SELECT o_orderkey, '$input.total', 'required property' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, '$input.closed', 'required property' FROM orders WHERE o_orderstatus = 'F'
      UNION ALL SELECT o_orderkey, '$input', 'union type' FROM orders WHERE o_orderkey NOT IN (SELECT k FROM c) AND o_orderkey % 2 <> 0""",
    "checked_events": """WITH e AS (SELECT event_id % 5 AS kind, event_id < 10 AS low FROM events)
      SELECT kind, CASE kind WHEN 2 THEN CASE WHEN low THEN 'V002,V004' ELSE 'V004' END WHEN 3 THEN 'P002' WHEN 4 THEN 'V003,V005' ELSE CASE WHEN low THEN 'V002' ELSE '' END END AS codes,
        CASE kind WHEN 0 THEN 'id:string_to_int,type:enum_case' WHEN 1 THEN 'type:string_trim,tags:string_to_array,ok:default_fill' WHEN 2 THEN 'ok:string_to_bool' ELSE '' END AS changes, kind < 2 AND NOT low AS valid, count(*) AS n FROM e GROUP BY 1, 2, 3, 4""",
    "field_confidence": """WITH e AS (SELECT event_id % 5 AS kind, event_id < 10 AS low FROM events WHERE event_id % 5 <> 3), f AS (
        SELECT 'id' AS field, CASE WHEN low OR kind = 4 THEN 'invalid' WHEN kind = 0 THEN 'coerced' ELSE 'valid' END AS status, CASE WHEN low OR kind = 4 THEN 0.0 ELSE 1.0 END AS confidence FROM e
        UNION ALL SELECT 'type', CASE WHEN kind IN (2, 4) THEN 'invalid' ELSE 'coerced' END, CASE WHEN kind IN (2, 4) THEN 0.0 WHEN kind = 0 THEN 0.9 ELSE 1.0 END FROM e
        UNION ALL SELECT 'tags', CASE WHEN kind = 1 THEN 'coerced' ELSE 'valid' END, CASE WHEN kind = 1 THEN 0.9 ELSE 1.0 END FROM e
        UNION ALL SELECT 'ok', CASE WHEN kind IN (1, 2) THEN 'coerced' ELSE 'valid' END, CASE WHEN kind = 1 THEN 0.6 WHEN kind = 2 THEN 0.7 ELSE 1.0 END FROM e)
      SELECT field, status, count(*) AS n, round(avg(confidence), 4) AS confidence FROM f GROUP BY 1, 2""",
    "rule_documents": """WITH o AS (SELECT o_orderkey, list_filter([CASE WHEN o_orderkey <= o_custkey THEN '{"code":"REL001","message":"o_orderkey must be gt o_custkey"}' END,
          CASE WHEN o_orderstatus = 'F' AND o_orderkey % 3 = 0 THEN '{"code":"RULE001","message":"finished orders are tracked"}' END, CASE WHEN o_orderkey % 3 = 0 THEN '{"code":"RULE001","message":"nothing is missing"}' END,
          CASE WHEN o_totalprice >= 300000 AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN '{"code":"RULE001","message":"dear orders are urgent"}' END], lambda x: x IS NOT NULL) AS d FROM orders)
      SELECT o_orderkey, '{"feedback":"Cross-field constraints violated","diagnostics":[' || list_aggregate(d, 'string_agg', ',') || ']}' AS document FROM o WHERE len(d) > 0""",
}
