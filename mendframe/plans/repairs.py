"""Attempts until one passes, failed fields by groups, corrections merged, parse failures by code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import check as C
from ..operators import retry as R
from ..stage import spread
from .tables import table

QTY = {"type": "object", "properties": {"qty": {"type": "integer", "maximum": 30}}, "required": ["qty"]}


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def guarded_attempts(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as attempts at one answer, each twenty seconds after the one before."""
    q = F.col("l_quantity").cast("int")
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")) - 1
    text = F.when(q % 7 == 0, "no idea").when(q % 7 == 1, _text("{qty: ", q, ",}")).otherwise(_text('{"qty": "', q, '"}'))
    lines = table(spark, d, "lineitem").select("l_orderkey", place.alias("attempt"), (place * 20 + q % 10).cast("double").alias("seconds"), text.alias("text"))
    out = R.guarded(C.checked(lines, "text", QTY), ["l_orderkey"], 3, 50)
    return out.select("l_orderkey", "status", "attempts", "json", F.array_join("codes", ",").alias("codes"), F.col("feedback").isNotNull().alias("asked"))


ACCOUNT = {
    "type": "object",
    "properties": {"balance": {"type": "integer", "minimum": 0}, "limit": {"type": "integer"}, "name": {"type": "string"}, "segment": {"type": "string", "enum": ["AUTOMOBILE", "BUILDING", "FURNITURE"]}},
    "required": ["balance", "segment"],
}
TIES = [("limit", "gte", "balance"), ("segment", "like", "balance")]


def _accounts(spark: SparkSession, d: str) -> DataFrame:
    """Customers as records with what has failed in them, and a correction."""
    k = F.col("c_custkey")
    record = _text('{"name":"', F.col("c_name"), '","limit":500,"balance":', F.floor("c_acctbal"), ',"segment":"', F.col("c_mktsegment"), '"}')
    fix = F.when(k % 5 == 0, "not json").when(k % 5 == 1, '{"balance":900}').when(k % 5 == 2, '{"segment":"building","balance":"7"}').when(k % 5 == 3, '{"balance":-3,"limit":"1"}').otherwise("{}")
    rows = spread(table(spark, d, "customer")).select("c_custkey", record.alias("record"), fix.alias("fix")).withColumn("v", F.try_parse_json("record"))
    return R.judged(rows, "v", ACCOUNT, TIES, "fields").withColumn("failed", R.failed_fields(F.col("fields")))


def failed_groups(spark: SparkSession, d: str) -> DataFrame:
    """Failed fields of customers by the groups that relations tie, and what to ask for each group."""
    groups = _accounts(spark, d).select("c_custkey", "v", "fields", F.posexplode(R.field_groups(F.col("failed"), TIES)).alias("place", "group"))
    return groups.select("c_custkey", "place", F.array_join("group", ",").alias("fields"), R.selective_prompt(F.lit("account"), F.col("group"), F.col("v"), F.col("fields")).alias("prompt"))


def selective_retries(spark: SparkSession, d: str) -> DataFrame:
    """Customers with failed fields after their corrections."""
    out = R.retried(_accounts(spark, d).where("size(failed) > 0"), "record", "fix", "failed", ACCOUNT, TIES)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return out.select("c_custkey", joined("failed"), F.to_json(F.parse_json("merged")).alias("merged"), joined("merged_fields"), joined("still_failed"), "retry_error")


def parse_failures(spark: SparkSession, d: str) -> DataFrame:
    """Codes of texts that can't be read as they stand, whose keys repeat or whose numbers are too large, by kind."""
    k, n = F.col("event_id"), F.col("event_id").cast("string")
    text = (
        F.when(k % 7 == 0, _text('{"id" ', n, "}")).when(k % 7 == 1, _text('{"id": 1, "id": ', n, "}")).when(k % 7 == 2, _text("{", n, ": 1}")).when(k % 7 == 3, F.concat(F.expr("repeat('[', 520)"), n)).when(k % 7 == 4, F.lit("  "))
        .when(k % 7 == 5, _text("so ", F.col("event_type"))).otherwise(_text('{"id": ', n, ', "x": 1e999, y: nonsense}'))
    )
    schema = {"type": "object", "properties": {"id": {"type": "integer", "minimum": 10}}}
    out = C.checked(spread(table(spark, d, "events")).select("event_id", text.alias("text")), "text", schema)
    rows = out.select((F.col("event_id") % 7).alias("kind"), F.array_join("codes", ",").alias("codes"), "valid", F.col("feedback").isNotNull().alias("asked"))
    return rows.groupBy("kind", "codes", "valid", "asked").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (guarded_attempts, failed_groups, selective_retries, parse_failures)}

_ACCOUNTS = """a AS (SELECT c_custkey, c_custkey % 5 AS m, c_name, floor(c_acctbal)::BIGINT AS b, c_mktsegment AS s, c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') AS odd FROM customer),
  f AS (SELECT *, list_filter([CASE WHEN b < 0 THEN 'balance' END, CASE WHEN b > 500 THEN 'limit' END, CASE WHEN odd THEN 'segment' END], lambda x: x IS NOT NULL) AS failed FROM a)"""
ORACLES = {
    "guarded_attempts": """WITH l AS (SELECT l_orderkey AS k, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem),
      a AS (SELECT *, 20 * place + q % 10 > 50 AS over, q % 7 <> 0 AND q <= 30 AS valid, q % 7 <> 0 AND q > 30 AS fb FROM l WHERE place <= 3),
      t AS (SELECT *, min(place) FILTER (over) OVER (PARTITION BY k) AS late FROM a), u AS (SELECT *, late IS NULL OR place < late AS tried FROM t),
      p AS (SELECT *, min(place) FILTER (valid AND tried) OVER (PARTITION BY k) AS good FROM u),
      g AS (SELECT k, any_value(late) AS late, any_value(good) AS good, count(*) FILTER (tried AND (good IS NULL OR place < good)) AS n, string_agg(CASE WHEN q % 7 = 0 THEN 'P002' ELSE 'V002' END, ',' ORDER BY place) FILTER (tried AND (good IS NULL OR place < good)) AS codes,
        arg_max(fb, place) FILTER (tried AND (good IS NULL OR place < good)) AS fb, max(q) FILTER (place = good) AS q FROM p GROUP BY 1)
      SELECT k AS l_orderkey, CASE WHEN good IS NOT NULL THEN 'passed' WHEN late IS NOT NULL THEN 'timeout' ELSE 'failed' END AS status, n + (good IS NOT NULL)::INT AS attempts, '{"qty":' || q || '}' AS json,
        coalesce(concat_ws(',', codes, CASE WHEN good IS NULL AND late IS NOT NULL THEN 'G002' END, CASE WHEN good IS NULL AND NOT coalesce(fb, false) THEN 'G003' END), '') AS codes, good IS NULL AND coalesce(fb, false) AS asked FROM g""",
    "failed_groups": f"""WITH {_ACCOUNTS}, g AS (SELECT *, CASE WHEN b < 0 AND odd THEN [['balance', 'segment']] ELSE list_transform(failed, lambda x: [x]) END AS groups FROM f),
      e AS (SELECT c_custkey, b, s, generate_subscripts(groups, 1) - 1 AS place, unnest(groups) AS g FROM g)
      SELECT c_custkey, place, list_aggregate(g, 'string_agg', ',') AS fields, E'Fix ONLY these fields. Return a JSON object with corrected values.\\n\\nSchema: account\\n\\nFailed fields:\\n'
        || list_aggregate(list_transform(g, lambda x: '  - ' || x || ': ' || CASE x WHEN 'limit' THEN 'limit must be gte balance' ELSE x END), 'string_agg', chr(10)) || E'\\n\\nCurrent values:\\n'
        || list_aggregate(list_transform(g, lambda x: '  - ' || x || ': ' || CASE x WHEN 'limit' THEN '500' WHEN 'balance' THEN b::VARCHAR ELSE '"' || s || '"' END), 'string_agg', chr(10)) || E'\\n\\nReturn ONLY a JSON object with the corrected fields. No explanation.' AS prompt FROM e""",
    "selective_retries": f"""WITH {_ACCOUNTS}, t AS (SELECT *, list_filter(CASE m WHEN 1 THEN ['balance'] WHEN 2 THEN ['balance', 'segment'] WHEN 3 THEN ['balance', 'limit'] ELSE []::VARCHAR[] END, lambda x: list_contains(failed, x)) AS taken FROM f WHERE len(failed) > 0),
      n AS (SELECT *, CASE WHEN list_contains(taken, 'balance') THEN CASE m WHEN 1 THEN 900 WHEN 2 THEN 7 ELSE -3 END ELSE b END AS nb, CASE WHEN list_contains(taken, 'limit') THEN 1 ELSE 500 END AS nl, CASE WHEN list_contains(taken, 'segment') THEN 'building' ELSE s END AS ns FROM t),
      w AS (SELECT *, list_filter([CASE WHEN nb < 0 THEN 'balance' END, CASE WHEN nb > nl THEN 'limit' END, CASE WHEN upper(ns) NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE') THEN 'segment' END], lambda x: x IS NOT NULL) AS wrong FROM n),
      e AS (SELECT *, CASE WHEN m = 0 THEN 'invalid JSON' WHEN nb > nl AND b <= 500 THEN 'merge introduced new errors: limit' END AS err FROM w)
      SELECT c_custkey, list_aggregate(failed, 'string_agg', ',') AS failed, CASE WHEN err IS NULL THEN '{{"balance":' || CASE WHEN m = 2 AND list_contains(taken, 'balance') THEN '"7"' ELSE nb::VARCHAR END || ',"limit":' || CASE WHEN nl = 1 THEN '"1"' ELSE '500' END || ',"name":"' || c_name || '","segment":"' || ns || '"}}' END AS merged,
        CASE WHEN err IS NULL THEN coalesce(list_aggregate(taken, 'string_agg', ','), '') END AS merged_fields, CASE WHEN err IS NULL THEN coalesce(list_aggregate(wrong, 'string_agg', ','), '') END AS still_failed, err AS retry_error FROM e""",
    "parse_failures": """WITH e AS (SELECT event_id % 7 AS kind, event_id < 10 AS low FROM events)
      SELECT kind, CASE kind WHEN 0 THEN 'P004' WHEN 1 THEN CASE WHEN low THEN 'V002' ELSE '' END WHEN 2 THEN 'P005' WHEN 3 THEN 'P006' WHEN 4 THEN 'P001' WHEN 5 THEN 'P002' ELSE 'P000' END AS codes, kind = 1 AND NOT low AS valid, kind = 1 AND low AS asked, count(*) AS n FROM e GROUP BY 1, 2, 3, 4""",
}
