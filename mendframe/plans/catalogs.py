"""Diagnostics, partial schemas, cases on relations and similar fields, from brands and part names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalogs as C
from ..operators import packages as P
from .packages import _BRANDS, _brand_packages
from .tables import table


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """Brands' packages; of every seventh there is none, of every eleventh only the beginning."""
    n = F.substring_index("p_brand", "#", -1).cast("int")
    return _brand_packages(spark, d).withColumn("text", F.when(n % 11 == 0, F.substring("text", 1, 30)).when(n % 7 != 0, F.col("text")))


def schema_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """What is wrong with brands' schemas, in words and as JSON."""
    out = C.diagnostics(P.loaded(_texts(spark, d), "text"), "p_brand")
    return out.select("p_brand", "code", C.as_text().alias("words"), C.as_json().alias("json"))


def partial_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Brands' schemas with nothing required."""
    return P.loaded(_brand_packages(spark, d), "text").select("p_brand", C.partial(F.col("schema")).alias("schema"))


def relation_cases(spark: SparkSession, d: str) -> DataFrame:
    """Records on both sides of relations between part types of a brand."""
    types = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_type").alias("field_a"), F.max("p_type").alias("field_b"), (F.max("p_partkey") % 4).alias("m"))
    return C.relation_cases(types.select("p_brand", "field_a", F.element_at(F.array(*map(F.lit, ("lte", "gte", "eq", "lt"))), (F.col("m") + 1).cast("int")).alias("operator"), "field_b"))


def similar_fields(spark: SparkSession, d: str) -> DataFrame:
    """Part names and brands as field names, in different spellings, that might be one field."""
    p = table(spark, d, "part")
    names = p.select(F.explode(F.array("p_name", F.replace("p_name", F.lit(" "), F.lit("_")), F.concat("p_brand", F.lit(" "), "p_type"))).alias("name")).distinct()
    return C.unifiable(names.select("name", C.name_vector(F.col("name")).alias("vector")), 0.893)


QUERIES = {f.__name__: f for f in (schema_diagnostics, partial_schemas, relation_cases, similar_fields)}

_HELP3 = 'The schema does not define a "type" field at the root.\\nThis means any JSON value will pass validation.\\nAdd "type": "object" (or array/string/etc) to constrain.'
_HELP4 = 'Without "required", all properties are optional.\\nLLMs may omit fields. Add a "required" array with essential field names.'
_HELP2 = "Regenerate the schema from your type definitions.\\nDo not manually edit generated schema files."
ORACLES = {
    "schema_diagnostics": f"""WITH {_BRANDS}, d AS (
        SELECT p_brand, 'S001' AS code, 'error' AS severity, 'Cannot read schema' AS message, 'Ensure the schema exists and is readable.' AS help, NULL AS context FROM b WHERE n % 7 = 0 AND n % 11 <> 0
        UNION ALL SELECT p_brand, 'S002', 'error', 'Schema is not valid JSON', E'{_HELP2}', 'schema: ' || p_brand FROM b WHERE n % 11 = 0
        UNION ALL SELECT p_brand, 'S003', 'warning', 'Schema has no top-level type constraint', E'{_HELP3}', NULL FROM b WHERE n % 7 <> 0 AND n % 11 <> 0 AND n % 5 = 0
        UNION ALL SELECT p_brand, 'S004', 'warning', 'Schema has properties but no "required" array', E'{_HELP4}', NULL FROM b WHERE n % 7 <> 0 AND n % 11 <> 0 AND n % 3 = 0)
      SELECT p_brand, code, '[' || severity || '][' || code || '] ' || message || coalesce(chr(10) || '  context: ' || context, '') || chr(10) || '  help: ' || help AS words,
        '{{"code":' || to_json(code)::VARCHAR || ',"context":' || coalesce(to_json(context)::VARCHAR, 'null') || ',"help":' || to_json(help)::VARCHAR || ',"message":' || to_json(message)::VARCHAR || ',"severity":' || to_json(severity)::VARCHAR || '}}' AS json FROM d""",
    "partial_schemas": f"""WITH {_BRANDS} SELECT p_brand, '{{"properties":{{"name":{{"type":"string"}},"size":' || CASE WHEN n % 4 = 3 THEN '{{}}' ELSE '{{"maximum":' || most || ',"type":"integer"}}' END || ',"type":{{"enum":[' || coalesce(list_aggregate(list_transform(types, lambda x: '"' || x || '"'), 'string_agg', ','), '') || ']}}}}'
      || CASE WHEN n % 5 = 0 THEN '' ELSE ',"type":"object"' END || '}}' AS schema FROM b""",
    "relation_cases": """WITH t AS (SELECT p_brand, min(p_type) AS a, max(p_type) AS b, ['lte', 'gte', 'eq', 'lt'][(max(p_partkey) % 4 + 1)::INT] AS op FROM part GROUP BY 1),
      s AS (SELECT *, CASE WHEN op = 'gte' THEN b ELSE a END AS x, CASE WHEN op = 'gte' THEN a ELSE b END AS y FROM t WHERE op <> 'lt'),
      c AS (SELECT * FROM s, (VALUES (false, 10, '==', 'boundary', true), (false, 11, '>', 'violation', false), (false, 9, '<', 'safe', true), (true, 10, '==', 'correct', true), (true, 11, '!=', 'violation +1', false), (true, 9, '!=', 'violation -1', false)) v(eq, n, sign, said, valid) WHERE eq = (op = 'eq'))
      SELECT p_brand, a AS field_a, op AS operator, b AS field_b, x || ',' || y AS field, '{"' || x || '":' || n || ',"' || y || '":10}' AS value, x || sign || y || ' (' || said || ')' AS description, valid FROM c""",
    "similar_fields": """WITH f AS (SELECT DISTINCT unnest([p_name, replace(p_name, ' ', '_'), p_brand || ' ' || p_type]) AS name FROM part),
      g AS (SELECT name, ('0x' || substr(md5(substr(t, i, 3)), 1, 4))::INT % 64 AS d FROM (SELECT name, '^' || lower(name) || '$' AS t, unnest(range(1, greatest(length(name), 1) + 1)) AS i FROM f)),
      c AS (SELECT name, d, count(*)::DOUBLE AS n FROM g GROUP BY 1, 2), l AS (SELECT name, sqrt(sum(n * n)) AS l, string_agg(d || ':' || n, ',' ORDER BY d) AS v FROM c GROUP BY 1), k AS (SELECT min(name) AS name, any_value(l) AS l FROM l GROUP BY v),
      p AS (SELECT x.name AS a, y.name AS b, sum(x.n * y.n) / any_value(j.l) / any_value(k.l) AS s FROM c x JOIN c y ON x.d = y.d AND x.name < y.name JOIN k j ON j.name = x.name JOIN k ON k.name = y.name GROUP BY 1, 2)
      SELECT a || ' ~ ' || b AS field_pattern, printf('semantically similar fields (cosine=%.2f), consider unifying', s) AS description FROM p WHERE s >= 0.893""",
}
