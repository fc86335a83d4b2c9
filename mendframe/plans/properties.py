"""Schemas as data: each brand's parts as a schema whose properties are part types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import schemas as S
from .tables import table

_KIND = "CASE min(p_partkey) % 4 WHEN 0 THEN 'string' WHEN 1 THEN 'integer' WHEN 2 THEN 'number' ELSE 'boolean' END"


def props(parts: DataFrame) -> DataFrame:
    """Property rows of the parts' schemas."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("string", "integer", "number", "boolean")]), (F.min("p_partkey") % 4 + 1).cast("int"))
    g = parts.groupBy(F.col("p_brand").alias("schema_id"), F.col("p_type").alias("path")).agg(
        kind.alias("type"), F.when(F.min("p_partkey") % 3 == 0, F.lit("email")).alias("format"), F.min("p_size").cast("double").alias("minimum"), F.max("p_size").cast("double").alias("maximum"),
        F.when(F.min("p_partkey") % 5 < 2, F.sort_array(F.collect_set(F.substring_index("p_name", " ", 1)))).alias("values"), (F.min("p_size") < 4).alias("required"),
        F.when(F.min("p_partkey") % 2 == 0, F.min("p_name")).alias("description"), F.lit(None).cast("string").alias("default"),
    )
    limit = lambda c: F.when(F.col("type").isin("integer", "number"), F.col(c)).alias(c)
    return g.select("schema_id", "path", "type", "format", limit("minimum"), limit("maximum"), "values", "required", "description", "default")


def _props_sql(where: str) -> str:
    return f"""(SELECT p_brand AS schema_id, p_type AS path, {_KIND} AS type, CASE WHEN min(p_partkey) % 3 = 0 THEN 'email' END AS format,
      CASE WHEN min(p_partkey) % 4 IN (1, 2) THEN min(p_size)::DOUBLE END AS minimum, CASE WHEN min(p_partkey) % 4 IN (1, 2) THEN max(p_size)::DOUBLE END AS maximum,
      CASE WHEN min(p_partkey) % 5 < 2 THEN list_sort(list(DISTINCT split_part(p_name, ' ', 1))) END AS values, min(p_size) < 4 AS required,
      CASE WHEN min(p_partkey) % 2 = 0 THEN min(p_name) END AS description FROM part WHERE {where} GROUP BY 1, 2)"""


_OLD, _NEW = "p_partkey % 11 <> 0", "p_partkey % 7 <> 0 AND p_size < 48"


def _old(spark: SparkSession, d: str) -> DataFrame:
    return props(table(spark, d, "part").where(_OLD))


def _all(spark: SparkSession, d: str) -> DataFrame:
    return props(table(spark, d, "part"))


def _new(spark: SparkSession, d: str) -> DataFrame:
    return props(table(spark, d, "part").where(_NEW))


def schema_diff(spark: SparkSession, d: str) -> DataFrame:
    """What changes between two versions of each schema."""
    return S.diff(_old(spark, d), _new(spark, d), ["schema_id"]).select("schema_id", "path", "change", "field")


def schema_compatible(spark: SparkSession, d: str) -> DataFrame:
    return S.compatible(S.diff(_old(spark, d), _new(spark, d), ["schema_id"]), ["schema_id"])


def enum_agreement(spark: SparkSession, d: str) -> DataFrame:
    return S.enum_agreement(_all(spark, d))


def facet_agreement(spark: SparkSession, d: str) -> DataFrame:
    return S.facet_agreement(_all(spark, d))


def schema_strictness(spark: SparkSession, d: str) -> DataFrame:
    """Warnings on schemas some of which are text only, need nothing or lack limits."""
    p, text = _all(spark, d), F.col("schema_id").endswith("5")
    limit = lambda c: F.when(~text & (F.col("path") != "PROMO"), F.col(c))
    weak = {"type": F.when(text, "string").otherwise(F.col("type")), "format": F.when(~text, F.col("format")), "values": F.when(~text, F.col("values")), "required": F.col("required") & ~F.col("schema_id").endswith("4"), "minimum": limit("minimum"), "maximum": limit("maximum")}
    return S.strictness(p.withColumns(weak))


def schema_loosening(spark: SparkSession, d: str) -> DataFrame:
    return S.loosening(_old(spark, d), _new(spark, d), ["schema_id"])


def schema_summary(spark: SparkSession, d: str) -> DataFrame:
    return S.summary(_all(spark, d))


def boundary_cases(spark: SparkSession, d: str) -> DataFrame:
    return S.boundary_cases(_all(spark, d))


def catalog_changes(spark: SparkSession, d: str) -> DataFrame:
    """Parts of two catalog snapshots: what is new, updated, unchanged or removed."""
    p = table(spark, d, "part")
    old = p.where("p_partkey % 10 <> 0").select("p_partkey", F.concat_ws("|", "p_name", "p_type").alias("body"))
    new = p.where("p_partkey % 15 <> 0").select("p_partkey", F.concat_ws("|", "p_name", F.when(F.col("p_size") > 40, F.lit("X")).otherwise(F.col("p_type"))).alias("body"))
    return S.changes(old, new, ["p_partkey"], "body")


def catalog_search(spark: SparkSession, d: str) -> DataFrame:
    """The twenty best parts for a keyword."""
    c = table(spark, d, "part").select(F.concat_ws("-", "p_brand", "p_partkey").alias("name"), F.col("p_name").alias("title"), F.col("p_type").alias("description"))
    return S.ranked(c, "ring", 20)


def evolution_proposals(spark: SparkSession, d: str) -> DataFrame:
    """Changes to each brand's schema that its part types' failure rates suggest."""
    part = table(spark, d, "part")
    runs = part.groupBy(F.col("p_brand").alias("schema_id")).agg(F.count("*").alias("runs"))
    fails = part.groupBy(F.col("p_brand").alias("schema_id"), F.col("p_type").alias("path")).agg((F.count("*") + F.min("p_size")).alias("n"))
    return S.evolution(_all(spark, d), fails.join(runs, "schema_id"), 5)


def evolved_schemas(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions and defaults of each brand's schema after the proposals that need no approval."""
    return S.evolved(_all(spark, d), evolution_proposals(spark, d)).select("schema_id", "path", "description", "default")


def inferred_schema(spark: SparkSession, d: str) -> DataFrame:
    """Types of the fields of event props and values, over events as samples."""
    e = table(spark, d, "events")
    values = e.select(F.col("event_id").alias("sample"), F.explode(F.array(
        F.struct(F.lit("props.k").alias("path"), F.when(F.get_json_object("props", "$.k").rlike(r"^-?\d+$"), "integer").otherwise("string").alias("type")),
        F.struct(F.lit("value").alias("path"), F.when(F.col("value") == F.floor("value"), "integer").otherwise("number").alias("type")),
        F.struct(F.when(F.col("user_id") % 2 == 0, F.lit("user")).alias("path"), F.lit("integer").alias("type")),
    )).alias("x")).select("sample", "x.*").where("path is not null")
    return S.inferred(values)


def schema_version(spark: SparkSession, d: str) -> DataFrame:
    """The version of each nation's schema that is current after pushes and rollbacks."""
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("store"), F.row_number().over(_by_nation()).alias("version"), "c_name")
    pushes = c.select("store", (F.col("version") * 2).alias("seq"), "version")
    rollbacks = c.where("version % 3 = 0").select("store", (F.col("version") * 2 + 1).alias("seq"), (F.col("version") - 1).alias("version"))
    return S.current_version(c, pushes.unionByName(rollbacks))


def _by_nation():
    from pyspark.sql import Window

    return Window.partitionBy("c_nationkey").orderBy("c_custkey")


def trace_analysis(spark: SparkSession, d: str) -> DataFrame:
    """Failure rates, commonest failures and stalls of each user's last 20 events; errors are failures by the hundreds of their value."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "error", F.concat(F.lit("F"), F.floor(F.col("value") / 100).cast("string"))).alias("message"))
    return S.trace_analysis(e, ["user_id"], "event_id", 20)


def tool_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as callable tools, in both layouts."""
    f = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.concat(F.lit("supplier of nation "), F.col("s_nationkey").cast("string")).alias("description"), F.format_string('{"type":"object","maximum":%d}', F.floor("s_acctbal").cast("long")).alias("parameters"))
    return S.tool_rows(f, "nested").select("name", F.lit("nested").alias("layout"), "tool").unionByName(S.tool_rows(f, "flat").select("name", F.lit("flat").alias("layout"), "tool"))


def similar_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with cosine above 0.3 to each of the vectors whose id is divisible by 20, against all vectors."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return S.similar(e.where("id % 20 = 0"), e, 0.3).select("a", "b", F.round("similarity", 5).alias("similarity"))


def _bodies(spark: SparkSession, d: str) -> DataFrame:
    """A schema text for each nation: a reference, parts laid over each other, a list, an object, and no root type for some."""
    k = F.col("n_nationkey")
    address = '"$defs":{"A":{"type":"object","properties":{"zip":{"type":"string","format":"uuid"},"no":{"type":"integer","minimum":1}},"required":["zip"]}}'
    root = F.when(k % 4 == 0, "").otherwise('"type":"object",')
    low, kind = (k % 3).cast("string"), F.when(k % 5 == 0, "string").otherwise("number")
    tags = F.when(k % 2 == 0, '{"type":"array"}').otherwise('{"type":"array","items":{"type":"string"}}')
    more = F.when(k % 3 == 0, '{"type":"object"}').otherwise('{"allOf":[{"properties":{"x":{"enum":["a",1]}},"required":["x"]},{"properties":{"y":{"type":"boolean"}}}]}')
    body = F.concat(F.lit("{"), root, F.lit(address), F.lit(',"properties":{"addr":{"$ref":"#/$defs/A"},"price":{"type":"'), kind, F.lit('","minimum":'), low, F.lit('},"tags":'), tags, F.lit(',"more":'), more, F.lit('},"required":["price"]}'))
    return table(spark, d, "nation").select(F.format_string("n%02d", "n_nationkey").alias("schema_id"), F.when(k == 7, "{").otherwise(body).alias("body"))


def schema_rows(spark: SparkSession, d: str) -> DataFrame:
    """Properties of schema texts, references followed and parts laid over each other."""
    return S.flat_properties(_bodies(spark, d)).select("schema_id", "path", "type", "format", "minimum", F.array_join("values", ",").alias("values"), "required")


def schema_agreement(spark: SparkSession, d: str) -> DataFrame:
    """What schema texts agree on: from text to facets by path."""
    return S.facet_agreement(S.flat_properties(_bodies(spark, d)))


def shape_warnings(spark: SparkSession, d: str) -> DataFrame:
    return S.shape_warnings(_bodies(spark, d))


QUERIES = {f.__name__: f for f in (schema_diff, schema_compatible, enum_agreement, facet_agreement, schema_strictness, schema_loosening, schema_summary, boundary_cases, catalog_changes, catalog_search, evolution_proposals, inferred_schema, schema_version, trace_analysis, tool_definitions, similar_vectors, evolved_schemas, schema_rows, schema_agreement, shape_warnings)}
_BOTH = f"WITH o AS {_props_sql(_OLD)}, n AS {_props_sql(_NEW)}"
_DIFF = f"""{_BOTH}, j AS (SELECT coalesce(o.schema_id, n.schema_id) AS schema_id, coalesce(o.path, n.path) AS path, o.type AS ot, n.type AS nt, o, n FROM o FULL JOIN n ON o.schema_id = n.schema_id AND o.path = n.path),
  d AS (SELECT schema_id, path, 'removed' AS change, NULL AS field FROM j WHERE nt IS NULL UNION ALL SELECT schema_id, path, 'added', NULL FROM j WHERE ot IS NULL
    UNION ALL SELECT schema_id, path, 'changed', unnest(list_filter([CASE WHEN o.type IS DISTINCT FROM n.type THEN 'type' END, CASE WHEN o.format IS DISTINCT FROM n.format THEN 'format' END, CASE WHEN o.minimum IS DISTINCT FROM n.minimum THEN 'minimum' END,
      CASE WHEN o.maximum IS DISTINCT FROM n.maximum THEN 'maximum' END, CASE WHEN o.values IS DISTINCT FROM n.values THEN 'values' END, CASE WHEN o.description IS DISTINCT FROM n.description THEN 'description' END], lambda x: x IS NOT NULL)) FROM j WHERE ot IS NOT NULL AND nt IS NOT NULL)"""
_FACETS = """, f AS (SELECT path, 'minimum' AS facet, count(minimum) AS n, count(*) AS total, max(minimum) - min(minimum) <= 2.3e-16 AS universal, min(minimum)::VARCHAR AS value FROM p GROUP BY 1
      UNION ALL SELECT path, 'maximum', count(maximum), count(*), max(maximum) - min(maximum) <= 2.3e-16, min(maximum)::VARCHAR FROM p GROUP BY 1
      UNION ALL SELECT path, 'format', count(format), count(*), count(DISTINCT format) = 1, min(format) FROM p GROUP BY 1 UNION ALL SELECT path, 'type', count(type), count(*), count(DISTINCT type) = 1, min(type) FROM p GROUP BY 1
      UNION ALL SELECT path, 'required', count(*) FILTER (WHERE required), count(*), bool_and(required), NULL FROM p GROUP BY 1)
      SELECT path, facet, n, total, universal, CASE WHEN universal THEN value END AS value FROM f WHERE n > 0 OR facet = 'required'"""
_P = f"WITH p AS {_props_sql('true')}"
_EVOLVED = f"""{_P}, f AS (SELECT p_brand AS schema_id, p_type AS path, count(*) + min(p_size) AS n FROM part GROUP BY 1, 2), u AS (SELECT p_brand AS schema_id, count(*) AS runs FROM part GROUP BY 1),
      r AS (SELECT p.*, n / runs::DOUBLE AS rate FROM p JOIN f USING (schema_id, path) JOIN u USING (schema_id) WHERE runs >= 5),
      e AS (SELECT schema_id, path, rate, 'DescriptionEnrich' AS kind, 'Auto' AS approval FROM r WHERE rate >= 0.1 AND description IS NULL UNION ALL SELECT schema_id, path, rate, 'DefaultAdd', 'Auto' FROM r WHERE rate >= 0.2 UNION ALL SELECT schema_id, path, rate, 'EnumAdd', 'Async' FROM r WHERE rate >= 0.3 AND values IS NOT NULL
      UNION ALL SELECT schema_id, path, rate, 'RangeExpand', 'Async' FROM r WHERE rate >= 0.4 AND minimum IS NOT NULL UNION ALL SELECT schema_id, path, rate, 'TypeChange', 'Sync' FROM r WHERE rate >= 0.5)"""
_BODIES = """WITH k AS (SELECT n_nationkey AS k, 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS schema_id FROM nation WHERE n_nationkey <> 7),
      p AS (SELECT schema_id, 'addr.no' AS path, 'integer' AS type, NULL AS format, 1.0 AS minimum, NULL::DOUBLE AS maximum, NULL AS values, false AS required FROM k UNION ALL SELECT schema_id, 'addr.zip', 'string', 'uuid', NULL, NULL, NULL, true FROM k
      UNION ALL SELECT schema_id, 'price', CASE WHEN k % 5 = 0 THEN 'string' ELSE 'number' END, NULL, (k % 3)::DOUBLE, NULL, NULL, true FROM k UNION ALL SELECT schema_id, 'tags', 'array', NULL, NULL, NULL, NULL, false FROM k
      UNION ALL SELECT schema_id, 'more', 'object', NULL, NULL, NULL, NULL, false FROM k WHERE k % 3 = 0 UNION ALL SELECT schema_id, 'more.x', NULL, NULL, NULL, NULL, 'a,1', true FROM k WHERE k % 3 <> 0 UNION ALL SELECT schema_id, 'more.y', 'boolean', NULL, NULL, NULL, NULL, false FROM k WHERE k % 3 <> 0)"""
ORACLES = {
    "schema_rows": f"{_BODIES} SELECT schema_id, path, type, format, minimum, values, required FROM p",
    "schema_agreement": f"{_BODIES} {_FACETS}",
    "shape_warnings": """WITH k AS (SELECT n_nationkey AS k, 'n' || lpad(n_nationkey::VARCHAR, 2, '0') AS schema_id FROM nation WHERE n_nationkey <> 7)
      SELECT schema_id, 'S007' AS code, 'Block' AS severity, '$' AS path FROM k WHERE k % 4 = 0 UNION ALL SELECT schema_id, 'S004', 'Warn', '$.tags' FROM k WHERE k % 2 = 0 UNION ALL SELECT schema_id, 'S008', 'Warn', '$.more' FROM k WHERE k % 3 = 0""",
    "schema_diff": f"{_DIFF} SELECT * FROM d",
    "schema_compatible": f"{_DIFF} SELECT schema_id, count(*) AS n_changes, bool_and(change = 'added' OR coalesce(field = 'description', false)) AS compatible FROM d GROUP BY 1",
    "enum_agreement": f"""{_P}, v AS (SELECT path, schema_id, unnest(values) AS value FROM p WHERE values IS NOT NULL), n AS (SELECT path, count(DISTINCT schema_id) AS n_schemas FROM v GROUP BY 1), h AS (SELECT path, value, count(DISTINCT schema_id) AS held FROM v GROUP BY 1, 2)
      SELECT path, n_schemas, string_agg(value, ',' ORDER BY value) AS all_values, coalesce(string_agg(value, ',' ORDER BY value) FILTER (WHERE held = n_schemas), '') AS common_values FROM h JOIN n USING (path) GROUP BY 1, 2""",
    "facet_agreement": f"{_P} {_FACETS}",
    "schema_strictness": f"""WITH q AS {_props_sql('true')}, p AS (SELECT schema_id, path, CASE WHEN schema_id LIKE '%5' THEN 'string' ELSE type END AS type, CASE WHEN schema_id NOT LIKE '%5' THEN format END AS format, CASE WHEN schema_id NOT LIKE '%5' THEN values END AS values,
        required AND schema_id NOT LIKE '%4' AS required, CASE WHEN schema_id NOT LIKE '%5' AND path <> 'PROMO' THEN minimum END AS minimum, CASE WHEN schema_id NOT LIKE '%5' AND path <> 'PROMO' THEN maximum END AS maximum FROM q), w AS (SELECT schema_id, count(*) AS n, count(*) FILTER (WHERE required) AS needed, count(*) FILTER (WHERE type = 'string') AS strings, count(*) FILTER (WHERE type = 'string' AND format IS NULL AND values IS NULL) AS free FROM p GROUP BY 1)
      SELECT schema_id, 'S001' AS code, 'Block' AS severity, '$' AS path FROM w WHERE n >= 3 AND needed = 0 UNION ALL SELECT schema_id, 'S002', 'Block', '$' FROM w WHERE n >= 3 AND strings >= 3 AND free = strings
      UNION ALL SELECT schema_id, 'S005', 'Block', '$' FROM w WHERE n >= 3 AND strings = n UNION ALL SELECT schema_id, 'S003', 'Warn', '$.' || path FROM p WHERE type IN ('number', 'integer') AND minimum IS NULL AND maximum IS NULL
      UNION ALL SELECT schema_id, 'S006', 'Warn', '$.' || path FROM p WHERE len(values) >= 50""",
    "schema_loosening": f"""{_BOTH}, j AS (SELECT coalesce(o.schema_id, n.schema_id) AS schema_id, coalesce(o.path, n.path) AS path, o, n, o.type IS NOT NULL AS was, n.type IS NOT NULL AS is_ FROM o FULL JOIN n ON o.schema_id = n.schema_id AND o.path = n.path)
      SELECT schema_id, 'L001' AS code, 'Block' AS severity, '$.' || path AS path FROM j WHERE coalesce(o.required, false) AND NOT coalesce(n.required, false)
      UNION ALL SELECT schema_id, 'L003', 'Warn', '$.' || path FROM j WHERE was AND is_ AND o.format IS NOT NULL AND n.format IS NULL UNION ALL SELECT schema_id, 'L004', 'Warn', '$.' || path FROM j WHERE n.minimum < o.minimum OR n.maximum > o.maximum
      UNION ALL SELECT schema_id, 'L005', 'Block', '$.' || path FROM j WHERE o.type IN ('integer', 'number', 'boolean') AND n.type = 'string'
      UNION ALL SELECT schema_id, 'L006', 'Warn', '$.' || path FROM j WHERE NOT was AND n.format IS NULL AND n.values IS NULL AND n.minimum IS NULL AND n.maximum IS NULL
      UNION ALL SELECT schema_id, 'L007', 'Block', '$' FROM j GROUP BY 1 HAVING count(*) FILTER (WHERE o.required) > 0 AND 2 * count(*) FILTER (WHERE n.required) <= count(*) FILTER (WHERE o.required)""",
    "schema_summary": f"""{_P} SELECT schema_id, string_agg(t, ', ' ORDER BY t) AS summary FROM (SELECT schema_id, path || '(' || concat_ws(', ', type, CASE WHEN minimum IS NOT NULL THEN minimum::BIGINT || '-' || maximum::BIGINT END, CASE WHEN required THEN 'required' END) || ')' AS t FROM p) GROUP BY 1""",
    "boundary_cases": f"""{_P} SELECT schema_id, path, minimum::BIGINT::VARCHAR AS value, true AS valid, 'min' AS kind FROM p WHERE minimum IS NOT NULL UNION ALL SELECT schema_id, path, (minimum::BIGINT - 1)::VARCHAR, false, 'min-1' FROM p WHERE minimum IS NOT NULL
      UNION ALL SELECT schema_id, path, (minimum::BIGINT + 1)::VARCHAR, true, 'min+1' FROM p WHERE minimum IS NOT NULL UNION ALL SELECT schema_id, path, maximum::BIGINT::VARCHAR, true, 'max' FROM p WHERE maximum IS NOT NULL
      UNION ALL SELECT schema_id, path, (maximum::BIGINT + 1)::VARCHAR, false, 'max+1' FROM p WHERE maximum IS NOT NULL UNION ALL SELECT schema_id, path, (maximum::BIGINT - 1)::VARCHAR, true, 'max-1' FROM p WHERE maximum IS NOT NULL
      UNION ALL SELECT schema_id, path, unnest(values), true, 'enum' FROM p WHERE values IS NOT NULL UNION ALL SELECT schema_id, path, '__INVALID__', false, 'not_in_enum' FROM p WHERE values IS NOT NULL UNION ALL SELECT schema_id, path, '', false, 'empty' FROM p WHERE values IS NOT NULL
      UNION ALL SELECT schema_id, path, unnest(['true', 'false']), true, 'boolean' FROM p WHERE type = 'boolean' UNION ALL SELECT schema_id, path, NULL, false, 'absent' FROM p WHERE required UNION ALL SELECT schema_id, path, 'present_value', true, 'present' FROM p WHERE required""",
    "catalog_changes": """WITH a AS (SELECT p_partkey, p_name || '|' || p_type AS body FROM part WHERE p_partkey % 10 <> 0), b AS (SELECT p_partkey, p_name || '|' || CASE WHEN p_size > 40 THEN 'X' ELSE p_type END AS body FROM part WHERE p_partkey % 15 <> 0)
      SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, CASE WHEN a.body IS NULL THEN 'New' WHEN b.body IS NULL THEN 'Removed' WHEN a.body = b.body THEN 'Unchanged' ELSE 'Updated' END AS status FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""",
    "catalog_search": """SELECT * FROM (SELECT p_brand || '-' || p_partkey AS name, p_name AS title, CASE WHEN contains(lower(p_brand || '-' || p_partkey), 'ring') THEN 3 WHEN contains(lower(p_name), 'ring') THEN 2 WHEN contains(lower(p_type), 'ring') THEN 1 END AS score FROM part) WHERE score IS NOT NULL ORDER BY score DESC, name LIMIT 20""",
    "evolution_proposals": f"{_EVOLVED} SELECT * FROM e",
    "evolved_schemas": f"""{_EVOLVED}, a AS (SELECT schema_id, path, bool_or(kind = 'DescriptionEnrich') AS said, bool_or(kind = 'DefaultAdd') AS filled FROM e WHERE approval = 'Auto' GROUP BY 1, 2)
      SELECT schema_id, path, CASE WHEN said THEN coalesce(description, 'The ' || path) ELSE description END AS description, CASE WHEN filled THEN CASE WHEN type IN ('integer', 'number') THEN '0' WHEN type = 'boolean' THEN 'false' ELSE '' END END AS "default" FROM p LEFT JOIN a USING (schema_id, path)""",
    "inferred_schema": """WITH v AS (SELECT event_id AS sample, 'props.k' AS path, 'integer' AS type FROM events UNION ALL SELECT event_id, 'value', CASE WHEN value = floor(value) THEN 'integer' ELSE 'number' END FROM events UNION ALL SELECT event_id, 'user', 'integer' FROM events WHERE user_id % 2 = 0)
      SELECT path, min_by(type, sample) AS type, count(DISTINCT sample) AS n, count(DISTINCT sample) = (SELECT count(DISTINCT sample) FROM v) AS required FROM v GROUP BY 1""",
    "schema_version": """WITH c AS (SELECT c_nationkey AS store, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey)::INT AS version, c_name FROM customer), p AS (SELECT store, version * 2 AS seq, version FROM c UNION ALL SELECT store, version * 2 + 1, version - 1 FROM c WHERE version % 3 = 0), l AS (SELECT store, max_by(version, seq) AS version FROM p GROUP BY 1)
      SELECT store, version, c_name FROM c JOIN l USING (store, version)""",
    "trace_analysis": """WITH e AS (SELECT user_id, event_id, CASE WHEN event_type = 'error' THEN 'F' || floor(value / 100)::BIGINT END AS message FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS nth FROM e),
      k AS (SELECT user_id, count(*) AS total_runs, avg((message IS NOT NULL)::INT) AS failure_rate, count(*) FILTER (WHERE nth <= 3 AND message IS NOT NULL) = 3 AND count(DISTINCT message) FILTER (WHERE nth <= 3) = 1 AS stalled FROM r WHERE nth <= 20 GROUP BY 1),
      m AS (SELECT user_id, message, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, message DESC) AS i FROM e WHERE message IS NOT NULL GROUP BY 1, 2)
      SELECT k.user_id, total_runs, failure_rate, stalled, m.message AS most_failed FROM k LEFT JOIN m ON k.user_id = m.user_id AND i = 1""",
    "tool_definitions": """WITH f AS (SELECT s_name, 'supplier of nation ' || s_nationkey AS d, '{"type":"object","maximum":' || floor(s_acctbal)::BIGINT || '}' AS p FROM supplier)
      SELECT s_name AS name, 'nested' AS layout, '{"type":"function","function":{"name":"' || s_name || '","description":"' || d || '","parameters":' || p || '}}' AS tool FROM f UNION ALL SELECT s_name, 'flat', '{"name":"' || s_name || '","description":"' || d || '","input_schema":' || p || '}' FROM f""",
    "similar_vectors": "SELECT a, b, round(s, 5) AS similarity FROM (SELECT q.vec_id AS a, r.vec_id AS b, list_cosine_similarity(q.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0) WHERE s > 0.3",
}


_CHAIN = [("ECONOMY", "lt", "LARGE"), ("LARGE", "lte", "MEDIUM"), ("PROMO", "gt", "MEDIUM"), ("SMALL", "eq", "STANDARD")]


def rule_consistency(spark: SparkSession, d: str) -> DataFrame:
    """Bounds of each brand's part types under a chain of relations."""
    from ..operators.consistency import consistency

    bounds = table(spark, d, "part").groupBy(F.col("p_brand").alias("schema_id"), F.col("p_type").alias("path")).agg(F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("hi"))
    chain = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(("a", "op", "b"), row, strict=True)]) for row in _CHAIN])
    return consistency(bounds, bounds.select("schema_id").distinct().select("schema_id", F.inline(chain)))


QUERIES["rule_consistency"] = rule_consistency
_PASS = """b{n} AS (SELECT schema_id, path, max(lo) AS lo, min(hi) AS hi FROM (SELECT * FROM b{m} UNION ALL SELECT schema_id, high, lo + gap, NULL FROM b{m} JOIN e ON path = low UNION ALL SELECT schema_id, low, NULL, hi - gap FROM b{m} JOIN e ON path = high) GROUP BY 1, 2)"""
ORACLES["rule_consistency"] = (
    "WITH e(low, high, gap) AS (VALUES ('ECONOMY', 'LARGE', 1), ('LARGE', 'MEDIUM', 0), ('MEDIUM', 'PROMO', 1), ('SMALL', 'STANDARD', 0), ('STANDARD', 'SMALL', 0)), "
    "b0 AS (SELECT p_brand AS schema_id, p_type AS path, min(p_size)::DOUBLE AS lo, max(p_size)::DOUBLE AS hi FROM part GROUP BY 1, 2), "
    + ", ".join(_PASS.format(n=i + 1, m=i) for i in range(3))
    + " SELECT *, coalesce(lo <= hi, true) AS consistent, CASE WHEN coalesce(lo <= hi, true) THEN CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 ELSE coalesce(lo, hi) END END AS witness FROM b3"
)
