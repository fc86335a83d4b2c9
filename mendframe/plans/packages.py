"""Recursive records, evaluated names, and schemas that come from tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nested as N
from ..operators.feedback import record_feedback
from ..operators.fields import extracted_from
from ..operators import packages as P
from ..operators import walk as W
from .tables import table

TREE = {
    "$ref": "#/$defs/Node",
    "$defs": {"Node": {"type": "object", "required": ["v"], "properties": {"v": {"type": "integer", "maximum": 45}, "left": {"$ref": "#/$defs/Node"}, "right": {"$ref": "#/$defs/Node"}}, "additionalProperties": False}},
}


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _trees(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines as a tree: each line leads right to the next one and left down as many nodes as its quantity; lines 3 and 7 end in a node without value."""
    line = table(spark, d, "lineitem")
    rows = line.select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.col("l_quantity").cast("int").alias("q")).alias("x"))
    lines = rows.groupBy("l_orderkey").agg(F.reverse(F.sort_array(F.collect_list("x"))).alias("lines"))  # as many as an order has
    end = lambda x: F.when(x["l_linenumber"] % 4 == 3, "{}").otherwise('{"v":1}')
    deep = lambda x: F.concat(F.repeat(F.lit('{"v":1,"left":'), x["q"] - 1), end(x), F.repeat(F.lit("}"), x["q"] - 1))  # noqa: E731, texts are made after the shuffle
    node = lambda rest, x: _text('{"v":', x["q"], ',"left":', deep(x), F.when(rest == "", "").otherwise(F.concat(F.lit(',"right":'), rest)), "}")
    return lines.select("l_orderkey", F.aggregate("lines", F.lit(""), node).alias("text"))


def tree_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every error of every order as a tree, by a schema that holds itself twice."""
    out = N.validated_json(_trees(spark, d), "text", TREE)
    return out.select("l_orderkey", F.explode("errors").alias("e")).select("l_orderkey", "e.path", "e.expected")


STATES = {
    "type": "object",
    "allOf": [{"properties": {"id": {"type": "integer"}, "status": {"type": "string"}}}],
    "oneOf": [
        {"properties": {"status": {"const": "F"}, "closed": {"type": "string"}}, "required": ["status"]},
        {"properties": {"status": {"const": "O"}, "due": {"type": "string"}}, "required": ["status"]},
        {"properties": {"status": {"enum": ["P"]}}, "required": ["status"], "dependentSchemas": {"part": {"properties": {"part": True, "of": True}}}},
    ],
    "if": {"properties": {"id": {"multipleOf": 3}}},
    "then": {"properties": {"third": {"type": "boolean"}}},
    "properties": {"tags": {"type": "array", "prefixItems": [{"type": "string"}], "contains": {"type": "null"}, "minContains": 0, "unevaluatedItems": {"type": "integer"}}},
    "unevaluatedProperties": False,
}


def unevaluated_errors(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose fields are known by status only: what no part of the schema has looked at."""
    k, p = F.col("o_orderkey"), F.col("o_orderpriority")
    extra = F.when(k % 4 == 0, ',"closed":"x"').when(k % 4 == 1, ',"due":"x"').when(k % 4 == 2, ',"part":1,"of":2').otherwise(',"of":2')
    third = F.when(k % 5 == 0, ',"third":true').otherwise("")
    tags = F.when(k % 7 == 0, ',"tags":["a",null,1]').when(k % 7 == 1, ',"tags":["a",2,"b"]').when(k % 7 == 2, _text(',"tags":["', p, '",null,true]')).otherwise("")
    text = _text('{"id":', k, ',"status":"', F.col("o_orderstatus"), '"', extra, third, tags, "}")
    out = N.validated_json(table(spark, d, "orders").select("o_orderkey", text.alias("text")), "text", STATES)
    return out.select("o_orderkey", F.explode("errors").alias("e")).select("o_orderkey", "e.path", "e.expected", F.coalesce("e.description", F.lit("")).alias("description"))


def _brand_packages(spark: SparkSession, d: str) -> DataFrame:
    """A package a brand, made of its parts: sizes up to the rounded mean and half of it again, types but those of few letters, and the smallest, the largest and a nameless part as counterexamples."""
    part = table(spark, d, "part")
    named = F.struct("p_size", "p_partkey")
    g = part.groupBy("p_brand").agg(
        F.floor(F.avg("p_size") * 1.5).cast("int").alias("most"), F.sort_array(F.collect_set(F.when(F.length("p_type") > 5, F.col("p_type")))).alias("types"), F.min(named).alias("low"), F.max(named).alias("high"),
    )
    n = F.substring_index("p_brand", "#", -1).cast("int")
    size = F.when(n % 4 == 3, '"size":{}').otherwise(_text('"size":{"type":"integer","maximum":', F.col("most"), "}"))
    schema = _text("{", F.when(n % 5 == 0, "").otherwise('"type":"object",'), F.when(n % 3 == 0, "").otherwise('"required":["name"],'), '"properties":{', size, ',"name":{"type":"string"},"type":{"enum":', F.to_json("types"), "}}}")
    one = lambda x: _text('{"name":"part ', x["p_partkey"], '","size":', x["p_size"], "}")
    package = _text('{"schema":', schema, ',"relations":[{"field_a":"size","operator":"lte","field_b":"most"},{"field_a":1}],"counterexamples":[', one(F.col("low")), ",", one(F.col("high")), ',{"size":1}]}')
    return g.select("p_brand", package.alias("text"))


def package_findings(spark: SparkSession, d: str) -> DataFrame:
    """Lint of every brand's package and the counterexamples that it lets pass."""
    return P.findings(P.loaded(_brand_packages(spark, d), "text"), "p_brand")


def package_parts(spark: SparkSession, d: str) -> DataFrame:
    """Relations and numbers of counterexamples that each package holds."""
    return P.loaded(_brand_packages(spark, d), "text").select("p_brand", "package", F.size("relations").alias("relations"), F.size("rules").alias("rules"), F.size("counterexamples").alias("counterexamples"))


def catalog_errors(spark: SparkSession, d: str) -> DataFrame:
    """Errors of all parts, each by its own brand's schema, by brand, path and what was expected."""
    schemas = P.loaded(_brand_packages(spark, d), "text").select("p_brand", "schema")
    name = F.when(F.col("p_partkey") % 6 == 0, "").otherwise(_text('"name":"', F.col("p_name"), '",'))
    text = _text("{", name, '"size":', F.col("p_size"), ',"type":"', F.col("p_type"), '"}')
    out = W.validated_by(table(spark, d, "part").select("p_brand", text.alias("text")), "text", "p_brand", schemas)
    return out.select("p_brand", F.explode("errors").alias("e")).groupBy("p_brand", "e.path", "e.expected").agg(F.count("*").alias("n"))


PACKED = {
    "type": "object",
    "required": ["id", "total"],
    "properties": {"id": {"type": "integer"}, "status": {"enum": ["O", "F"]}, "items": {"type": "array", "minItems": 2, "items": {"properties": {"n": {"maximum": 6}, "qty": {"minimum": 5}}}}},
}


def _packed(spark: SparkSession, d: str) -> DataFrame:
    """o_orderkey, text: an order with its lines inside, in no order of keys; every third lacks its total."""
    q, n = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", q.alias("q"), _text('{"qty":', q, ',"n":', n, F.when(n % 2 == 0, ',"note":"even"').otherwise(""), "}").alias("text"))
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["text"]), ",").alias("lines"))
    total = F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(_text('"total":', F.floor("o_totalprice"), ","))
    text = _text("{", total, '"status":"', F.col("o_orderstatus"), '","items":[', F.coalesce("lines", F.lit("")), '],"id":', F.col("o_orderkey"), "}")
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", text.alias("text"))


def nested_feedback(spark: SparkSession, d: str) -> DataFrame:
    """Invalid orders printed with their lines and the errors of both, a line that is missing too."""
    out = N.validated_json(_packed(spark, d), "text", PACKED)
    few = F.exists("errors", lambda e: e["expected"].startswith("array & MinItems"))
    lost = F.struct(F.lit("$input.items[]").alias("path"), F.lit("object").alias("expected"), F.lit("null").alias("value"), F.lit(None).cast("string").alias("description"))
    errors = F.concat("errors", F.when(few, F.array(lost, lost)).otherwise(F.array().cast(out.schema["errors"].dataType)))
    return out.where("not valid").select("o_orderkey", record_feedback(F.col("text"), errors).alias("feedback"))


_PATHS = ["id", "status", "items[].n", "items[1].qty", "items[].note", "items", "total", "status[]", "id[0]", "items[x]", "items[1", "items..n", "items[0]"]


def field_paths(spark: SparkSession, d: str) -> DataFrame:
    """Fields of orders by path, or why there is none."""
    rows = F.array(*[F.struct(F.lit(p).alias("path"), extracted_from(F.col("v"), p).alias("x")) for p in _PATHS])
    return _packed(spark, d).select("o_orderkey", F.try_parse_json("text").alias("v")).select("o_orderkey", F.inline(rows)).select("o_orderkey", "path", "x.*")


QUERIES = {f.__name__: f for f in (tree_errors, unevaluated_errors, package_findings, package_parts, catalog_errors, nested_feedback, field_paths)}

_LINES = "l AS (SELECT l_orderkey, l_linenumber, l_quantity::INT AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity::INT) - 1 AS place FROM lineitem)"
_BRANDS = """b AS (SELECT p_brand, floor(avg(p_size) * 1.5)::INT AS most, coalesce(list_sort(list(DISTINCT p_type) FILTER (WHERE length(p_type) > 5)), []) AS types, min(p_size) AS low, max(p_size) AS high, split_part(p_brand, '#', 2)::INT AS n FROM part GROUP BY 1)"""
ORACLES = {
    "tree_errors": f"""WITH RECURSIVE {_LINES},
      w(l_orderkey, place, l_linenumber, q, path, left_) AS (SELECT l_orderkey, place, l_linenumber, q, '$input' || repeat('.right', place::INT), q FROM l
        UNION ALL SELECT l_orderkey, place, l_linenumber, q, path || '.left', left_ - 1 FROM w WHERE left_ > 0)
      SELECT l_orderkey, path || '.v' AS path, 'integer & Maximum<45>' AS expected FROM w WHERE left_ = q AND q > 45
      UNION ALL SELECT l_orderkey, path || '.v', 'required property' FROM w WHERE left_ = 0 AND l_linenumber % 4 = 3""",
    "unevaluated_errors": """WITH o AS (SELECT o_orderkey, o_orderkey % 4 AS m, o_orderstatus AS s, o_orderkey % 5 = 0 AS third, o_orderkey % 3 = 0 AS mine, o_orderkey % 7 AS t FROM orders),
      e AS (SELECT *, list_filter([CASE WHEN m = 0 AND s <> 'F' THEN 'closed' END, CASE WHEN m = 1 AND s <> 'O' THEN 'due' END, CASE WHEN m = 2 AND s <> 'P' THEN 'part' END, CASE WHEN m = 3 OR (m = 2 AND s <> 'P') THEN 'of' END, CASE WHEN third AND NOT mine THEN 'third' END], lambda x: x IS NOT NULL) AS names FROM o)
      SELECT o_orderkey, '$input' AS path, 'no extraneous properties' AS expected, list_aggregate(list_transform(names, lambda x: 'unexpected property ''' || x || ''''), 'string_agg', ', ') AS description FROM e WHERE len(names) > 0
      UNION ALL SELECT o_orderkey, '$input.tags[2]', 'integer', '' FROM e WHERE t IN (1, 2)""",
    "package_findings": f"""WITH {_BRANDS}
      SELECT p_brand, 'LINT001' AS code, 'schema has no top-level type constraint' AS message FROM b WHERE n % 5 = 0 UNION ALL SELECT p_brand, 'LINT002', 'schema has properties but no ''required'' array' FROM b WHERE n % 3 = 0
      UNION ALL SELECT p_brand, 'LINT003', 'property ''size'' has no type constraint' FROM b WHERE n % 4 = 3
      UNION ALL SELECT p_brand, 'CE001', 'Counterexample ' || i || ' passed validation — schema may be too loose' FROM b, (VALUES (1), (2), (3)) c(i) WHERE CASE i WHEN 1 THEN n % 4 = 3 OR low <= most WHEN 2 THEN n % 4 = 3 OR high <= most ELSE n % 3 = 0 AND (n % 4 = 3 OR 1 <= most) END""",
    "package_parts": "SELECT DISTINCT p_brand, true AS package, 1 AS relations, 0 AS rules, 3 AS counterexamples FROM part",
    "catalog_errors": f"""WITH {_BRANDS}, p AS (SELECT * FROM part JOIN b USING (p_brand)), e AS (
        SELECT p_brand, '$input.size' AS path, 'integer & Maximum<' || most || '>' AS expected FROM p WHERE n % 4 <> 3 AND p_size > most
        UNION ALL SELECT p_brand, '$input.type', 'one of [' || coalesce(list_aggregate(list_transform(types, lambda x: '"' || x || '"'), 'string_agg', ','), '') || ']' FROM p WHERE NOT list_contains(types, p_type)
        UNION ALL SELECT p_brand, '$input.name', 'required property' FROM p WHERE p_partkey % 6 = 0 AND n % 3 <> 0)
      SELECT p_brand, path, expected, count(*) AS n FROM e GROUP BY 1, 2, 3""",
    "nested_feedback": f"""WITH {_LINES}, n AS (SELECT l_orderkey, count(*) AS n FROM l GROUP BY 1),
      i AS (SELECT l_orderkey, string_agg(E'    {{\n      "n": ' || l_linenumber || ',' || CASE WHEN l_linenumber > 6 THEN ' // ❌ [{{"path":"$input.items[' || place || '].n","expected":"integer & Maximum<6>"}}]' ELSE '' END
          || CASE WHEN l_linenumber % 2 = 0 THEN E'\n      "note": "even",' ELSE '' END || E'\n      "qty": ' || q || CASE WHEN q < 5 THEN ' // ❌ [{{"path":"$input.items[' || place || '].qty","expected":"integer & Minimum<5>"}}]' ELSE '' END
          || E'\n    }}', E',\n' ORDER BY place) AS items, bool_or(l_linenumber > 6 OR q < 5) AS wrong FROM l GROUP BY 1),
      o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderkey % 3 = 0 AS bare, floor(o_totalprice)::BIGINT AS total, coalesce(n, 0) < 2 AS few, coalesce(n, 0) AS n, items, coalesce(wrong, false) AS wrong FROM orders LEFT JOIN n ON n.l_orderkey = o_orderkey LEFT JOIN i ON i.l_orderkey = o_orderkey)
      SELECT o_orderkey, E'```json\n{{\n  "id": ' || o_orderkey || E',\n  "items": [' || CASE WHEN few THEN ' // ❌ [{{"path":"$input.items","expected":"array & MinItems<2>"}}]' ELSE '' END || E'\n' || coalesce(items, '') || CASE WHEN few AND n > 0 THEN E',\n' ELSE '' END
        || CASE WHEN few THEN E'    undefined, // ❌ [{{"path":"$input.items[]","expected":"object"}}]\n    undefined // ❌ [{{"path":"$input.items[]","expected":"object"}}]' ELSE '' END || E'\n  ],\n  "status": "' || s || '",'
        || CASE WHEN s NOT IN ('O', 'F') THEN ' // ❌ [{{"path":"$input.status","expected":"one of ["O","F"]"}}]' ELSE '' END || E'\n  "total": '
        || CASE WHEN bare THEN 'undefined // ❌ [{{"path":"$input.total","expected":"required property","description":"The value at this path is `undefined`.\\n\\nPlease fill the `total` typed value next time."}}]' ELSE total::VARCHAR END || E'\n}}\n```' AS feedback
      FROM o WHERE bare OR few OR wrong OR s NOT IN ('O', 'F')""",
    "field_paths": f"""WITH {_LINES}, g AS (SELECT l_orderkey, string_agg(l_linenumber::VARCHAR, chr(10) ORDER BY place) AS ns, max(q) FILTER (place = 1) AS q1, count(*) AS n, bool_and(l_linenumber % 2 = 0) AS noted, string_agg('even', chr(10)) AS notes,
          string_agg('{{"n":' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN ',"note":"even"' ELSE '' END || ',"qty":' || q || '}}', chr(10) ORDER BY place) AS whole,
          max('{{"n":' || l_linenumber || CASE WHEN l_linenumber % 2 = 0 THEN ',"note":"even"' ELSE '' END || ',"qty":' || q || '}}') FILTER (place = 0) AS one FROM l GROUP BY 1),
      o AS (SELECT o_orderkey, o_orderstatus AS s, o_orderkey % 3 = 0 AS bare, floor(o_totalprice)::BIGINT AS total, coalesce(n, 0) AS n, g.* EXCLUDE (n) FROM orders LEFT JOIN g ON l_orderkey = o_orderkey)
      SELECT o_orderkey, path, CASE path WHEN 'id' THEN o_orderkey::VARCHAR WHEN 'status' THEN s WHEN 'items[].n' THEN coalesce(ns, '') WHEN 'items[1].qty' THEN q1::VARCHAR WHEN 'items[].note' THEN CASE WHEN n = 0 THEN '' WHEN noted THEN notes END WHEN 'items' THEN coalesce(whole, '') WHEN 'total' THEN CASE WHEN NOT bare THEN total::VARCHAR END WHEN 'items[0]' THEN one END AS text,
        CASE path WHEN 'items[1].qty' THEN CASE WHEN n < 2 THEN 'index out of bounds: 1' END WHEN 'items[].note' THEN CASE WHEN n > 0 AND NOT noted THEN 'field not found: note' END WHEN 'total' THEN CASE WHEN bare THEN 'field not found: total' END WHEN 'status[]' THEN 'expected array for []' WHEN 'id[0]' THEN 'expected array'
          WHEN 'items[x]' THEN 'invalid index: x' WHEN 'items[1' THEN 'unclosed bracket in: items[1' WHEN 'items..n' THEN 'empty key in: items..n' WHEN 'items[0]' THEN CASE WHEN n = 0 THEN 'index out of bounds: 0' END END AS error
      FROM o, (VALUES {', '.join(f"('{p}')" for p in _PATHS)}) v(path)""",
}
