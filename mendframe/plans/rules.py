"""Rules between the fields of schemas: conflicts and examples, from each brand's part types and sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import consistency as C
from .tables import table

#: Which brands (number modulo 6) have which relations: a chain of five, rings, sums.
_RULES = [
    ("ECONOMY", "lt", "LARGE", 6), ("LARGE", "lt", "MEDIUM", 6), ("MEDIUM", "lte", "PROMO", 6), ("STANDARD", "gt", "PROMO", 6), ("SMALL", "gte", "STANDARD", 6),
    ("SMALL", "lt", "ECONOMY", 0), ("PROMO", "lte", "MEDIUM", 1), ("LARGE", "lt", "PROMO", 1), ("ECONOMY", "eq", "SMALL + PROMO - LARGE", 2), ("TOTAL", "eq", "LARGE + MEDIUM", 3), ("TOTAL", "lte", "ECONOMY", 3),
    ("PROMO", "eq", "LARGE + nowhere", 4), ("LARGE", "like", "SMALL", 4),
]


def _fields(spark: SparkSession, d: str) -> DataFrame:
    n = F.substring_index("p_brand", "#", -1).cast("int")
    g = table(spark, d, "part").groupBy(F.col("p_brand").alias("schema_id"), F.col("p_type").alias("path")).agg(F.min("p_size").cast("double").alias("lo"), F.max("p_size").cast("double").alias("top"), F.min(n).alias("n"))
    return g.select("schema_id", "path", "lo", F.when(F.col("n") % 4 == 0, F.col("lo") + 2.5).when((F.col("n") % 4 == 1) & (F.col("path") == "PROMO"), F.lit(None)).otherwise(F.col("top")).alias("hi"), "n")


def _relations(fields: DataFrame) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(op).alias("op"), F.lit(b).alias("b"), F.lit(m).alias("m")) for a, op, b, m in _RULES])
    return fields.select("schema_id", "n").distinct().select("schema_id", "n", F.inline(rows)).where("m = 6 or m = n % 6").select("schema_id", "a", "op", "b")


def rule_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """What can't hold together in each brand's rules."""
    fields = _fields(spark, d)
    return C.conflicts(fields.select("schema_id", "path", "lo", "hi"), _relations(fields))


def rule_examples(spark: SparkSession, d: str) -> DataFrame:
    """A record that the rules of a brand allow, where they do."""
    fields = _fields(spark, d)
    types = fields.select("schema_id", "path", F.when(F.col("path").startswith("S"), "integer").otherwise("number").alias("type"))
    return C.examples(fields.select("schema_id", "path", "lo", "hi"), _relations(fields), types)


QUERIES = {f.__name__: f for f in (rule_conflicts, rule_examples)}

_PAIRS = ", ".join(f"('{low}', '{high}', {gap}, {m})" for low, high, gap, m in [
    ("ECONOMY", "LARGE", 1, 6), ("LARGE", "MEDIUM", 1, 6), ("MEDIUM", "PROMO", 0, 6), ("PROMO", "STANDARD", 1, 6), ("STANDARD", "SMALL", 0, 6), ("SMALL", "ECONOMY", 1, 0), ("PROMO", "MEDIUM", 0, 1), ("LARGE", "PROMO", 1, 1), ("TOTAL", "ECONOMY", 0, 3),
])
_PASS = """b{n} AS (SELECT schema_id, n, path, max(lo) AS lo, min(hi) AS hi FROM (SELECT * FROM b{m}
  UNION ALL SELECT schema_id, n, high, lo + gap, NULL FROM b{m} JOIN e ON path = low AND fits(n, m) UNION ALL SELECT schema_id, n, low, NULL, hi - gap FROM b{m} JOIN e ON path = high AND fits(n, m)) GROUP BY 1, 2, 3)"""
#: All of the chain is a ring where the number is 0 modulo 6: no gaps there.
_SOLVED = (
    f"WITH r(low, high, g, m) AS (VALUES {_PAIRS}), e AS (SELECT * FROM r), "
    "b0 AS (SELECT p_brand AS schema_id, split_part(p_brand, '#', 2)::INT AS n, p_type AS path, min(p_size)::DOUBLE AS lo, CASE WHEN split_part(p_brand, '#', 2)::INT % 4 = 0 THEN min(p_size) + 2.5 WHEN split_part(p_brand, '#', 2)::INT % 4 = 1 AND p_type = 'PROMO' THEN NULL ELSE max(p_size) END::DOUBLE AS hi FROM part GROUP BY 1, 2, 3), "
    + ", ".join(_PASS.format(n=i + 1, m=i).replace("fits(n, m)", "(m = 6 OR m = n % 6)").replace("+ gap", "+ CASE WHEN n % 6 = 0 THEN 0 ELSE g END").replace("- gap", "- CASE WHEN n % 6 = 0 THEN 0 ELSE g END") for i in range(7))
    + ", t AS (SELECT *, CASE WHEN lo = floor(lo) THEN lo::BIGINT::VARCHAR ELSE lo::VARCHAR END AS low_, CASE WHEN hi = floor(hi) THEN hi::BIGINT::VARCHAR ELSE hi::VARCHAR END AS high_ FROM b7)"
    + ", w AS (SELECT schema_id, n, max(lo) FILTER (path = 'LARGE') AS l1, max(hi) FILTER (path = 'LARGE') AS l2, max(lo) FILTER (path = 'MEDIUM') AS m1, max(hi) FILTER (path = 'MEDIUM') AS m2, max(lo) FILTER (path = 'SMALL') AS s1, max(hi) FILTER (path = 'SMALL') AS s2,"
    + " max(lo) FILTER (path = 'PROMO') AS p1, max(hi) FILTER (path = 'PROMO') AS p2, max(lo) FILTER (path = 'ECONOMY') AS e1, max(hi) FILTER (path = 'ECONOMY') AS e2, max(lo) FILTER (path = 'TOTAL') AS t1, max(hi) FILTER (path = 'TOTAL') AS t2,"
    + " bool_or(path = 'LARGE') AND bool_or(path = 'MEDIUM') AS both3, bool_or(path = 'LARGE') AND bool_or(path = 'SMALL') AND bool_or(path = 'PROMO') AS both2 FROM b7 GROUP BY 1, 2)"
    + ", q AS (SELECT schema_id, 'ECONOMY' AS a, 'SMALL + PROMO - LARGE' AS b, coalesce(s1, '-inf') + coalesce(p1, '-inf') + coalesce(-l2, '-inf') AS least, coalesce(s2, 'inf') + coalesce(p2, 'inf') + coalesce(-l1, 'inf') AS most, e1 AS lo, e2 AS hi FROM w WHERE n % 6 = 2 AND both2"
    + " UNION ALL SELECT schema_id, 'TOTAL', 'LARGE + MEDIUM', coalesce(l1, '-inf') + coalesce(m1, '-inf'), coalesce(l2, 'inf') + coalesce(m2, 'inf'), t1, t2 FROM w WHERE n % 6 = 3 AND both3)"
    + ", s(x) AS (SELECT 1), shown AS (SELECT *, CASE WHEN least = floor(least) THEN least::DOUBLE::DECIMAL(18,0)::VARCHAR ELSE least::VARCHAR END AS least_, CASE WHEN hi = floor(hi) THEN hi::DECIMAL(18,0)::VARCHAR ELSE hi::VARCHAR END AS hi_,"
    + " CASE WHEN most = floor(most) AND most < 1e15 THEN most::DECIMAL(18,0)::VARCHAR ELSE most::VARCHAR END AS most_, CASE WHEN lo = floor(lo) THEN lo::DECIMAL(18,0)::VARCHAR ELSE lo::VARCHAR END AS lo_ FROM q WHERE least > hi OR most < lo)"
    + """, c AS (SELECT schema_id, path || '.min = ' || low_ AS rule_a, path || '.max = ' || high_ AS rule_b, 'range conflict: ' || path || ' requires min(' || low_ || ') <= max(' || high_ || ')' AS reason FROM t WHERE lo > hi
      UNION ALL SELECT schema_id, p || ' < ... < ' || p, '', 'cycle conflict: strict ordering cycle through ' || p FROM w, (VALUES ('ECONOMY'), ('LARGE'), ('MEDIUM'), ('PROMO'), ('STANDARD'), ('SMALL')) v(p) WHERE n % 6 = 0
      UNION ALL SELECT schema_id, a || ' = ' || b, a || '.max = ' || hi_, 'arithmetic infeasibility: ' || b || ' minimum possible value (' || least_ || ') > ' || a || '.max (' || hi_ || ')' FROM shown WHERE least > hi
      UNION ALL SELECT schema_id, a || ' = ' || b, a || '.min = ' || lo_, 'arithmetic infeasibility: ' || b || ' maximum possible value (' || most_ || ') < ' || a || '.min (' || lo_ || ')' FROM shown WHERE most < lo)"""
)
_VALUE = "CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN (lo + hi) / 2 WHEN lo IS NOT NULL THEN lo + 1 WHEN hi IS NOT NULL THEN hi - 1 ELSE 0.0 END"
ORACLES = {
    "rule_conflicts": f"{_SOLVED} SELECT * FROM c",
    "rule_examples": f"""{_SOLVED}, x AS (SELECT schema_id, path, {_VALUE} AS v FROM b7 WHERE (schema_id, path) IN (SELECT schema_id, path FROM b0) AND schema_id NOT IN (SELECT schema_id FROM c))
      SELECT schema_id, '{{' || string_agg('"' || path || '":' || CASE WHEN path LIKE 'S%' THEN trunc(v)::BIGINT::VARCHAR ELSE v::VARCHAR END, ',' ORDER BY path) || '}}' AS example FROM x GROUP BY 1""",
}
