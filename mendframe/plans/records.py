"""Validation, statistics, rules and feedback over the order and customer tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.coerce import change_kind, confidence, to_boolean, to_enum, to_number
from ..operators import validate as V
from .tables import table

ORDER = {
    "properties": {
        "o_totalprice": {"type": "number", "minimum": 1000, "maximum": 400000},
        "o_orderstatus": {"type": "string", "enum": ["O", "F"]},
        "o_orderpriority": {"type": "string", "pattern": "^[1-4]-", "maxLength": 10},
    },
    "required": ["o_totalprice", "o_orderstatus"],
}
_CHECKS = """
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
    list_filter([
      CASE WHEN o_totalprice < 1000 THEN {path: '$input.o_totalprice', expected: 'integer & Minimum<1000>', class: 'range'} END,
      CASE WHEN o_totalprice > 400000 THEN {path: '$input.o_totalprice', expected: 'integer & Maximum<400000>', class: 'range'} END,
      CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN {path: '$input.o_orderstatus', expected: 'one of ["O","F"]', class: 'enum'} END,
      CASE WHEN length(o_orderpriority) > 10 THEN {path: '$input.o_orderpriority', expected: 'string & MaxLength<10>', class: 'type'} END,
      CASE WHEN NOT regexp_matches(o_orderpriority, '^[1-4]-') THEN {path: '$input.o_orderpriority', expected: 'string & Pattern<"^[1-4]-">', class: 'type'} END
    ], lambda x: x IS NOT NULL) AS errors
  FROM orders
"""


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return V.validated(table(spark, d, "orders"), ORDER)


def validation_errors(spark: SparkSession, d: str) -> DataFrame:
    """Every error of every order, one a row."""
    return V.long_errors(_orders(spark, d), ["o_orderkey"]).select("o_orderkey", "path", "expected", "class")


def validation_stats(spark: SparkSession, d: str) -> DataFrame:
    """Errors by class and field with subtotals."""
    return V.error_counts(_orders(spark, d))


def validation_rates(spark: SparkSession, d: str) -> DataFrame:
    """Success rate by order status."""
    return V.success_rate(_orders(spark, d), "o_orderstatus")


def top_failing_fields(spark: SparkSession, d: str) -> DataFrame:
    return V.top_failing(_orders(spark, d), 2)


def prompt_hints(spark: SparkSession, d: str) -> DataFrame:
    return V.prompt_hints(_orders(spark, d))


def feedback_report(spark: SparkSession, d: str) -> DataFrame:
    """Invalid orders as annotated JSON."""
    return V.feedback(_orders(spark, d), ["o_orderpriority", "o_orderstatus", "o_totalprice"], ["o_orderkey"])


def errors_by_path(spark: SparkSession, d: str) -> DataFrame:
    """An order's errors gathered by field."""
    e = V.long_errors(_orders(spark, d), ["o_orderkey"])
    return e.groupBy("o_orderkey", "path").agg(F.array_join(F.sort_array(F.collect_list("expected")), "; ").alias("expected"))


def cross_field_rules(spark: SparkSession, d: str) -> DataFrame:
    """Line items that break relations or rules."""
    relations = [("l_extendedprice", "gte", "l_quantity"), ("l_tax", "lt", "l_discount"), ("l_quantity", "lte", "l_linenumber")]
    rules = [
        ("returned lines are small", {"if": [{"==": [{"var": "l_returnflag"}, "R"]}, {"<=": [{"var": "l_quantity"}, 25]}, True]}),
        ("charge is bounded", {"<": [{"*": [{"var": "l_extendedprice"}, {"+": [1, {"var": "l_tax"}]}]}, 90000]}),
    ]
    rows = table(spark, d, "lineitem").withColumns({"relations": V.relation_errors(relations), "rules": V.rule_errors(rules)})
    kept = rows.where(F.size("relations") + F.size("rules") > 0)
    return kept.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("relations", "; ").alias("relations"), F.array_join("rules", "; ").alias("rules"))


def guard_check(spark: SparkSession, d: str) -> DataFrame:
    """Parse, validate and check rules in one pass: counts of what passes by priority."""
    rules = [("urgent orders are dear", {"or": [{"!=": [{"var": "o_orderpriority"}, "1-URGENT"]}, {">": [{"var": "o_totalprice"}, 50000]}]})]
    out = V.guard(table(spark, d, "orders"), ORDER, [("o_orderkey", "gte", "o_custkey")], rules)
    return out.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.count_if("passes").alias("passed"), F.sum(F.size("errors")).alias("n_errors"), F.sum(F.size("relations")).alias("n_relations"), F.sum(F.size("rules")).alias("n_rules"))


def retry_state(spark: SparkSession, d: str) -> DataFrame:
    """Orders of a customer as attempts: the first that passes ends the loop; three equal error counts in a row stall it."""
    a = _orders(spark, d).select("o_custkey", "o_orderkey", F.size("errors").alias("n"))
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    a = a.withColumns({"attempt": F.row_number().over(w), "same": (F.lag("n", 1).over(w) == F.col("n")) & (F.lag("n", 2).over(w) == F.col("n")) & (F.col("n") > 0)})
    return a.groupBy("o_custkey").agg(
        F.count("*").alias("attempts"), F.min(F.when(F.col("n") == 0, F.col("attempt"))).alias("first_pass"), F.coalesce(F.bool_or("same"), F.lit(False)).alias("stalled"), F.min_by("n", "attempt").alias("first_errors")
    )


def coercion_log(spark: SparkSession, d: str) -> DataFrame:
    """Orders spelt as loose text, coerced back: counts by field and kind of change, with the mean confidence."""
    key = F.col("o_orderkey")
    price = F.when(key % 3 == 0, F.format_string("%s", F.col("o_custkey"))).when(key % 3 == 1, F.concat((key % 90 + 10).cast("string"), F.lit("k"))).otherwise(F.concat((key % 9 + 1).cast("string"), F.lit(",500")))
    state = F.when(key % 4 == 0, F.lower("o_orderstatus")).when(key % 4 == 1, F.concat(F.lit(" "), "o_orderstatus")).otherwise(F.col("o_orderstatus"))
    flag = F.element_at(F.array(*[F.lit(x) for x in ("yes", "Off", "tru", "maybe")]), (key % 4 + 1).cast("int"))
    raw = table(spark, d, "orders").select(price.alias("p"), state.alias("s"), flag.alias("f"))
    typed = raw.withColumns({"pv": to_number(F.col("p")), "sv": to_enum(F.col("s"), ["O", "F", "P"]), "fv": to_boolean(F.col("f"))})
    field = lambda name, kind, sure: F.struct(F.lit(name).alias("field"), kind.alias("kind"), sure.alias("confidence"))
    rows = typed.select(F.explode(F.array(
        field("price", change_kind(F.col("p"), F.col("pv"), "number"), confidence(F.col("p"), F.col("pv"), F.col("pv").isNotNull(), True)),
        field("status", change_kind(F.col("s"), F.col("sv"), "string"), confidence(F.col("s"), F.col("sv"), F.lit(True), False)),
        field("flag", change_kind(F.col("f"), F.col("fv"), "boolean"), confidence(F.col("f"), F.col("fv").cast("string"), F.col("fv").isNotNull(), False)),
    )).alias("x")).select("x.*")
    return rows.groupBy("field", "kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 4).alias("confidence"))


def merged_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Orders whose failed fields take a later correction where there is one."""
    o = table(spark, d, "orders")
    original = o.select("o_orderkey", F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.array_compact(F.array(F.when(F.col("o_totalprice") > 400000, F.lit("price")), F.when(F.col("o_orderstatus") == "P", F.lit("status")))).alias("failed"))
    fixes = o.where("o_orderkey % 2 = 0").select("o_orderkey", F.lit(400000.0).alias("price"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("O")).alias("status"))
    from ..operators.schemas import merged_fields

    return merged_fields(original, fixes, "o_orderkey", ["price", "status"]).withColumn("unmerged", F.array_join("unmerged", ","))


QUERIES = {f.__name__: f for f in (validation_errors, validation_stats, validation_rates, top_failing_fields, prompt_hints, feedback_report, errors_by_path, cross_field_rules, guard_check, retry_state, coercion_log, merged_corrections)}
_LONG = f"WITH o AS ({_CHECKS}), e AS (SELECT o_orderkey, unnest(errors) AS e FROM o)"
_N = f"{_LONG}, n AS (SELECT e.path AS path, count(*) AS n FROM e GROUP BY 1), c AS (SELECT e.class AS class, count(*) AS n FROM e GROUP BY 1)"
ORACLES = {
    "validation_errors": f"{_LONG} SELECT o_orderkey, e.path AS path, e.expected AS expected, e.class AS class FROM e",
    "validation_stats": f"{_LONG} SELECT e.class AS class, e.path AS path, count(*) AS n FROM e GROUP BY CUBE (1, 2)",
    "validation_rates": f"WITH o AS ({_CHECKS}) SELECT o_orderstatus, count(*) AS total, count(*) FILTER (WHERE len(errors) = 0) AS successes, avg((len(errors) = 0)::INT) AS rate FROM o GROUP BY 1",
    "top_failing_fields": f"{_N} SELECT path, n FROM n ORDER BY n DESC, path LIMIT 2",
    "prompt_hints": f"""{_N}
      SELECT 'Field ''' || path || ''' fails ' || n || ' times — add explicit constraint to prompt' AS hint FROM (SELECT * FROM n ORDER BY n DESC, path LIMIT 5)
      UNION ALL SELECT class || ': ' || n || ' errors — ' || CASE class WHEN 'range' THEN 'State numeric ranges explicitly in prompt' WHEN 'enum' THEN 'List all allowed values in prompt' ELSE 'Check type constraints in schema' END FROM c WHERE n > 3""",
    "feedback_report": f"""WITH o AS ({_CHECKS}),
      f AS (SELECT *, list_aggregate(list_transform(list_filter(errors, lambda e: e.path = '$input.o_orderpriority'), lambda e: '{{"path":"' || e.path || '","expected":"' || e.expected || '"}}'), 'string_agg', ',') AS p,
        list_aggregate(list_transform(list_filter(errors, lambda e: e.path = '$input.o_totalprice'), lambda e: '{{"path":"' || e.path || '","expected":"' || e.expected || '"}}'), 'string_agg', ',') AS t,
        list_aggregate(list_transform(list_filter(errors, lambda e: e.path = '$input.o_orderstatus'), lambda e: '{{"path":"' || e.path || '","expected":"' || e.expected || '"}}'), 'string_agg', ',') AS s FROM o WHERE len(errors) > 0)
      SELECT o_orderkey, '```json' || chr(10) || '{{' || chr(10) || '  "o_orderpriority": "' || o_orderpriority || '",' || CASE WHEN p <> '' THEN ' // ❌ [' || p || ']' ELSE '' END || chr(10)
        || '  "o_orderstatus": "' || o_orderstatus || '",' || CASE WHEN s <> '' THEN ' // ❌ [' || s || ']' ELSE '' END || chr(10) || '  "o_totalprice": ' || o_totalprice || CASE WHEN t <> '' THEN ' // ❌ [' || t || ']' ELSE '' END || chr(10) || '}}' || chr(10) || '```' AS feedback FROM f""",
    "errors_by_path": f"{_LONG} SELECT o_orderkey, e.path AS path, string_agg(e.expected, '; ' ORDER BY e.expected) AS expected FROM e GROUP BY 1, 2",
    "cross_field_rules": """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey,
        concat_ws('; ', CASE WHEN l_extendedprice < l_quantity THEN 'l_extendedprice must be gte l_quantity' END, CASE WHEN l_tax >= l_discount THEN 'l_tax must be lt l_discount' END, CASE WHEN l_quantity > l_linenumber THEN 'l_quantity must be lte l_linenumber' END) AS relations,
        concat_ws('; ', CASE WHEN l_returnflag = 'R' AND NOT l_quantity <= 25 THEN 'returned lines are small' END, CASE WHEN NOT l_extendedprice * (1 + l_tax) < 90000 THEN 'charge is bounded' END) AS rules FROM lineitem)
      SELECT * FROM r WHERE relations <> '' OR rules <> ''""",
    "guard_check": f"""WITH o AS ({_CHECKS}), g AS (SELECT *, (o_orderkey < o_custkey)::INT AS rel, (NOT (o_orderpriority <> '1-URGENT' OR o_totalprice > 50000))::INT AS rule FROM o)
      SELECT o_orderpriority, count(*) AS n, count(*) FILTER (WHERE len(errors) + rel + rule = 0) AS passed, sum(len(errors))::BIGINT AS n_errors, sum(rel)::BIGINT AS n_relations, sum(rule)::BIGINT AS n_rules FROM g GROUP BY 1""",
    "retry_state": f"""WITH o AS ({_CHECKS}), a AS (SELECT o_custkey, len(errors)::INT AS n, row_number() OVER w AS attempt, lag(len(errors), 1) OVER w = len(errors) AND lag(len(errors), 2) OVER w = len(errors) AND len(errors) > 0 AS same FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
      SELECT o_custkey, count(*) AS attempts, min(attempt) FILTER (WHERE n = 0)::INT AS first_pass, coalesce(bool_or(same), false) AS stalled, min_by(n, attempt) AS first_errors FROM a GROUP BY 1""",
    "coercion_log": """WITH r AS (SELECT o_orderkey AS k, o_custkey::VARCHAR AS c, o_orderstatus AS st FROM orders),
      x AS (SELECT 'price' AS field, 'string_to_number' AS kind, CASE WHEN k % 3 = 0 THEN 1.0 ELSE 0.7 END AS confidence FROM r
        UNION ALL SELECT 'status', CASE WHEN k % 4 = 0 THEN 'enum_case' WHEN k % 4 = 1 THEN 'string_trim' END, CASE WHEN k % 4 = 0 THEN 0.9 ELSE 1.0 END FROM r
        UNION ALL SELECT 'flag', CASE WHEN k % 4 < 3 THEN 'string_to_bool' END, CASE WHEN k % 4 < 3 THEN 0.7 ELSE 0.0 END FROM r)
      SELECT field, kind, count(*) AS n, round(avg(confidence), 4) AS confidence FROM x GROUP BY 1, 2""",
    "merged_corrections": """SELECT o_orderkey, CASE WHEN o_totalprice > 400000 AND o_orderkey % 2 = 0 THEN 400000.0 ELSE o_totalprice END AS price, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 = 0 THEN 'O' ELSE o_orderstatus END AS status,
        concat_ws(',', CASE WHEN o_totalprice > 400000 AND o_orderkey % 2 <> 0 THEN 'price' END, CASE WHEN o_orderstatus = 'P' AND o_orderkey % 4 <> 0 THEN 'status' END) AS unmerged FROM orders""",
}
