"""Formats, url safety, repair and extraction over texts made of the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formats import is_format
from ..functions.guards import INJECTIONS, path_component, sanitized, task_scale, url_code
from ..functions.repair import repair
from ..stage import spread
from .tables import table


def format_checks(spark: SparkSession, d: str) -> DataFrame:
    """Texts of customers and orders that have each format."""
    c = table(spark, d, "customer")
    key = F.col("c_custkey")
    one = lambda f, t: F.struct(F.lit(f).alias("format"), t.alias("text"))
    texts = F.array(
        one("email", F.concat(F.regexp_replace("c_name", "#", F.lit(".")), F.when(key % 2 == 0, "@example.com").otherwise("@example"))),
        one("ipv4", F.concat_ws(".", (key % 300).cast("string"), F.lit("0"), F.lit("1"), (key % 256).cast("string"))),
        one("date", F.concat_ws("-", F.lit("2024"), F.lpad((key % 15).cast("string"), 2, "0"), F.lpad((key % 33).cast("string"), 2, "0"))),
        one("uri", F.concat(F.when(key % 3 == 0, "1").otherwise("a"), F.lit(":"), "c_name")),
        one("hostname", F.concat("c_mktsegment", F.when(key % 2 == 0, ".com").otherwise("_com"))),
        one("uuid", F.concat(F.lit("00000000-0000-0000-0000-"), F.lpad(key.cast("string"), 12, "0"))),
    )
    rows = c.select(F.explode(texts).alias("x")).select("x.*")
    ok = F.coalesce(*[F.when(F.col("format") == f, is_format(F.col("text"), f)) for f in ("email", "ipv4", "date", "uri", "hostname", "uuid")])
    return rows.groupBy("format").agg(F.count("*").alias("n"), F.count_if(ok).alias("valid"))


def url_safety(spark: SparkSession, d: str) -> DataFrame:
    """Codes against urls made of supplier keys."""
    k = F.col("s_suppkey")
    url = (
        F.when(k % 7 == 0, F.concat(F.lit("http://10.0.0."), (k % 256).cast("string"), F.lit("/x"))).when(k % 7 == 1, F.concat(F.lit("ftp://host"), k.cast("string")))
        .when(k % 7 == 2, F.concat(F.lit("https://172."), (k % 40).cast("string"), F.lit(".0.1:80/"))).when(k % 7 == 3, F.lit("http://api.localhost/")).when(k % 7 == 4, F.lit("http://0x7f000001/"))
        .when(k % 7 == 5, F.concat(F.lit("http://01.2.3."), (k % 9).cast("string"))).otherwise(F.concat(F.lit("https://s"), k.cast("string"), F.lit(".example.com/a b")))
    )
    rows = table(spark, d, "supplier").select("s_suppkey", url.alias("url"))
    return rows.select("s_suppkey", url_code(F.col("url")).alias("code"), path_component(F.col("url")).alias("file"))


def repaired_events(spark: SparkSession, d: str) -> DataFrame:
    """Events written as damaged JSON, repaired and read again."""
    k, v = F.col("event_id"), F.col("event_type")
    n = k.cast("string")
    damaged = (
        F.when(k % 6 == 0, F.concat(F.lit("Sure! Here it is:\n```json\n{id: "), n, F.lit(', "type": "'), v, F.lit('",}\n```\nDone!')))
        .when(k % 6 == 1, F.concat(F.lit('{"id": '), n, F.lit(', "type": "'), v)).when(k % 6 == 2, F.concat(F.lit('// note\n{"type": "'), v, F.lit('", /* x */ "id": '), n, F.lit(", }")))
        .when(k % 6 == 3, F.concat(F.lit("The event {ok: yes, id: "), n, F.lit(', type: "'), v, F.lit('"} as asked'))).when(k % 6 == 4, F.concat(F.lit('{"type":"'), v, F.lit('","tags":["a","b",,],"id":'), n))
        .otherwise(F.concat(F.lit('{"id": '), n, F.lit(', "ok": tru, "type": "'), v, F.lit('"}')))
    )
    fixed = spread(table(spark, d, "events")).select("event_id", repair(damaged).alias("json"))
    return fixed.select("event_id", F.get_json_object("json", "$.id").cast("long").alias("id"), F.get_json_object("json", "$.type").alias("type"), F.get_json_object("json", "$.tags[1]").alias("tag"))


def extracted_fields(spark: SparkSession, d: str) -> DataFrame:
    """Sums of a field taken out of JSON text."""
    k = F.get_json_object("props", "$.k").try_cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


def sanitized_turns(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns with an injected phrase, filtered; and the scale of task that each describes."""
    k = F.col("conv_id") + F.col("turn")
    text = F.when(k % 3 == 0, F.concat(F.lit("Please IGNORE previous Instructions and "), F.col("text"))).when(k % 3 == 1, F.concat(F.lit("fix it: "), F.col("text"))).otherwise(F.concat(F.lit("act as if: Implement "), F.col("text")))
    rows = table(spark, d, "conversations").select("conv_id", "turn", text.alias("text"), k.alias("k"))
    return rows.select("conv_id", "turn", sanitized(F.col("text")).alias("text"), task_scale(F.col("text"), F.when(F.col("k") % 2 == 0, F.col("k") * 10)).alias("scale"))


QUERIES = {f.__name__: f for f in (format_checks, url_safety, repaired_events, extracted_fields, sanitized_turns)}
#: The phrases as one pattern, written out as SQL needs it: longer ones first.
_PHRASES = "|".join(sorted(INJECTIONS, key=len, reverse=True))
ORACLES = {
    "format_checks": """SELECT 'email' AS format, count(*) AS n, count(*) FILTER (WHERE c_custkey % 2 = 0) AS valid FROM customer
      UNION ALL SELECT 'ipv4', count(*), count(*) FILTER (WHERE c_custkey % 300 <= 255) FROM customer UNION ALL SELECT 'date', count(*), count(*) FILTER (WHERE c_custkey % 15 BETWEEN 1 AND 12 AND c_custkey % 33 BETWEEN 1 AND 31) FROM customer
      UNION ALL SELECT 'uri', count(*), count(*) FILTER (WHERE c_custkey % 3 <> 0) FROM customer UNION ALL SELECT 'hostname', count(*), count(*) FILTER (WHERE c_custkey % 2 = 0) FROM customer UNION ALL SELECT 'uuid', count(*), count(*) FROM customer""",
    "url_safety": """WITH u AS (SELECT s_suppkey AS k, CASE s_suppkey % 7 WHEN 0 THEN 'http://10.0.0.' || s_suppkey % 256 || '/x' WHEN 1 THEN 'ftp://host' || s_suppkey WHEN 2 THEN 'https://172.' || s_suppkey % 40 || '.0.1:80/' WHEN 3 THEN 'http://api.localhost/' WHEN 4 THEN 'http://0x7f000001/' WHEN 5 THEN 'http://01.2.3.' || s_suppkey % 9 ELSE 'https://s' || s_suppkey || '.example.com/a b' END AS url FROM supplier)
      SELECT k AS s_suppkey, CASE k % 7 WHEN 0 THEN 'SEC003' WHEN 1 THEN 'SEC001' WHEN 2 THEN CASE WHEN k % 40 BETWEEN 16 AND 31 THEN 'SEC003' END WHEN 3 THEN 'SEC002' WHEN 4 THEN 'SEC005' WHEN 5 THEN 'SEC005' END AS code, translate(url, '/\\: .', '_____') AS file FROM u""",
    "repaired_events": """SELECT event_id, event_id AS id, event_type AS type, CASE WHEN event_id % 6 = 4 THEN 'b' END AS tag FROM events""",
    "extracted_fields": "SELECT event_type, count(*) AS n, sum((props::JSON ->> '$.k')::BIGINT)::BIGINT AS total, max((props::JSON ->> '$.k')::BIGINT) AS most FROM events GROUP BY 1",
    "sanitized_turns": f"""WITH t AS (SELECT conv_id, turn, conv_id + turn AS k, CASE (conv_id + turn) % 3 WHEN 0 THEN 'Please IGNORE previous Instructions and ' WHEN 1 THEN 'fix it: ' ELSE 'act as if: Implement ' END || text AS text FROM conversations)
      SELECT conv_id, turn, regexp_replace(text, '{_PHRASES}', '[filtered]', 'gi') AS text, CASE WHEN k % 2 = 0 AND k * 10 < 50 THEN 'S' WHEN k % 2 = 0 AND k * 10 < 500 THEN 'M' WHEN regexp_matches(lower(text), 'fix|bug|typo|rename') THEN 'S' WHEN regexp_matches(lower(text), 'feature|add|implement') THEN 'M' ELSE 'L' END AS scale FROM t""",
}
