"""Repairing what failed: groups of failed fields, the prompt for them, corrections merged and judged, attempts until one passes.

All of it is Columns over a record's own arrays, and one aggregation by key for attempts. Null
corrections and texts that aren't a JSON object give an error; a null or empty list of failed
fields gives no groups. Attempts beyond the allowed ones are ignored wherever they come from,
so a key is as large as the allowed number of attempts; repeated attempts count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import sealed
from .check import coerced_text, errors_of_text, field_confidence
from .nested import _as

#: Broken relations count against the first field.
Relations = list[tuple[str, str, str]]


def field_groups(failed: Column, relations: Relations) -> Column:
    """Failed fields (an array, in order) by groups: each that is in none yet leads one, with those left that a relation ties to it."""
    tied = F.array(*[F.lit(x) for a, _, b in relations for x in (f"{a}\0{b}", f"{b}\0{a}")]) if relations else F.array().cast("array<string>")
    none = F.array().cast("array<array<string>>")

    def add(groups: Column, name: Column) -> Column:
        held = F.flatten(groups)
        more = F.filter(failed, lambda g: (g != name) & ~F.array_contains(held, g) & F.array_contains(tied, F.concat(name, F.lit("\0"), g)))
        return F.when(F.array_contains(held, name), groups).otherwise(F.concat(groups, F.array(F.concat(F.array(name), more))))

    return F.coalesce(F.aggregate(failed, none, add), none)


def judged(df: DataFrame, record: str, schema: dict, relations: Relations, name: str) -> DataFrame:
    """df with an array column `name` of field, confidence, status, reason of a record (a VARIANT column): its errors, and broken relations at their first field."""
    number = lambda f: _as(F.try_variant_get("_typed", f"$['{f}']", "variant"), "double")
    broken = [F.when(_broken(op, number(a), number(b)), F.struct(F.lit(a).alias("field"), F.lit(f"{a} must be {op} {b}").alias("said"))) for a, op, b in relations]
    wrong = F.filter(F.array(*broken), lambda x: x.isNotNull()) if broken else F.array().cast("array<struct<field:string,said:string>>")

    def told(f: Column) -> Column:
        rel = F.get(F.filter("_wrong", lambda w: w["field"] == f["field"]), F.lit(0))["said"]
        own = F.get(F.filter("_errors", lambda e: _below(e["path"], f["field"])), F.lit(0))
        reason = F.when(f["status"] == "invalid", F.regexp_replace(own["path"], r"^\$input\.", "")).otherwise(rel)
        bad = (f["status"] == "invalid") | rel.isNotNull()
        return F.struct(f["field"].alias("field"), F.when(bad, 0.0).otherwise(f["confidence"]).alias("confidence"), F.when(bad, "invalid").otherwise(f["status"]).alias("status"), reason.alias("reason"))

    # One column a step, so that each is worked out once.
    out = df.withColumn("_near", coerced_text(schema, F.to_json(record))).withColumns({"_typed": F.try_parse_json("_near"), "_errors": errors_of_text(schema, F.col("_near"))}).withColumn("_wrong", wrong)
    out = out.withColumn("_fields", field_confidence(schema, F.col(record), F.col("_typed"), F.col("_errors")))
    return sealed(out.withColumn(name, F.transform("_fields", told)).drop("_near", "_typed", "_errors", "_wrong", "_fields"), name)


def _broken(op: str, a: Column, b: Column) -> Column:
    broken = {"gte": a < b, ">=": a < b, "lte": a > b, "<=": a > b, "gt": a <= b, ">": a <= b, "lt": a >= b, "<": a >= b, "eq": F.abs(a - b) > 2.0**-52, "==": F.abs(a - b) > 2.0**-52}
    return F.coalesce(broken.get(op, F.lit(False)), F.lit(False))


def _below(path: Column, name: Column) -> Column:
    own = F.concat(F.lit("$input."), name)
    return (path == own) | path.startswith(F.concat(own, F.lit("."))) | path.startswith(F.concat(own, F.lit("[")))


def failed_fields(fields: Column) -> Column:
    return F.transform(F.filter(fields, lambda f: f["status"] == "invalid"), lambda f: f["field"])


def selective_prompt(summary: Column, failed: Column, v: Column, fields: Column) -> Column:
    """What to ask for the failed fields only: the schema in short, reasons, and what stands there now."""
    reasons = F.transform(F.filter(fields, lambda f: F.array_contains(failed, f["field"]) & (f["status"] == "invalid")), lambda f: F.concat(F.lit("  - "), f["field"], F.lit(": "), f["reason"]))
    held = F.try_variant_get(v, "$", "map<string,variant>")
    there = F.filter(failed, lambda f: F.map_contains_key(held, f))
    values = F.transform(there, lambda f: F.concat(F.lit("  - "), f, F.lit(": "), F.to_json(F.try_element_at(held, f))))
    return F.concat(
        F.lit("Fix ONLY these fields. Return a JSON object with corrected values.\n\nSchema: "), summary, F.lit("\n\nFailed fields:\n"), F.array_join(reasons, "\n"), F.lit("\n\nCurrent values:\n"), F.array_join(values, "\n"),
        F.lit("\n\nReturn ONLY a JSON object with the corrected fields. No explanation."),
    )


def retried(df: DataFrame, original: str, corrections: str, failed: str, schema: dict, relations: Relations) -> DataFrame:
    """df with merged (JSON text), merged_fields, still_failed and retry_error of records (JSON text) whose failed fields (an array) corrections (JSON text) replace.

    A merge that breaks a field that hadn't failed is an error, and nothing is merged then.
    """
    out = df.withColumns({"_o": F.try_parse_json(original), "_c": F.try_parse_json(corrections)})
    held, new = (F.coalesce(F.try_variant_get(c, "$", "map<string,variant>"), F.create_map().cast("map<string,variant>")) for c in ("_o", "_c"))
    out = out.withColumn("_taken", F.filter(failed, lambda f: F.map_contains_key(new, f)))
    left = F.filter(F.map_entries(held), lambda e: ~F.array_contains("_taken", e["key"]))
    came = F.filter(F.map_entries(new), lambda e: F.array_contains("_taken", e["key"]))
    out = out.withColumn("_m", F.when(F.size("_taken") > 0, F.to_json(F.map_from_entries(F.concat(left, came)))).otherwise(F.to_json("_o")))
    out = judged(out.withColumn("_n", F.try_parse_json("_m")), "_n", schema, relations, "_judged").withColumn("_failed", failed_fields(F.col("_judged")))
    fresh = F.array_except("_failed", F.col(failed))
    error = F.when(F.col("_c").isNull(), "invalid JSON").when(F.size(fresh) > 0, F.concat(F.lit("merge introduced new errors: "), F.array_join(fresh, ", ")))
    fine = lambda c: F.when(F.col("retry_error").isNull(), c)
    out = out.withColumn("retry_error", error).withColumns({"merged": fine(F.col("_m")), "merged_fields": fine(F.col("_taken")), "still_failed": fine(F.col("_failed"))})
    return out.drop("_o", "_c", "_taken", "_m", "_n", "_judged", "_failed")


def guarded(attempts: DataFrame, keys: list[str], retries: int, timeout: float) -> DataFrame:
    """keys, status, attempts, json, codes, feedback of checked attempts: keys, attempt (from 0), seconds (from the start), valid, json, codes, feedback.

    The first attempt that passes ends a key; one asked for after `timeout` seconds ends it with
    G002; a key without feedback to go on ends with G003. Codes are those of all failures in order.
    """
    row = F.struct("attempt", "seconds", "valid", "json", "codes", "feedback")
    rows = attempts.where((F.col("attempt") >= 0) & (F.col("attempt") <= retries)).groupBy(*keys).agg(F.array_sort(F.collect_set(row)).alias("rows"))
    late = F.filter("rows", lambda r: r["seconds"] > timeout)
    before = lambda at: F.when(at.isNull(), F.col("rows")).otherwise(F.filter("rows", lambda r: r["attempt"] < at))
    out = rows.withColumn("_late", F.get(late, F.lit(0))["attempt"]).withColumn("_tried", before(F.col("_late")))
    out = out.withColumn("_pass", F.get(F.filter("_tried", lambda r: r["valid"]), F.lit(0)))
    failed = F.filter("_tried", lambda r: F.col("_pass").isNull() | (r["attempt"] < F.col("_pass.attempt")))
    out = out.withColumn("_failed", failed).withColumn("_last", F.get(F.transform("_failed", lambda r: r["feedback"]), F.size("_failed") - 1))
    passed, timed = F.col("_pass").isNotNull(), F.col("_late").isNotNull()
    none = F.array().cast("array<string>")
    extra = F.when(passed, none).otherwise(F.concat(F.when(timed, F.array(F.lit("G002"))).otherwise(none), F.when(F.col("_last").isNull(), F.array(F.lit("G003"))).otherwise(none)))
    n = F.size("_failed") + passed.cast("int")
    codes = F.concat(F.flatten(F.transform("_failed", lambda r: F.coalesce(r["codes"], none))), extra)
    return out.select(*keys, F.when(passed, "passed").when(timed, "timeout").otherwise("failed").alias("status"), n.alias("attempts"), F.col("_pass.json").alias("json"), codes.alias("codes"), F.when(~passed, F.col("_last")).alias("feedback"))
