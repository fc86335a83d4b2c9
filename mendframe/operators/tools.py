"""Callable tools: API descriptions as tools, calls checked and dispatched, constraints and diagnostics as text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .validate import errors_of

METHODS = ["get", "post", "put", "patch", "delete"]
LONGEST = 16 * 1024 * 1024


def tool_name(c: Column) -> Column:
    return F.substring(F.regexp_replace(c, "[^A-Za-z0-9_]", "_"), 1, 64)


def api_tools(specs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, name, description, method, path, parameters of every operation in API documents (column `body`, JSON text)."""
    by_path = specs.select(*keys, F.explode(F.from_json(F.get_json_object("body", "$.paths"), "map<string,string>")).alias("path", "methods"))
    ops = by_path.select(*keys, "path", F.explode(F.from_json("methods", "map<string,string>")).alias("method", "op")).where(F.col("method").isin(*METHODS))
    said = F.coalesce(F.get_json_object("op", "$.summary"), F.get_json_object("op", "$.description"), F.lit(""))
    params = F.from_json(F.get_json_object("op", "$.parameters"), "array<struct<name:string,required:boolean,schema:struct<type:string>>>")
    fields = F.transform(F.coalesce(params, F.array().cast("array<struct<name:string,required:boolean,schema:struct<type:string>>>")), lambda p: F.struct(F.coalesce(p["name"], F.lit("_")).alias("name"), F.coalesce(p["schema"]["type"], F.lit("string")).alias("type"), F.coalesce(p["required"], F.lit(False)).alias("required")))
    name = tool_name(F.coalesce(F.get_json_object("op", "$.operationId"), F.col("path")))
    return ops.select(*keys, name.alias("name"), F.concat_ws("", "method", F.lit(" "), "path", F.lit(" - "), said).alias("description"), "method", "path", fields.alias("parameters"))


def dispatched(calls: DataFrame, schemas: dict[str, dict], handlers: dict[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """call_id, name, result, error of calls (call_id, name and the arguments as columns): known functions with a handler run on valid arguments."""
    names = list(schemas)
    out = calls.where(F.coalesce(~F.col("name").isin(*names), F.lit(True))).select("call_id", "name", F.lit(None).cast("string").alias("result"), F.concat(F.lit("function '"), F.coalesce("name", F.lit("")), F.lit("' not found")).alias("error"))
    for name, schema in schemas.items():
        own = calls.where(F.col("name") == name).withColumn("_errors", errors_of(schema))
        bad = F.array_join(F.transform("_errors", lambda e: F.concat(e["path"], F.lit(": expected "), e["expected"])), "; ")
        if name in handlers:
            ok = F.size("_errors") == 0
            rows = own.select("call_id", "name", F.when(ok, handlers[name](own)).cast("string").alias("result"), F.when(~ok, bad).alias("error"))
        else:
            rows = own.select("call_id", "name", F.lit(None).cast("string").alias("result"), F.lit(f"no dispatcher for '{name}'").alias("error"))
        out = out.unionByName(rows)
    return out


def constrained_description() -> Column:
    """A property row's description with its limits in words; one that has them stays."""
    number = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
    members = F.when(F.col("values").isNotNull(), F.concat(F.lit("allowed: ["), F.array_join(F.transform("values", lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", "), F.lit("]")))
    said = F.concat_ws(", ", F.concat(F.lit("minimum: "), number("minimum")), F.concat(F.lit("maximum: "), number("maximum")), F.concat(F.lit("format: "), "format"), members, F.concat(F.lit("default: "), "default"))
    d = F.coalesce("description", F.lit(""))
    return F.when(said == "", F.col("description")).when(d.contains("@constraints"), d).otherwise(F.concat(d, F.when(d == "", "").otherwise(" "), F.lit("@constraints "), said))


def parse_code(c: Column) -> Column:
    """Why a text holds no JSON: P003 too large, P001 empty, P002 nothing that starts a value; null if it may."""
    bare = F.trim(F.coalesce(c, F.lit("")))
    starts = bare.rlike(r'^["\d-]') | F.exists(F.array(*[F.lit(x) for x in ("true", "false", "null")]), lambda k: (bare != "") & (bare.startswith(k) | k.startswith(bare))) | F.lower(bare).isin("yes", "y", "on", "no", "off")
    return F.when(F.octet_length(c) > LONGEST, "P003").when(bare == "", "P001").when(~bare.rlike(r"[{\[]") & ~starts, "P002")
