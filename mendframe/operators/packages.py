"""Schema packages as rows: what a package's text holds, lint of its schema, counterexamples held against it.

A package is a JSON object with a `schema` that has a type or properties, beside it relations,
rules and counterexamples; any other JSON text is a schema by itself. All parts are Columns
over VARIANT; counterexamples meet their own schema as records meet schemas by key (walk.py).
A text that isn't JSON gives nulls and is one finding of its own; entries of the wrong shape
are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .walk import validated_by


def _part(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$['{name}']", "variant")


def _text(v: Column) -> Column:
    """A VARIANT's text if it is one."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _list(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$['{name}']", "array<variant>"), F.array().cast("array<variant>"))


def loaded(df: DataFrame, text: str) -> DataFrame:
    """df with package (whether it is one), schema (JSON text), relations, rules and counterexamples (JSON texts) of a text column."""
    v = F.col("_v")
    inner = _part(v, "schema")
    is_package = F.coalesce(_part(inner, "type").isNotNull() | _part(inner, "properties").isNotNull(), F.lit(False))
    relation = lambda r: F.struct(*[_text(_part(r, k)).alias(k) for k in ("field_a", "operator", "field_b")])
    relations = F.filter(F.transform(_list(v, "relations"), relation), lambda r: r["field_a"].isNotNull() & r["operator"].isNotNull() & r["field_b"].isNotNull())
    rule = lambda r: F.struct(F.coalesce(_text(_part(r, "description")), F.lit("unnamed rule")).alias("description"), F.to_json(_part(r, "logic")).alias("logic"))
    rules = F.filter(F.transform(_list(v, "rules"), rule), lambda r: r["logic"].isNotNull())
    counter = F.transform(_list(v, "counterexamples"), lambda c: F.to_json(c))
    only = lambda c: F.when(is_package, c)
    out = {"package": is_package, "schema": F.to_json(F.when(is_package, inner).otherwise(v)), "relations": only(relations), "rules": only(rules), "counterexamples": only(counter)}
    return df.withColumn("_v", F.try_parse_json(text)).withColumns(out).drop("_v")


_BY = ("type", "anyOf", "oneOf", "$ref")
_FINDING = "struct<code:string,message:string>"


def lint(packages: DataFrame, key: str) -> DataFrame:
    """key, code, message of loaded packages: no type, nothing required, properties without a constraint (by name), no JSON."""
    v, said = F.col("_v"), lambda code, m: F.struct(F.lit(code).alias("code"), (m if isinstance(m, Column) else F.lit(m)).alias("message"))
    lacks = lambda x, names: ~F.coalesce(*[F.when(_part(x, n).isNotNull(), True) for n in names], F.lit(False))
    entries = F.coalesce(F.map_entries(F.try_variant_get(v, "$.properties", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    loose = F.transform(F.filter(entries, lambda e: lacks(e["value"], (*_BY, "enum", "const"))), lambda e: said("LINT003", F.concat(F.lit("property '"), e["key"], F.lit("' has no type constraint"))))
    one = lambda bad, code, m: F.when(bad, F.array(said(code, m))).otherwise(F.array().cast(f"array<{_FINDING}>"))
    found = F.flatten(F.array(
        one(lacks(v, _BY), "LINT001", "schema has no top-level type constraint"),
        one(_part(v, "properties").isNotNull() & _part(v, "required").isNull(), "LINT002", "schema has properties but no 'required' array"),
        loose,
    ))
    all_ = F.when(F.col("schema").isNull(), F.array(said("LINT000", "not JSON"))).otherwise(found)
    return packages.withColumn("_v", F.try_parse_json("schema")).select(key, F.explode(all_).alias("f")).select(key, "f.*")


def loose_counterexamples(packages: DataFrame, key: str) -> DataFrame:
    """key, place (from 1), counterexample of those that their own schema lets pass."""
    each = packages.select(F.col(key), F.posexplode("counterexamples").alias("_at", "counterexample")).withColumn("place", F.col("_at") + 1)
    checked = validated_by(each, "counterexample", key, packages.where("package").select(key, "schema"), coerce=True)
    return checked.where("valid").select(key, "place", "counterexample")


def findings(packages: DataFrame, key: str) -> DataFrame:
    """key, code, message: lint of every schema and a warning for each counterexample that passes."""
    passed = F.format_string("Counterexample %d passed validation — schema may be too loose", F.col("place"))
    loose = loose_counterexamples(packages, key).select(key, F.lit("CE001").alias("code"), passed.alias("message"))
    return lint(packages, key).unionByName(loose)
