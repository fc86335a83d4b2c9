"""Catalogs of schemas: diagnostics as text and JSON, partial schemas, cases on relations, fields that mean the same.

similar_fields() finds pairs of fields whose vectors are alike by signed random projections: a
band is the signs of `bits` projections, and two vectors at angle t agree on one with
probability 1 - t / pi. Fields that share a band are compared exactly. Fields of equal vectors
are one class, compared once, so copies never meet in pairs; the members of a class come with
it. Vectors are sealed, else conditions on them would be worked out for every row below a distinct
that names them once. Null, empty and zero vectors are like nothing, nor are vectors of another length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import sealed
from .fields import worked_out_once
from .packages import lint

#: Vectors whose bands are made at once: a vector comes once a band.
AT_ONCE = 128
# Severity, message and help of each code.
DIAGNOSTICS = {
    "S001": ("Error", "Cannot read schema", "Ensure the schema exists and is readable."),
    "S002": ("Error", "Schema is not valid JSON", "Regenerate the schema from your type definitions.\nDo not manually edit generated schema files."),
    "S003": ("Warning", "Schema has no top-level type constraint", 'The schema does not define a "type" field at the root.\nThis means any JSON value will pass validation.\nAdd "type": "object" (or array/string/etc) to constrain.'),
    "S004": ("Warning", 'Schema has properties but no "required" array', 'Without "required", all properties are optional.\nLLMs may omit fields. Add a "required" array with essential field names.'),
}


def diagnostics(packages: DataFrame, key: str) -> DataFrame:
    """key, code, severity, message, help, context of loaded packages (text and schema): no text, no JSON, no type, nothing required."""
    first = packages.where("text is null or schema is null").select(key, F.when(F.col("text").isNull(), "S001").otherwise("S002").alias("code"), F.when(F.col("text").isNotNull(), F.concat(F.lit("schema: "), F.col(key).cast("string"))).alias("context"))
    rest = lint(packages.where("schema is not null"), key).where("code in ('LINT001', 'LINT002')").select(key, F.when(F.col("code") == "LINT001", "S003").otherwise("S004").alias("code"), F.lit(None).cast("string").alias("context"))
    told = lambda i: F.coalesce(*[F.when(F.col("code") == c, F.lit(d[i])) for c, d in DIAGNOSTICS.items()])
    return first.unionByName(rest).select(key, "code", told(0).alias("severity"), told(1).alias("message"), told(2).alias("help"), "context")


def as_text() -> Column:
    """A diagnostic's columns in words."""
    context = F.when(F.col("context").isNotNull(), F.concat(F.lit("\n  context: "), "context")).otherwise("")
    return F.concat(F.lit("["), F.lower("severity"), F.lit("]["), "code", F.lit("] "), "message", context, F.lit("\n  help: "), "help")


def as_json() -> Column:
    """A diagnostic's columns as a JSON object."""
    return F.to_json(F.struct("code", "context", "help", "message", F.lower("severity").alias("severity")), {"ignoreNullFields": "false"})


def partial(schema: Column) -> Column:
    """A schema text without what it requires at its top; one that is no object stays."""
    v = F.try_parse_json(schema)
    held = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$", "map<string,variant>"))
    return F.coalesce(F.to_json(F.map_filter(held, lambda k, _: k != "required")), F.to_json(v))


def relation_cases(relations: DataFrame) -> DataFrame:
    """relations (field_a, operator, field_b, ...) with field, value (JSON), description and valid of records on both sides of each; other operators than lte, gte and eq have none."""
    a, b, op = F.col("field_a"), F.col("field_b"), F.col("operator")
    turn = op == "gte"
    low, high = F.when(turn, b).otherwise(a), F.when(turn, a).otherwise(b)
    key = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)

    def case(x: Column, y: Column, n: int, sign: str, said: str, valid: bool) -> Column:
        record = F.concat(F.lit("{"), key(x), F.lit(f":{n},"), key(y), F.lit(":10}"))
        return F.struct(F.concat_ws(",", x, y).alias("field"), record.alias("value"), F.concat(x, F.lit(sign), y, F.lit(f" ({said})")).alias("description"), F.lit(valid).alias("valid"))

    order = F.array(case(low, high, 10, "==", "boundary", True), case(low, high, 11, ">", "violation", False), case(low, high, 9, "<", "safe", True))
    same = F.array(case(a, b, 10, "==", "correct", True), case(a, b, 11, "!=", "violation +1", False), case(a, b, 9, "!=", "violation -1", False))
    return relations.select("*", F.inline(F.when(op.isin("lte", "gte"), order).when(op == "eq", same)))


def name_vector(name: Column, size: int = 64) -> Column:
    """A field name as counts of its hashed three-letter pieces: a vector where no model is at hand."""
    text = F.concat(F.lit("^"), F.lower(name), F.lit("$"))
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))
    place = F.transform(parts, lambda p: F.conv(F.substring(F.md5(p), 1, 4), 16, 10).cast("int") % size)
    return worked_out_once(place, lambda at: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda d: F.size(F.filter(at, lambda p: p == d)).cast("double")))


def similar_fields(fields: DataFrame, least: float = 0.8, bits: int = 10, bands: int = 48, seed: int = 5) -> tuple[DataFrame, DataFrame]:
    """(a, b, similarity of pairs of classes, by the least name of each; name, class) of fields (name, vector).

    bits and bands set what is found and what it costs: a pair at cosine 0.8 shares a band with
    probability 1 - (1 - 0.795 ** bits) ** bands, 0.992 as they stand; more fields want more of both.
    """
    named = sealed(fields, "vector").where(F.col("name").isNotNull() & F.coalesce(F.exists("vector", lambda x: x != 0), F.lit(False)) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x)))
    wide = named.withColumn("vector", F.transform("vector", lambda x: x.cast("double")))
    classes = wide.groupBy("vector").agg(F.min("name").alias("class"))
    members = wide.join(classes, "vector").select("name", "class").distinct()

    def run(batches):
        planes: dict[int, np.ndarray] = {}
        for whole in batches:
            for batch in (whole.slice(lo, AT_ONCE) for lo in range(0, whole.num_rows, AT_ONCE)):
                names, vectors = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                out: tuple[list, list, list] = ([], [], [])
                for name, v in zip(names, vectors, strict=True):
                    if len(v) not in planes:
                        planes[len(v)] = np.random.Generator(np.random.PCG64(seed)).standard_normal((len(v), bits * bands))
                    x = np.array(v)
                    signs = ((x @ planes[len(v)]) > 0).reshape(bands, bits) @ (1 << np.arange(bits))
                    out[0].extend([name] * bands)
                    out[1].extend(((np.arange(bands) << 40) + (len(v) << 24) + signs).tolist())
                    out[2].extend([(x / np.linalg.norm(x)).tolist()] * bands)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.float64()))], names=["class", "band", "unit"])

    banded = classes.select("class", "vector").mapInArrow(run, "class string, band long, unit array<double>")
    a, b = banded.alias("a"), banded.alias("b")
    dot = F.aggregate(F.zip_with("a.unit", "b.unit", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    met = a.join(b, (F.col("a.band") == F.col("b.band")) & (F.col("a.class") < F.col("b.class")) & (dot >= least))
    pairs = met.groupBy(F.col("a.class").alias("a"), F.col("b.class").alias("b")).agg(F.max(dot).alias("similarity"))
    return pairs, members


def unifiable(fields: DataFrame, least: float = 0.8) -> DataFrame:
    """field_pattern, description of pairs of field classes that might be one field."""
    pairs, _ = similar_fields(fields, least)
    return pairs.select(F.concat_ws(" ~ ", "a", "b").alias("field_pattern"), F.format_string("semantically similar fields (cosine=%.2f), consider unifying", "similarity").alias("description"))
