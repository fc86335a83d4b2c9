"""From text to a checked record: repair, coercion by schema, validation, codes and feedback in one plan.

coerced() compiles a schema to a Column that writes a VARIANT anew as JSON text, each part as
near to its schema as its text allows; coercions() compiles the same schema to the changes. Such
Columns look a value up for every keyword, so checked() and coerced_text() go along the values
instead (typed.py), a text once.
Text inside a string that holds JSON is read strictly there.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import to_boolean
from ..functions.repair import parsed
from ..stage import sealed
from .nested import NONE, _Value, errors_of_json, field, strict
from .schemas import resolved
from .straight import text_of
from .typed import DEEPEST, Typed, change_array
from .typed import checked as typed_rows
from .walk import _FRAMES, Walk, error_array, walked
from .walk import compiled as instructions

CHANGES = "array<struct<field:string,original:string,coerced:string,type:string>>"


def _quoted(c: Column) -> Column:
    """A text as JSON writes it."""
    whole = F.to_json(F.array(c))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def number_text(c: Column) -> Column:
    """The JSON number that a text stands for, with thousands commas or a suffix k or m; null if none."""
    s = F.trim(F.replace(c, F.lit(","), F.lit("")))
    body = F.regexp_replace(s, "[kKmM]$", "")
    factor = F.when(s.rlike("[kK]\\z"), 1e3).when(s.rlike("[mM]\\z"), 1e6)
    real = F.when(body.rlike(r"\A[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\z"), body.try_cast("double"))
    whole = F.when(s.rlike(r"\A[+-]?\d+\z"), s.try_cast("long"))
    return F.when(factor.isNotNull(), (real * factor).cast("string")).otherwise(F.coalesce(whole.cast("string"), F.when(F.abs(real) < float("inf"), real.cast("string"))))


def _member(text: Column, options: list) -> Column:
    """The JSON text of the option that a text names: itself, but for case, or a number that is written so; null if none."""
    out = [F.when(text == o, F.lit(json.dumps(o, ensure_ascii=False))) for o in options if isinstance(o, str)]
    out += [F.when(F.lower(text) == o.lower(), F.lit(json.dumps(o, ensure_ascii=False))) for o in options if isinstance(o, str)]
    out += [F.when(text == json.dumps(o), F.lit(json.dumps(o))) for o in options if isinstance(o, (int, float)) and not isinstance(o, bool)]
    return F.coalesce(*out) if out else F.lit(None).cast("string")


def _kinds(schema: dict) -> set:
    t = schema.get("type", [])
    return set(t if isinstance(t, list) else [t])


def coerced(schema: object, v: Column, root: object = None, depth: int = 0) -> Column:
    """JSON text of a present VARIANT, coerced."""
    root = schema if root is None else root
    own = F.to_json(v)
    if not isinstance(schema, dict) or depth > DEEPEST * 2:
        return own
    schema = resolved(schema, root if isinstance(root, dict) else {})
    if "$ref" in schema or "const" in schema:
        return own
    x = _Value(v)
    inner = lambda s, w: coerced(s, w, root, depth + 1)
    union = schema.get("anyOf") or schema.get("oneOf")
    if union:
        return _of_union([resolved(s, root) for s in union if isinstance(s, dict)], x, own, inner)
    kinds = _kinds(schema)
    if kinds == {"string"}:
        simple = x.string | x.number | (x.name == "BOOLEAN")
        text = F.trim(F.when(x.string, x.text).otherwise(own))
        return F.when(simple, F.coalesce(_member(text, schema.get("enum", [])), _quoted(text))).otherwise(own)
    if kinds == {"array"}:
        items = schema.get("items", {})
        many = lambda values: F.concat(F.lit("["), F.array_join(F.transform(values, lambda e: inner(items, e)), ","), F.lit("]"))
        keys = F.map_keys(x.fields)
        places = F.transform(F.sequence(F.lit(0), F.size(keys)), lambda i: i.cast("string"))
        indexed = x.object & (F.size(F.array_except(F.slice(places, F.lit(1), F.size(keys)), keys)) == 0)
        in_order = F.transform(F.slice(places, F.lit(1), F.size(keys)), lambda k: F.try_element_at(x.fields, k))
        return F.when(x.array, many(x.items)).when(indexed & (F.size(keys) == 0), "[]").when(indexed, many(in_order)).otherwise(F.concat(F.lit("["), inner(items, v), F.lit("]")))
    options = schema.get("enum")
    read = F.try_parse_json(x.text)
    if options:
        from_text = _member(x.text, options)
    elif kinds & {"number", "integer"}:
        from_text = number_text(x.text)
    elif kinds == {"boolean"}:
        from_text = to_boolean(x.text).cast("string")
    elif kinds == {"null"}:
        low = F.lower(F.trim(x.text))
        from_text = F.when(low.isin("n", "nu", "nul", "null"), "null")
    else:
        from_text = F.when(F.schema_of_variant(read).startswith("OBJECT"), F.to_json(read)) if "object" not in kinds else None
    if kinds == {"object"} or "properties" in schema:
        whole = _object(schema, v, x, inner)
        # An object written inside a string: read, then coerced as one.
        nested = F.when(x.string & F.schema_of_variant(read).startswith("OBJECT"), _object(schema, read, _Value(read), inner)) if depth < 2 else F.lit(None).cast("string")
        out = F.when(x.object, whole).otherwise(F.coalesce(nested, own))
    else:
        out = F.when(x.string & from_text.isNotNull(), from_text).otherwise(own) if from_text is not None else own
    if "default" in schema:
        out = F.when(x.name == "VOID", F.lit(json.dumps(schema["default"], ensure_ascii=False))).otherwise(out)
    return out


def _object(schema: dict, v: Column, x: _Value, inner) -> Column:
    properties, parts = schema.get("properties", {}), []
    for name, s in properties.items():
        there = field(v, name)
        text = inner(s, there)
        if isinstance(s, dict) and "default" in s:
            text = F.when(there.isNull() | (F.schema_of_variant(there) == "VOID"), F.lit(json.dumps(s["default"], ensure_ascii=False))).otherwise(text)
        parts.append(F.concat(F.lit(json.dumps(name, ensure_ascii=False) + ":"), text))
    entries = F.filter(F.map_entries(x.fields), lambda e: ~e["key"].isin(*properties)) if properties else F.map_entries(x.fields)
    other = schema.get("additionalProperties")
    rest = F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit(":"), inner(other, e["value"]) if isinstance(other, dict) else F.to_json(e["value"])))
    known = F.array_compact(F.array(*parts)) if parts else F.array().cast("array<string>")
    return F.concat(F.lit("{"), F.array_join(F.concat(known, rest), ","), F.lit("}"))


def _of_union(variants: list[dict], x: _Value, own: Column, inner) -> Column:
    """A string stays if a variant takes strings, else it is what the one variant that can read it makes of it; containers go by the one variant of their kind."""
    kinds = [_kinds(s) for s in variants]
    one = lambda kind: next((s for s, k in zip(variants, kinds, strict=True) if kind in k), None) if sum(kind in k for k in kinds) == 1 else None
    out = own
    if not any("string" in k for k in kinds):
        read = [inner(s, x.v) for s, k in zip(variants, kinds, strict=True) if k & {"number", "integer", "boolean", "null"}]
        changed = F.array_compact(F.array(*[F.when(r != own, r) for r in read])) if read else None
        if changed is not None:
            out = F.when(x.string & (F.size(changed) == 1), F.get(changed, F.lit(0))).otherwise(out)
    for kind, there in (("object", x.object), ("array", x.array)):
        if one(kind):
            out = F.when(there, inner(one(kind), x.v)).otherwise(out)
    return out


def _change(v: Column, c: Column) -> Column:
    """The name of what turned one value into another."""
    a, b = _Value(v), _Value(c)
    from_text = (
        F.when(b.number, F.when(b.name.rlike("INT"), "string_to_int").otherwise("string_to_number")).when(b.name == "BOOLEAN", "string_to_bool").when(b.name == "VOID", "string_to_null")
        .when(b.object, "string_to_object").when(b.array, "string_to_array").when(F.lower(a.text) == F.lower(b.text), "enum_case").when(F.trim(a.text) == b.text, "string_trim").otherwise("string_transform")
    )
    return F.when(a.string, from_text).when(b.string & a.number, "number_to_string").when(b.string & (a.name == "BOOLEAN"), "bool_to_string").when(a.name == "VOID", "default_fill").otherwise("unknown")


def coercions(schema: object, v: Column, c: Column, path: str | Column = "", root: object = None, depth: int = 0) -> Column:
    """Changes between a VARIANT and what coerced() made of it, by field."""
    root = schema if root is None else root
    none = F.array().cast(CHANGES)
    at = path if isinstance(path, Column) else F.lit(path)
    row = F.struct(at.alias("field"), F.to_json(v).alias("original"), F.to_json(c).alias("coerced"), _change(v, c).alias("type"))
    leaf = F.when(F.to_json(v) == F.to_json(c), none).otherwise(F.array(row))
    schema = resolved(schema, root) if isinstance(schema, dict) else {}
    if depth > DEEPEST:
        return leaf
    x, y = _Value(v), _Value(c)
    if schema.get("properties"):
        parts = []
        for name, s in schema["properties"].items():
            was, now = field(v, name), field(c, name)
            where = (f"{path}.{name}" if path else name) if not isinstance(path, Column) else F.concat(path, F.lit(f".{name}"))
            filled = F.array(F.struct((where if isinstance(where, Column) else F.lit(where)).alias("field"), F.lit("null").alias("original"), F.to_json(now).alias("coerced"), F.lit("default_fill").alias("type")))
            parts.append(F.when(now.isNull(), none).when(was.isNull(), filled).otherwise(coercions(s, was, now, where, root, depth + 1)))
        return F.when(x.object & y.object, F.flatten(F.array(*parts))).otherwise(leaf)
    if _kinds(schema) == {"array"}:
        def item(i: Column) -> Column:
            return coercions(schema.get("items", {}), F.get(x.items, i), F.get(y.items, i), F.concat(at, F.lit("["), i.cast("string"), F.lit("]")), root, depth + 1)

        n = F.least(F.size(x.items), F.size(y.items))
        return F.when(x.array & y.array, F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(0), n - 1), item))).otherwise(none)).otherwise(leaf)
    return leaf


_CHECKED = f"struct<json:string,changes:{CHANGES},errors:{NONE},codes:array<string>,feedback:string,valid:boolean>"


def checked_batch(typed: Typed, walk: Walk, texts: pa.Array) -> pa.StructArray:
    """What checked() tells of each text of a batch; texts that repeat in it are checked once."""
    apart = texts.dictionary_encode(null_encoding="encode")
    found = [typed_rows(typed, walk, t) for t in apart.dictionary.to_pylist()]
    of = lambda name: [x[name] for x in found]
    words, flags = pa.string(), pa.bool_()
    fields = [pa.array(of("json"), words), change_array(of("changes")), error_array(of("errors")), pa.array(of("codes"), pa.list_(words)), pa.array(of("feedback"), words), pa.array(of("valid"), flags)]
    return pa.StructArray.from_arrays(fields, names=["json", "changes", "errors", "codes", "feedback", "valid"]).take(apart.indices)


def checked(df: DataFrame, text: str, schema: dict, closed: bool = False) -> DataFrame:
    """df with json (repaired and coerced), changes, errors, codes, feedback and valid, in one pass over the text.

    codes: those of a failed parse alone, else one for each error and V100 beyond five.
    feedback: the record with its errors, where it could be read and has any.
    closed: properties that the schema doesn't list are errors.
    """
    rows = instructions(strict(schema) if closed else schema)

    @F.arrow_udf(_CHECKED)
    def run(texts: pa.Array) -> pa.Array:
        sys.setrecursionlimit(_FRAMES)
        walk, typed = Walk([(at, op, json.loads(arg), to) for at, op, arg, to in rows]), Typed(schema)
        return checked_batch(typed, walk, texts)

    names = ["json", "changes", "errors", "codes", "feedback", "valid"]
    return sealed(df.withColumn("_checked", run(F.col(text))).withColumns({n: F.col(f"_checked.{n}") for n in names}).drop("_checked"), *names)


def coerced_text(schema: object, text: Column) -> Column:
    """What coerced() gives for a JSON text, in one pass over it; null for what isn't JSON."""

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        sys.setrecursionlimit(_FRAMES)
        typed = Typed(schema)
        return pa.array([typed.text(t) for t in texts.to_pylist()], pa.string())

    return run(text)


def errors_of_text(schema: object, text: Column) -> Column:
    """Errors of a JSON text, none for null."""
    return F.when(text.isNotNull(), walked(schema, text, text_of)).otherwise(F.array().cast(NONE))


def field_confidence(schema: dict, v: Column, c: Column, errors: Column) -> Column:
    """A struct (field, confidence, status) for each property: 0 where an error is at or below it, 1 where nothing was guessed, less otherwise."""
    rows = []
    for name, s in schema["properties"].items():
        was, now = field(v, name), field(c, name)
        a, b = _Value(was), _Value(now)
        bad = F.exists(errors, lambda e: _at(e["path"], name))
        same = F.coalesce(F.to_json(was) == F.to_json(now), was.isNull() & now.isNull())
        numeric = a.string & b.number
        trust = (
            F.when(bad, 0.0).when(same, 1.0).when(numeric & a.text.rlike(r"\A\s*[+-]?\d+(\.\d+)?\s*\z"), 1.0).when(a.string & b.string & (F.trim(a.text) == b.text), 1.0)
            .when(a.string & b.string & (F.lower(F.trim(a.text)) == F.lower(b.text)), 0.9).when(b.array & ~a.array, 0.9).when(was.isNull() | (a.name == "VOID"), 0.6).otherwise(0.7)
        )
        rows.append(F.struct(F.lit(name).alias("field"), trust.alias("confidence"), F.when(bad, "invalid").when(same, "valid").otherwise("coerced").alias("status")))
    return F.array(*rows)


def _at(path: Column, name: str) -> Column:
    own = f"$input.{name}"
    return (path == own) | path.startswith(own + ".") | path.startswith(own + "[")
