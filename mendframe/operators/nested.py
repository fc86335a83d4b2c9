"""Validation of nested records: a JSON Schema compiled to one Column over a VARIANT.

Each keyword becomes a Column, each level of arrays a transform, so a scan of JSON text, its
parsing and all checks are one stage; the schema is walked once, on the driver. An error's path
is built beside the value ($input.items[2].price). References are followed by copying the schema
they name. Schemas that hold themselves, or that ask what has been evaluated, can't be one
Column: walk.py follows those along the data, to any depth. Keywords that JSON Schema doesn't
know are ignored.

An absent value is SQL null and breaks nothing but `required`; a JSON null is a value.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable
from decimal import Decimal

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.formats import is_format
from ..functions.plain import engine
from ..stage import sealed
from .validate import ERROR

#: Names that are shown as places.
PLACE = re.compile(r"\+?[0-9]{1,19}")
TYPES = {"array", "boolean", "integer", "null", "number", "object", "string"}
NONE = f"array<{ERROR}>"


def strict(schema: object) -> object:
    """The schema with additionalProperties false wherever properties are listed and nothing is said of others."""
    if not isinstance(schema, dict):
        return schema
    out = dict(schema)
    if "properties" in out:
        out.setdefault("additionalProperties", False)
    for k in ("properties", "$defs", "definitions"):
        if isinstance(out.get(k), dict):
            out[k] = {n: strict(s) for n, s in out[k].items()}
    for k in ("allOf", "anyOf", "oneOf"):
        if isinstance(out.get(k), list):
            out[k] = [strict(s) for s in out[k]]
    if "items" in out:
        out["items"] = strict(out["items"])
    return out


def _defs(root: object) -> dict:
    return (root.get("$defs") or root.get("definitions") or {}) if isinstance(root, dict) else {}


def _named(reference: str) -> str | None:
    m = re.fullmatch(r"#/(?:\$defs|definitions)/([^/]+)", reference)
    return m[1].replace("~1", "/").replace("~0", "~") if m else None


def recursive(root: object) -> bool:
    """Whether a schema can't be written out as one Column: it comes back to itself, or asks what has been evaluated."""
    from .walk import compiled as instructions

    below: dict[int, list[int]] = {}
    for at, op, _, to in instructions(root):
        if op.startswith("unevaluated"):
            return True
        below.setdefault(at, []).extend(to)
    state: dict[int, int] = {}  # 1: open, 2: done
    stack = [(0, False)]
    while stack:
        at, done = stack.pop()
        if done:
            state[at] = 2
        elif state.get(at) != 2:
            state[at] = 1
            stack.append((at, True))
            for t in below.get(at, []):
                if state.get(t) == 1:
                    return True
                stack.append((t, False))
    return False


def circular(root: object) -> bool:
    """Whether a chain of definitions that are references only comes back to itself."""
    defs = _defs(root)
    for name in defs:
        seen = set()
        while isinstance(defs.get(name), dict) and "$ref" in defs[name]:
            if name in seen:
                return True
            seen.add(name)
            name = _named(defs[name]["$ref"]) or ""
    return False


def fault(schema: object) -> str | None:
    """What makes a schema itself invalid: unknown types, patterns that don't compile, limits that are no numbers."""
    if isinstance(schema, bool):
        return None
    if not isinstance(schema, dict):
        return f"{json.dumps(schema)} is not of types boolean, object"
    kinds = schema.get("type", [])
    for k in kinds if isinstance(kinds, list) else [kinds]:
        if k not in TYPES:
            return f"{json.dumps(k)} is not a type"
    for k in ("minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "multipleOf", "minLength", "maxLength", "minItems", "maxItems", "minProperties", "maxProperties"):
        if k in schema and (isinstance(schema[k], bool) or not isinstance(schema[k], (int, float))):
            return f"{json.dumps(schema[k])} is not of type number"
    for p in [*([schema["pattern"]] if "pattern" in schema else []), *schema.get("patternProperties", {})]:
        if not runs(p):
            return f"{json.dumps(p)} is not a regex"
    below = [schema[k] for k in ("items", "not", "if", "then", "else", "contains", "propertyNames", "additionalProperties") if isinstance(schema.get(k), dict)]
    below += [s for k in ("allOf", "anyOf", "oneOf", "prefixItems") for s in schema.get(k, [])] + [s for k in ("properties", "patternProperties", "$defs", "definitions") for s in schema.get(k, {}).values()]
    return next((f for s in below if (f := fault(s))), None)


def runs(pattern: object) -> bool:
    """Whether a pattern compiles in the tasks: by Python and, where a session is there, by Java."""
    try:
        engine.compile(pattern)
        if jvm := SparkContext._active_spark_context and SparkContext._active_spark_context._jvm:
            jvm.java.util.regex.Pattern.compile(pattern)
    except (engine.error, TypeError, RecursionError, OverflowError, Py4JJavaError):
        return False
    return True


def field(v: Column, name: str) -> Column:
    """A field of an object by name; null where it is absent."""
    for quote in "'", '"':  # a path knows no escapes
        if quote not in name:
            return F.try_variant_get(v, f"$[{quote}{name}{quote}]", "variant")
    return F.try_element_at(_as(v, "map<string,variant>"), F.lit(name))


def _as(v: Column, kind: str) -> Column:
    return F.try_variant_get(v, "$", kind)


class _Value:
    """A value's Columns by kind, made where a keyword asks for them."""

    def __init__(self, v: Column):
        self.v = v
        self.name = F.schema_of_variant(v)
        self.number = self.name.rlike("^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)")
        self.string = self.name == "STRING"
        self.array = self.name.startswith("ARRAY")
        self.object = self.name.startswith("OBJECT")
        self.text = _as(v, "string")
        self.double = _as(v, "double")
        self.items = _as(v, "array<variant>")
        self.fields = _as(v, "map<string,variant>")

    def has_type(self, kind: str) -> Column:
        return {
            "array": self.array, "object": self.object, "string": self.string, "number": self.number, "boolean": self.name == "BOOLEAN", "null": self.name == "VOID",
            "integer": self.number & (self.double == F.rint(self.double)),
        }[kind]

    def equals(self, option: object) -> Column:
        if isinstance(option, str):
            return self.string & (self.text == option)
        if isinstance(option, bool):
            return (self.name == "BOOLEAN") & (self.text == str(option).lower())
        if isinstance(option, (int, float)):
            return self.number & (self.double == float(option))
        if option is None:
            return self.name == "VOID"
        if isinstance(option, list):
            ok = self.array & (F.size(self.items) == len(option))
            for i, x in enumerate(option):
                ok = ok & F.coalesce(_Value(F.get(self.items, F.lit(i))).equals(x), F.lit(False))
            return ok
        ok = self.object & (F.size(self.fields) == len(option))
        for k, x in option.items():
            ok = ok & F.coalesce(_Value(field(self.v, k)).equals(x), F.lit(False))
        return ok


def is_multiple(exact: Column, rough: Column, of: float) -> Column:
    """Whether a number is a multiple: in decimals where the limit has ten places at most, else by the nearest quotient."""
    places = -Decimal(repr(of)).as_tuple().exponent
    near = F.abs(rough / F.lit(float(of)) - F.rint(rough / F.lit(float(of)))) < 1e-9
    return F.coalesce(F.pmod(exact, F.lit(Decimal(repr(of))).cast("decimal(38,10)")) == 0, near) if places <= 10 and math.isfinite(of) else near


def _error(path: Column, expected: str | Column, value: Column | None, description: str | Column | None = None) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(path.alias("path"), lit(expected).alias("expected"), (F.lit("null") if value is None else F.to_json(value)).alias("value"), lit(description).alias("description"))


def _when(bad: Column, *errors: Column) -> Column:
    return F.when(bad, F.array(*errors)).otherwise(F.array().cast(NONE))


def _all(parts: list[Column]) -> Column:
    return F.flatten(F.array(*parts)) if parts else F.array().cast(NONE)


def _below(there: Column, errors: Column) -> Column:
    """errors of a part, none where it is absent."""
    return F.when(there.isNotNull(), errors).otherwise(F.array().cast(NONE))


def _indexed(items: Column, check: Callable[[Column, Column], Column]) -> Column:
    return F.coalesce(F.flatten(F.transform(items, check)), F.array().cast(NONE))


def _matching(entries: Column, pattern: str, schema: object, inner: Callable, at: Callable) -> Column:
    return _indexed(F.filter(entries, lambda e: e["key"].rlike(pattern)), lambda e, _: inner(schema, e["value"], at(e["key"])))


def compiled(schema: object, v: Column, path: Column, root: object) -> Column:
    """Errors of a present value as an array Column, by a schema that doesn't hold itself."""
    if schema is True or schema == {}:
        return F.array().cast(NONE)
    if schema is False:
        return F.array(_error(path, "never (false schema)", v))
    x, parts = _Value(v), []
    inner = lambda s, w, p: compiled(s, w, p, root)
    passes = lambda s: F.size(inner(s, v, path)) == 0

    def add(bad: Column, expected: str | Column, description: str | Column | None = None) -> None:
        parts.append(_when(bad, _error(path, expected, v, description)))

    if "$ref" in schema:
        from .walk import target

        try:
            parts.append(inner(target(root, schema["$ref"]), v, path))
        except KeyError:
            parts.append(F.array(_error(path, "resolvable $ref", v, schema["$ref"])))
    if "type" in schema:
        kinds = sorted(schema["type"]) if isinstance(schema["type"], list) else [schema["type"]]
        ok = x.has_type(kinds[0])
        for k in kinds[1:]:
            ok = ok | x.has_type(k)
        add(~ok, kinds[0] if not isinstance(schema["type"], list) else f"({' | '.join(kinds)})")
    if "enum" in schema:
        ok = F.lit(False)
        for option in schema["enum"]:
            ok = ok | x.equals(option)
        add(~ok, f"one of {json.dumps(schema['enum'], separators=(',', ':'), ensure_ascii=False)}")
    if "const" in schema:
        add(~x.equals(schema["const"]), f"const {json.dumps(schema['const'], separators=(',', ':'), sort_keys=True, ensure_ascii=False)}")

    limits = {"minimum": ("Minimum", lambda a, b: a < b), "maximum": ("Maximum", lambda a, b: a > b), "exclusiveMinimum": ("ExclusiveMinimum", lambda a, b: a <= b), "exclusiveMaximum": ("ExclusiveMaximum", lambda a, b: a >= b)}
    for k, (label, broken) in limits.items():
        if k in schema:
            limit = schema[k]
            kind = "integer & " if isinstance(limit, int) else "number & "
            add(x.number & broken(x.double, F.lit(float(limit))), f"{kind}{label}<{limit}>")
    if schema.get("multipleOf"):  # 0 breaks nothing
        add(x.number & ~is_multiple(_as(v, "decimal(38,10)"), x.double, schema["multipleOf"]), f"number & MultipleOf<{schema['multipleOf']}>")

    if "minLength" in schema:
        add(x.string & (F.length(x.text) < schema["minLength"]), f"string & MinLength<{schema['minLength']}>")
    if "maxLength" in schema:
        add(x.string & (F.length(x.text) > schema["maxLength"]), f"string & MaxLength<{schema['maxLength']}>")
    if "pattern" in schema:
        add(x.string & ~x.text.rlike(schema["pattern"]), f'string & Pattern<"{schema["pattern"]}">')
    if "format" in schema:
        add(x.string & ~is_format(x.text, schema["format"]), f'string & Format<"{schema["format"]}">')

    if "minItems" in schema:
        add(x.array & (F.size(x.items) < schema["minItems"]), f"array & MinItems<{schema['minItems']}>")
    if "maxItems" in schema:
        add(x.array & (F.size(x.items) > schema["maxItems"]), f"array & MaxItems<{schema['maxItems']}>")
    if schema.get("uniqueItems"):
        texts = F.transform(x.items, lambda e: F.to_json(e))
        add(x.array & (F.size(F.array_distinct(texts)) < F.size(texts)), "array & UniqueItems", "Array contains duplicate elements.")
    place = lambda i: F.concat(path, F.lit("["), i.cast("string"), F.lit("]"))
    first = schema.get("prefixItems", schema["items"] if isinstance(schema.get("items"), list) else [])
    for i, s in enumerate(first):
        item = F.get(x.items, F.lit(i))
        parts.append(_below(item, inner(s, item, place(F.lit(i)))))
    rest = schema.get("additionalItems", True) if isinstance(schema.get("items"), list) else schema.get("items", True)
    if rest is False:
        add(x.array & (F.size(x.items) > len(first)), f"array with at most {len(first)} items")
    elif isinstance(rest, dict) and rest:
        parts.append(_indexed(x.items, lambda e, i: F.when(i >= len(first), inner(rest, e, place(i))).otherwise(F.array().cast(NONE))))
    if "contains" in schema:
        hits = F.coalesce(F.size(F.filter(x.items, lambda e: F.size(inner(schema["contains"], e, path)) == 0)), F.lit(0))
        few = hits < schema.get("minContains", 1)
        add(x.array & (few | (hits > schema["maxContains"]) if "maxContains" in schema else few), "array & Contains")

    missing = lambda name: F.concat(path, F.lit(f".{name}"))

    def at(name: str | Column) -> Column:
        if isinstance(name, str):
            return F.concat(path, F.lit(f"[{int(name)}]" if PLACE.fullmatch(name) else f".{name}"))
        return F.concat(path, F.when(name.rlike(rf"^{PLACE.pattern}\z"), F.concat(F.lit("["), name.try_cast("decimal(20,0)").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), name)))

    for name in schema.get("required", []):
        said = f"The value at this path is `undefined`.\n\nPlease fill the `{name}` typed value next time."
        parts.append(_when(x.object & field(v, name).isNull(), _error(missing(name), "required property", None, said)))
    if "minProperties" in schema:
        add(x.object & (F.size(x.fields) < schema["minProperties"]), f"object & MinProperties<{schema['minProperties']}>")
    if "maxProperties" in schema:
        add(x.object & (F.size(x.fields) > schema["maxProperties"]), f"object & MaxProperties<{schema['maxProperties']}>")
    properties, patterns = schema.get("properties", {}), schema.get("patternProperties", {})
    for name, s in properties.items():
        if s is not True and s != {}:
            parts.append(_below(field(v, name), inner(s, field(v, name), at(name))))
    entries = F.map_entries(x.fields)
    for pattern, s in patterns.items():
        parts.append(_matching(entries, pattern, s, inner, at))
    other = schema.get("additionalProperties", True)
    if other is not True and other != {}:
        known = lambda k: k.isin(*properties) if properties else F.lit(False)
        extra = F.filter(entries, lambda e: ~known(e["key"]) & ~sum_or([e["key"].rlike(p) for p in patterns]))
        if other is False:
            names = F.array_join(F.transform(extra, lambda e: F.concat(F.lit("unexpected property '"), e["key"], F.lit("'"))), ", ")
            add(x.object & (F.size(extra) > 0), "no extraneous properties", names)
        else:
            parts.append(_indexed(extra, lambda e, _: inner(other, e["value"], at(e["key"]))))
    if "propertyNames" in schema:
        named = F.transform(F.map_keys(x.fields), lambda k: F.try_variant_get(F.parse_json(F.to_json(F.array(k))), "$[0]", "variant"))
        add(x.object & F.coalesce(F.exists(named, lambda k: F.size(inner(schema["propertyNames"], k, path)) > 0), F.lit(False)), "valid property name at $input")
    for name, needs in {**schema.get("dependentRequired", {}), **{k: d for k, d in schema.get("dependencies", {}).items() if isinstance(d, list)}}.items():
        for other_name in needs:
            said = f"The value at this path is `undefined`.\n\nPlease fill the `{other_name}` typed value next time."
            parts.append(_when(x.object & field(v, name).isNotNull() & field(v, other_name).isNull(), _error(missing(other_name), "required property", None, said)))
    for name, s in {**schema.get("dependentSchemas", {}), **{k: d for k, d in schema.get("dependencies", {}).items() if not isinstance(d, list)}}.items():
        parts.append(_below(field(v, name), inner(s, v, path)))

    parts += [inner(s, v, path) for s in schema.get("allOf", [])]
    if "anyOf" in schema:
        add(~sum_or([passes(s) for s in schema["anyOf"]]), "union type")
    if "oneOf" in schema:
        n = sum((passes(s).cast("int") for s in schema["oneOf"]), F.lit(0))
        add(n != 1, "oneOf match", F.when(n == 0, "oneOf: expected exactly 1 match but found 0").otherwise("oneOf: expected exactly 1 match but found multiple"))
    if "not" in schema:
        add(passes(schema["not"]), "value NOT matching the sub-schema")
    if "if" in schema:
        parts.append(F.when(passes(schema["if"]), inner(schema.get("then", True), v, path)).otherwise(inner(schema.get("else", True), v, path)))
    return _all(parts)


def sum_or(parts: list[Column]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | p
    return out


def errors_of_json(schema: object, v: Column) -> Column:
    """All errors of a VARIANT against the schema; a schema that is itself at fault gives that as each record's error."""
    path = F.lit("$input")
    if circular(schema):
        return F.array(_error(path, "non-circular $ref", v, "$ref cycle detected in schema"))
    if said := fault(schema):
        return F.array(_error(path, "valid schema", v, said))
    if recursive(schema):
        from .walk import walked

        return walked(schema, F.to_json(v))
    return F.coalesce(compiled(schema, v, path, schema), F.array().cast(NONE))


def validated_json(df: DataFrame, text: str, schema: object, values: bool = True) -> DataFrame:
    """df with errors and valid of the JSON in a text column, in one pass over it; text that isn't JSON is one error, of repeated keys the last counts. Without values, those of the errors are null and aren't printed."""
    from .straight import text_of
    from .walk import unsaid, walked, written

    out = df.withColumn("errors", walked(schema, F.col(text), (written if recursive(schema) else text_of) if values else unsaid)).withColumn("valid", F.size("errors") == 0)
    return sealed(out, "errors", "valid")
