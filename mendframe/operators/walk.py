"""Validation by schemas that are data: schemas become rows of instructions, records meet them by key.

instructions() turns schema texts into a table (key, at, op, arg, to): a location of a schema
has one number, however many references lead to it, so recursive schemas need no copying. A
record is walked along its own values from location 0, so depth and branching are bounded by
the data alone. Beside errors the walk keeps which properties and items have been evaluated,
through allOf, anyOf, oneOf, if, references and dependent schemas; unevaluatedProperties and
unevaluatedItems go by that.

validated_by() brings records and instructions together: the instructions of all schemas are
shipped with the tasks where their size is under a stated bound; beyond it both are shuffled
by key, each task reads a key's instructions before the key's records, and keys with many
records are spread over several tasks. Records are streamed, never gathered by key.

A null text, a text that isn't JSON and a key without schema give one error each. Of repeated
keys in an object the last wins. A schema that is itself at fault gives that as each record's
error; a multipleOf of 0 breaks nothing. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import functools
import json
import re
import sys
from collections import defaultdict
from collections.abc import Callable, Iterator
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..functions.plain import has_format, pattern
from .nested import PLACE, circular, fault
from .straight import Real, error_columns, function
from .validate import ERROR

#: Bytes of instructions that are shipped with tasks at most; records of a key that a task takes before the key is spread.
SHIPPED, SPREAD = 16 << 20, 1_000_000
_LIMITS = {"minimum": ("Minimum", lambda a, b: a < b), "maximum": ("Maximum", lambda a, b: a > b), "exclusiveMinimum": ("ExclusiveMinimum", lambda a, b: a <= b), "exclusiveMaximum": ("ExclusiveMaximum", lambda a, b: a >= b)}
_SIZES = {
    "minLength": ("string", str, lambda n, x: n < x), "maxLength": ("string", str, lambda n, x: n > x), "minItems": ("array", list, lambda n, x: n < x), "maxItems": ("array", list, lambda n, x: n > x),
    "minProperties": ("object", dict, lambda n, x: n < x), "maxProperties": ("object", dict, lambda n, x: n > x),
}
_WHOLE, _REAL = re.compile(r"[+-]?[0-9]+"), re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
_INPLACE = ("allOf", "anyOf", "oneOf")


_ENCODER = json.JSONEncoder(ensure_ascii=False, separators=(",", ":"))


def written(value: object) -> str:
    return _ENCODER.encode(value)


def same(a: object, b: object) -> bool:
    """JSON equality: numbers by value, objects whatever their order."""
    return identity(a) == identity(b)


def identity(v: object) -> object:
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return (type(v).__name__, v)
    if isinstance(v, (int, float)):
        return ("number", v)
    if isinstance(v, list):
        return ("list", tuple(map(identity, v)))
    return ("object", frozenset((k, identity(x)) for k, x in v.items()))


def has_type(v: object, kind: str) -> bool:
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    return {
        "null": v is None, "boolean": isinstance(v, bool), "string": isinstance(v, str), "array": isinstance(v, list), "object": isinstance(v, dict),
        "number": number, "integer": number and (isinstance(v, int) or v.is_integer()),
    }[kind]


# Schemas to instructions


def compiled(schema: object) -> list[tuple[int, str, str, list[int]]]:
    """(at, op, arg as JSON, to) of a schema; to names the locations of schemas below or beside."""
    if circular(schema):
        return [(0, "fault", written(["non-circular $ref", "$ref cycle detected in schema"]), [])]
    if said := fault(schema):
        return [(0, "fault", written(["valid schema", said]), [])]
    rows: list[tuple[int, str, str, list[int]]] = []
    numbers: dict[int, int] = {}
    waiting: list[object] = []

    def at(s: object) -> int:
        if id(s) not in numbers:
            numbers[id(s)] = len(waiting)
            waiting.append(s)
        return numbers[id(s)]

    at(schema)
    n = 0
    while n < len(waiting):
        rows += [(n, op, written(arg), to) for op, arg, to in _keywords(waiting[n], schema, at)]
        n += 1
    return rows


def target(root: object, reference: str) -> object:
    """What a reference within the schema points at: a JSON pointer or an anchor; KeyError if nothing."""
    if not reference.startswith("#"):
        raise KeyError(reference)
    if reference[1:2] not in ("", "/"):
        stack = [root]
        while stack:
            s = stack.pop()
            if isinstance(s, dict) and s.get("$anchor") == reference[1:]:
                return s
            stack += s.values() if isinstance(s, dict) else s if isinstance(s, list) else []
        raise KeyError(reference)
    here = root
    for step in reference[1:].split("/")[1:]:
        step = step.replace("~1", "/").replace("~0", "~")
        if isinstance(here, list) and step.isdigit() and int(step) < len(here):
            here = here[int(step)]
        elif isinstance(here, dict) and step in here:
            here = here[step]
        else:
            raise KeyError(reference)
    return here


def _keywords(s: object, root: object, at) -> Iterator[tuple[str, object, list[int]]]:
    if isinstance(s, bool):
        if not s:
            yield "never", None, []
        return
    if "$ref" in s:
        try:
            yield "ref", None, [at(target(root, s["$ref"]))]
        except KeyError:
            yield "lost", s["$ref"], []
    for k in ("type", "enum", "const", *_LIMITS, "multipleOf", "pattern", "format", *_SIZES):
        if k in s:
            yield k, s[k], []
    if s.get("uniqueItems") is True:
        yield "uniqueItems", None, []
    if "default" in s:
        yield "default", s["default"], []
    old = isinstance(s.get("items"), list)
    first = s.get("prefixItems", s["items"] if old else [])
    if first:
        yield "prefixItems", None, [at(x) for x in first]
    rest = s.get("additionalItems", ...) if old else s.get("items", ...)
    if rest is not ...:
        yield "items", len(first), [] if rest is False else [at(rest)]
    if "contains" in s:
        yield "contains", [s.get("minContains", 1), s.get("maxContains")], [at(s["contains"])]
    needs = dict(s.get("dependentRequired", {})) | {k: d for k, d in s.get("dependencies", {}).items() if isinstance(d, list)}
    if "required" in s or needs:
        yield "required", [s.get("required", []), needs], []
    properties, patterns = s.get("properties", {}), s.get("patternProperties", {})
    if properties:
        yield "properties", list(properties), [at(x) for x in properties.values()]
    if patterns:
        yield "patternProperties", list(patterns), [at(x) for x in patterns.values()]
    if "additionalProperties" in s:
        other = s["additionalProperties"]
        yield "additionalProperties", [list(properties), list(patterns)], [] if other is False else [at(other)]
    if "propertyNames" in s:
        yield "propertyNames", None, [at(s["propertyNames"])]
    below = dict(s.get("dependentSchemas", {})) | {k: d for k, d in s.get("dependencies", {}).items() if not isinstance(d, list)}
    if below:
        yield "dependentSchemas", list(below), [at(x) for x in below.values()]
    for k in _INPLACE:
        if k in s:
            yield k, None, [at(x) for x in s[k]]
    if "not" in s:
        yield "not", None, [at(s["not"])]
    if "if" in s:
        yield "if", None, [at(s["if"]), at(s.get("then", True)), at(s.get("else", True))]
    for k in ("unevaluatedProperties", "unevaluatedItems"):  # after all that may evaluate
        if k in s:
            yield k, None, [] if s[k] is False else [at(s[k])]


_INSTRUCTION = "at int, op string, arg string, to array<int>"


def instructions(schemas: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, op, arg, to: the schemas of a text column as rows; a text that isn't JSON is a schema at fault."""
    kind = schemas.schema[key].dataType
    out = StructType([StructField(key, kind), *schemas.sparkSession.createDataFrame([], _INSTRUCTION).schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(out)
        for b in batches:
            rows = [(k, *r) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in compiled_text(t)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)] if rows else [pa.array([], f.type) for f in arrow], schema=arrow)

    return schemas.select(key, text).mapInArrow(run, out)


def compiled_text(text: str | None) -> list[tuple[int, str, str, list[int]]]:
    try:
        return compiled(json.loads(text)) or [(0, "any", "null", [])]
    except (TypeError, ValueError) as e:
        return [(0, "fault", written(["valid schema", f"not JSON: {e}"]), [])]


# Records along instructions


def expectation(op: str, arg: object) -> str:
    """What a keyword that looks at the value alone asks for."""
    if op == "type":
        return f"({' | '.join(sorted(arg))})" if isinstance(arg, list) else arg
    if op in _LIMITS:
        return f"{'integer' if isinstance(arg, int) else 'number'} & {_LIMITS[op][0]}<{written(arg)}>"
    if op in _SIZES:
        return f"{_SIZES[op][0]} & {op[0].upper()}{op[1:]}<{written(arg)}>"
    return f"one of {written(arg)}" if op == "enum" else f"const {json.dumps(arg, ensure_ascii=False, separators=(',', ':'), sort_keys=True)}"


@functools.lru_cache(1 << 14)
def _step(step: str | int, named: bool) -> str:
    return f".{step}" if named or not isinstance(step, int) and not PLACE.fullmatch(step) else f"[{int(step)}]"


def shown(path: tuple) -> str:
    """A place as text. A path is (the path above, name or index), () at the top, so that a step costs the same at any depth.

    A name of digits is shown as a place, but for one that is missing, which has a third part.
    """
    steps = []
    while path:
        steps.append(_step(path[1], len(path) > 2))
        path = path[0]
    return "$input" + "".join(reversed(steps))


class Walk:
    """Errors of values against one schema's instructions."""

    def __init__(self, rows: list[tuple[int, str, object, list[int]]]):
        self.code: dict[int, list] = defaultdict(list)
        for at, op, arg, to in rows:
            self.code[at].append((op, arg, to))
        self.tracks = any(op.startswith("unevaluated") for _, op, _, _ in rows)
        self.active: set[tuple[int, int]] = set()
        self.straight = function(self)

    identity = staticmethod(identity)

    def errors(self, value: object) -> list[tuple[str, str, object, str | None]]:
        out: list = []
        if self.straight:
            self.straight(value, (), out)
        else:
            self.visit(0, value, (), out, None)
        return [(shown(path), *rest) for path, *rest in out]

    def passes(self, at: int, v: object, path: tuple, seen: set | None) -> bool:
        """Whether v passes; what it evaluated is added to seen if so."""
        found, own = [], set() if seen is not None else None
        self.visit(at, v, path, found, own)
        if not found and seen is not None:
            seen |= own
        return not found

    def visit(self, at: int, v: object, path: tuple, out: list, seen: set | None) -> None:
        """Adds errors to out, and to seen the names and places that were evaluated."""
        here = (at, id(v))
        if here in self.active:  # a reference back to where it stands, on the same value: nothing new
            return
        self.active.add(here)
        own = set() if self.tracks else None
        for op, arg, to in self.code.get(at, ()):
            getattr(self, f"_{op}", self._plain)(op, arg, to, v, path, out, own)
        if own and seen is not None:
            seen |= own
        self.active.discard(here)

    def _beside(self, at: int, v: object, path: tuple, out: list, own: set | None) -> None:
        """A schema that applies to the same value: its errors, and, where it has none, what it evaluated."""
        before, also = len(out), set() if own is not None else None
        self.visit(at, v, path, out, also)
        if own is not None and len(out) == before:
            own |= also

    def _plain(self, op, arg, to, v, path, out, own) -> None:
        """Keywords that look at the value alone."""
        number = isinstance(v, (int, float)) and not isinstance(v, bool)
        said = None
        if op == "type":
            bad, expected = not any(has_type(v, k) for k in (arg if isinstance(arg, list) else [arg])), None
        elif op in _LIMITS:
            bad, expected = number and _LIMITS[op][1](v, arg), None
        elif op in _SIZES:
            bad, expected = isinstance(v, _SIZES[op][1]) and _SIZES[op][2](len(v), arg), None
        elif op == "multipleOf":
            bad, expected = number and arg != 0 and v == v and abs(v) != float("inf") and Decimal(repr(v)) % Decimal(repr(arg)) != 0, f"number & MultipleOf<{written(arg)}>"
        elif op == "pattern":
            bad, expected = isinstance(v, str) and not pattern(arg).search(v), f'string & Pattern<"{arg}">'
        elif op == "format":
            bad, expected = isinstance(v, str) and not has_format(v, arg), f'string & Format<"{arg}">'
        elif op == "enum":
            bad, expected = not any(same(v, x) for x in arg), None
        elif op == "const":
            bad, expected = not same(v, arg), None
        elif op == "uniqueItems":
            bad, expected, said = isinstance(v, list) and len(set(map(identity, v))) < len(v), "array & UniqueItems", "Array contains duplicate elements."
        elif op == "never":
            bad, expected = True, "never (false schema)"
        elif op == "lost":
            bad, expected, said = True, "resolvable $ref", arg
        elif op == "fault":
            bad, (expected, said) = True, arg
        else:
            return
        if bad:
            out.append((path, expectation(op, arg) if expected is None else expected, v, said))

    def _ref(self, op, arg, to, v, path, out, own) -> None:
        self._beside(to[0], v, path, out, own)

    def _allOf(self, op, arg, to, v, path, out, own) -> None:
        for t in to:
            self._beside(t, v, path, out, own)

    def _anyOf(self, op, arg, to, v, path, out, own) -> None:
        if own is None:
            good = any(self.passes(t, v, path, None) for t in to)
        else:  # each branch that passes counts
            good = sum([self.passes(t, v, path, own) for t in to])
        if not good:
            out.append((path, "union type", v, None))

    def _oneOf(self, op, arg, to, v, path, out, own) -> None:
        n = sum([self.passes(t, v, path, own) for t in to])
        if n != 1:
            out.append((path, "oneOf match", v, f"oneOf: expected exactly 1 match but found {'multiple' if n else '0'}"))

    def _not(self, op, arg, to, v, path, out, own) -> None:
        if self.passes(to[0], v, path, None):
            out.append((path, "value NOT matching the sub-schema", v, None))

    def _if(self, op, arg, to, v, path, out, own) -> None:
        self._beside(to[1] if self.passes(to[0], v, path, own) else to[2], v, path, out, own)

    def _dependentSchemas(self, op, arg, to, v, path, out, own) -> None:
        for name, t in zip(arg, to, strict=True):
            if isinstance(v, dict) and name in v:
                self._beside(t, v, path, out, own)

    def _child(self, at: int, v: object, path: tuple, out: list) -> None:
        self.visit(at, v, path, out, None)

    def _prefixItems(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, list):
            for i, (t, x) in enumerate(zip(to, v)):
                self._child(t, x, (path, i), out)
            if own is not None:
                own.update(range(min(len(to), len(v))))

    def _items(self, op, arg, to, v, path, out, own) -> None:
        if not isinstance(v, list) or len(v) <= arg:
            return
        if not to:
            out.append((path, f"array with at most {arg} items", v, None))
            return
        for i in range(arg, len(v)):
            self._child(to[0], v[i], (path, i), out)
        if own is not None:
            own.update(range(arg, len(v)))

    def _contains(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, list):
            hits = [i for i, x in enumerate(v) if self.passes(to[0], x, path, None)]
            if len(hits) < arg[0] or arg[1] is not None and len(hits) > arg[1]:
                out.append((path, "array & Contains", v, None))
            if own is not None:
                own.update(hits)

    def _required(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, dict):
            needed = arg[0] + [x for k, names in arg[1].items() if k in v for x in names]
            out += [((path, k, "missing"), "required property", None, f"The value at this path is `undefined`.\n\nPlease fill the `{k}` typed value next time.") for k in needed if k not in v]

    def _named(self, names, v, path, out, own, to) -> None:
        for k, t in zip(names, to, strict=True):
            self._child(t, v[k], (path, k), out)
        if own is not None:
            own.update(names)

    def _properties(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, dict):
            there = [(k, t) for k, t in zip(arg, to, strict=True) if k in v]
            self._named([k for k, _ in there], v, path, out, own, [t for _, t in there])

    def _patternProperties(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, dict):
            for p, t in zip(arg, to, strict=True):
                names = [k for k in v if pattern(p).search(k)]
                self._named(names, v, path, out, own, [t] * len(names))

    def _additionalProperties(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, dict):
            known = set(arg[0])
            self._others([k for k in v if k not in known and not any(pattern(p).search(k) for p in arg[1])], to, v, path, out, own)

    def _unevaluatedProperties(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, dict):
            self._others([k for k in v if k not in own], to, v, path, out, own)

    def _others(self, names, to, v, path, out, own) -> None:
        if names and not to:
            out.append((path, "no extraneous properties", v, ", ".join(f"unexpected property '{k}'" for k in names)))
        elif names:
            self._named(names, v, path, out, own, to * len(names))

    def _unevaluatedItems(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, list):
            left = [i for i in range(len(v)) if i not in own]
            if left and not to:
                out.append((path, "no extraneous items", v, ", ".join(f"unexpected item '{written(v[i])}'" for i in left)))
            elif left:
                for i in left:
                    self._child(to[0], v[i], (path, i), out)
                own.update(left)

    def _propertyNames(self, op, arg, to, v, path, out, own) -> None:
        if isinstance(v, dict) and not all(self.passes(to[0], k, path, None) for k in v):
            out.append((path, "valid property name at $input", v, None))


# Values as near to their schema as their text allows


def named(text: str, options: list) -> object:
    """The option that a text names: itself, but for case, or a number written so; Ellipsis if none."""
    texts = [o for o in options if isinstance(o, str)]
    same_ = [o for o in texts if o == text] + [o for o in texts if o.lower() == text.lower()]
    return next(iter(same_ + [o for o in options if isinstance(o, (int, float)) and not isinstance(o, bool) and written(o) == text]), ...)


def number_of(text: str) -> object:
    """The number that a text stands for, with thousands commas or a suffix k or m; Ellipsis if none."""
    bare = text.replace(",", "").strip(" ")
    if _WHOLE.fullmatch(bare) and -(1 << 63) <= int(bare) < 1 << 63:
        return int(bare)
    body = bare[:-1] if bare[-1:] in tuple("kKmM") and bare else bare
    if not _REAL.fullmatch(body):
        return ...
    value = float(body) * (1 if body == bare else {"k": 1e3, "m": 1e6}[bare[-1].lower()])
    return value if abs(value) < float("inf") else ...


def boolean_of(text: str) -> object:
    bare = text.strip(" ")
    low = bare.lower()
    if low in ("yes", "y", "on") or bare and "true".startswith(bare):
        return True
    return False if low in ("no", "n", "off") or bare and "false".startswith(bare) else ...


def object_of(text: str) -> object:
    try:
        value = json.loads(text, parse_constant=_strange)
    except (ValueError, RecursionError):
        return ...
    return value if isinstance(value, dict) else ...


class Coercion(Walk):
    """A walk that first brings values near their schema, by the same instructions."""

    def errors(self, value: object) -> list[tuple[str, str, object, str | None]]:
        return super().errors(self.coerced(0, value))

    def _known(self, at: int) -> dict:
        """Instructions by keyword, references followed; of allOf the properties of its parts."""
        own = {op: (arg, to) for op, arg, to in self.code.get(at, ())}
        for _ in range(16):
            if "ref" not in own:
                break
            own = {op: (arg, to) for op, arg, to in self.code.get(own["ref"][1][0], ())}
        if "allOf" in own:
            parts = [self._known(t).get("properties", ([], [])) for t in own["allOf"][1]]
            both = {k: t for names, to in parts for k, t in zip(names, to, strict=True)}
            own = {k: v for k, v in own.items() if k not in ("allOf", "properties", "required")} | {"properties": (list(both), list(both.values()))}
        return own

    def coerced(self, at: int, v: object) -> object:
        own = self._known(at)
        if "const" in own or "ref" in own or "lost" in own or "fault" in own:
            return v
        for union in ("anyOf", "oneOf"):
            if union in own:
                return self._of_union(own[union][1], v)
        kind = own.get("type", ([],))[0]
        kinds = set(kind) if isinstance(kind, list) else {kind}
        options = own.get("enum", ([],))[0]
        if kinds == {"string"}:
            if v is None or isinstance(v, (list, dict)):
                return v
            text = (v if isinstance(v, str) else written(v)).strip(" ")
            found = named(text, options)
            return text if found is ... else found
        if kinds == {"array"}:
            return self._as_list(own.get("items", (0, []))[1], v)
        out = v
        if kinds == {"object"} or "properties" in own:
            inside = object_of(v) if isinstance(v, str) else v
            out = self._as_object(own, inside) if isinstance(inside, dict) else v
        elif isinstance(v, str):
            found = (
                named(v, options) if options else number_of(v) if kinds & {"number", "integer"} else boolean_of(v) if kinds == {"boolean"}
                else (None if v.strip(" ").lower() in ("n", "nu", "nul", "null") else ...) if kinds == {"null"} else object_of(v) if "object" not in kinds else ...
            )
            out = v if found is ... else found
        return own["default"][0] if v is None and "default" in own else out

    def _as_list(self, to: list[int], v: object) -> list:
        inner = lambda x: self.coerced(to[0], x) if to else x
        if isinstance(v, list):
            return [inner(x) for x in v]
        if isinstance(v, dict) and set(v) == {str(i) for i in range(len(v))}:
            return [inner(v[str(i)]) for i in range(len(v))]
        return [inner(v)]

    def _as_object(self, own: dict, v: dict) -> dict:
        properties = dict(zip(*own.get("properties", ([], [])), strict=True))
        other = own.get("additionalProperties", (None, []))[1]
        out = {}
        for name, t in properties.items():
            below = self._known(t)
            if v.get(name) is None and "default" in below:
                out[name] = below["default"][0]
            elif name in v:
                out[name] = self.coerced(t, v[name])
        return out | {k: self.coerced(other[0], x) if other else x for k, x in v.items() if k not in properties}

    def _of_union(self, to: list[int], v: object) -> object:
        """A string stays if a variant takes strings, else it is what the one variant that can read it makes of it; containers go by the one variant of their kind."""
        kinds = [set(k) if isinstance(k, list) else {k} for k in (self._known(t).get("type", ([],))[0] for t in to)]
        if isinstance(v, str) and not any("string" in k for k in kinds):
            read = [self.coerced(t, v) for t, k in zip(to, kinds, strict=True) if k & {"number", "integer", "boolean", "null"}]
            changed = [x for x in read if not same(x, v)]
            return changed[0] if len(changed) == 1 else v
        for kind, there in (("object", isinstance(v, dict)), ("array", isinstance(v, list))):
            own = [t for t, k in zip(to, kinds, strict=True) if kind in k]
            if there and len(own) == 1:
                return self.coerced(own[0], v)
        return v


def _strange(name: str) -> object:
    raise ValueError(name)


decode = json.JSONDecoder(parse_constant=_strange, parse_float=Real).decode


def _value(text: str) -> object:
    try:
        return decode(text)
    except ValueError:  # no JSON, or a whole number of thousands of digits
        return json.loads(text, parse_constant=_strange, parse_float=Real, parse_int=lambda s: int(s) if len(s) < 400 else float(s))


def unsaid(value: object) -> None:
    """For errors whose values nobody reads."""


def errors_of_text(walk: Walk | None, text: str | None) -> list[dict]:
    """Error rows of one text; value is the JSON at the error's path."""
    return [dict(zip(("path", "expected", "value", "description"), e, strict=True)) for e in told_of(walk, text)]


def told_of(walk: Walk | None, text: str | None, show: Callable[[object], str] = written) -> list[tuple[str, str, str | None, str | None]]:
    """path, expected, value, description of one text's errors."""
    if walk is None:
        found = [("$input", "known schema", None, None)]
    else:
        try:
            found = walk.errors(_value(text))
        except (TypeError, ValueError):
            return [("$input", "JSON value", None if show is unsaid else text, None)]
        except RecursionError:
            walk.active.clear()
            return [("$input", "fewer levels", None, None)]
    return [(p, e, show(v), d) for p, e, v, d in found]


def error_array(found: list[list[tuple]]) -> pa.Array:
    offsets, *fields = error_columns(found)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in fields], names=["path", "expected", "value", "description"]))


#: Frames of Python that a walk may stack: some three a level of data.
_FRAMES = 60_000


def _loaded(rows: list, kind: type[Walk]) -> Walk:
    return kind([(r["at"], r["op"], json.loads(r["arg"]), r["to"]) for r in rows])


def walked(schema: object, text: Column, show: Callable[[object], str] = written) -> Column:
    """Errors of a JSON text column against one schema, as an array Column; show writes values."""
    rows = [(at, op, json.loads(arg), to) for at, op, arg, to in compiled(schema)]

    @F.arrow_udf(f"array<{ERROR}>")
    def run(texts: pa.Array) -> pa.Array:
        sys.setrecursionlimit(_FRAMES)
        walk = Walk(rows)
        return error_array([told_of(walk, t, show) for t in texts.to_pylist()])

    return run(text)


def validated_by(records: DataFrame, text: str, key: str, schemas: DataFrame, schema: str = "schema", coerce: bool = False, shipped: int = SHIPPED, spread: int = SPREAD) -> DataFrame:
    """records with errors and valid, each by the schema of its key, coerced by it first if asked; schemas holds the key column and schema texts, a key once."""
    kind = Coercion if coerce else Walk
    code = instructions(schemas, key, schema)
    size = code.agg(F.coalesce(F.sum(F.octet_length("arg") + F.octet_length("op") + 4 * F.size("to") + 16), F.lit(0)).alias("n")).first()["n"]
    packed = records.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.struct("*").alias("_row"))
    out = StructType([StructField("_row", records.schema), StructField("_key", records.schema[key].dataType), *records.sparkSession.createDataFrame([], f"errors array<{ERROR}>").schema.fields])
    if size <= shipped:
        found = defaultdict(list)
        for r in code.collect():
            found[r[key]].append(r)
        programs = {k: [(r["at"], r["op"], r["arg"], r["to"]) for r in v] for k, v in found.items()}
        done = packed.mapInArrow(_by_shipped(programs, kind), out)
    else:
        done = _merged(packed, code, key, spread).mapInArrow(_by_stream(kind), out)
    return done.select("_row.*", "errors", (F.size("errors") == 0).alias("valid"))


def _by_shipped(programs: dict, kind: type[Walk]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(_FRAMES)
        walks: dict = {}
        for b in batches:
            errors = []
            for k, t in zip(b.column("_key").to_pylist(), b.column("_text").to_pylist(), strict=True):
                if k not in walks:
                    walks[k] = kind([(at, op, json.loads(arg), to) for at, op, arg, to in programs[k]]) if k in programs else None
                errors.append(told_of(walks[k], t))
            yield pa.RecordBatch.from_arrays([b.column("_row"), b.column("_key"), error_array(errors)], names=["_row", "_key", "errors"])

    return run


def _merged(packed: DataFrame, code: DataFrame, key: str, spread: int) -> DataFrame:
    """Records and programs in one stream, a key's program before its records; keys with over `spread` records are dealt to as many tasks as that takes."""
    hot = packed.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > spread).select("_key", F.ceil(F.col("_n") / spread).cast("int").alias("_parts"))  # at most rows / spread keys
    program = code.groupBy(F.col(key).alias("_key")).agg(F.collect_list(F.struct("at", "op", "arg", "to")).alias("_code"))  # as long as its schema
    parts = F.coalesce("_parts", F.when(F.col("_key").isNull(), F.lit(1024)), F.lit(1))  # no schema has a null key, so such records may go anywhere
    left = packed.join(hot, "_key", "left").withColumns({"_part": F.pmod(F.xxhash64("_text", F.monotonically_increasing_id()), parts).cast("int"), "_code": F.lit(None).cast(program.schema["_code"].dataType)})
    right = program.join(hot, "_key", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).withColumns({"_text": F.lit(None).cast("string"), "_row": F.lit(None).cast(packed.schema["_row"].dataType)})
    columns = ["_key", "_part", "_text", "_row", "_code"]
    both = right.select(*columns).unionByName(left.select(*columns))
    return both.repartition("_key", "_part").sortWithinPartitions("_key", "_part", F.col("_code").isNull())


def _by_stream(kind: type[Walk]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sys.setrecursionlimit(_FRAMES)
        key, walk = ..., None
        for b in batches:
            errors, kept = [], []
            codes = b.column("_code").to_pylist()
            for i, (k, t) in enumerate(zip(b.column("_key").to_pylist(), b.column("_text").to_pylist(), strict=True)):
                if codes[i] is not None:
                    key, walk = k, _loaded(codes[i], kind)
                    continue
                if k != key:
                    key, walk = k, None
                errors.append(told_of(walk, t))
                kept.append(i)
            rows = b.take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rows.column("_row"), rows.column("_key"), error_array(errors)], names=["_row", "_key", "errors"])

    return run
