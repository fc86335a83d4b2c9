"""Random records of a nested schema as a Column: references, unions, arrays, limits and formats.

A value's draw is a digest of the seed, the row's key and the value's path, so a row is the
same in every run, on whatever task. A reference that comes back to a schema already open is
followed as long as fewer than `levels` levels are open, then gives null.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .walk import target


def draw(key: Column, path: str | Column, seed: int = 7) -> Column:
    """48 bits for a key and a path."""
    at = path if isinstance(path, Column) else F.lit(path)
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), at)), 1, 12), 16, 10).cast("long")


def _letters(key: Column, path: Column, n: Column, seed: int) -> Column:
    """n letters: digests with their digits as letters, as many as it takes."""
    part = lambda i: F.translate(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"), F.lit(":"), path, F.lit("#"), i.cast("string"))), "0123456789", "ghijklmnop")
    return F.substring(F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 32).cast("int")), part), ""), F.lit(1), n.cast("int"))


def _formatted(name: str, pick) -> Column:
    """A text of the format; pick(what, n) draws one of n numbers."""
    pad = lambda what, n, width, base=0: F.lpad((pick(what, n) + base).cast("string"), width, "0")
    hexa = lambda what, width: F.lpad(F.lower(F.hex(pick(what, 16**width))), width, "0")
    n = pick("n", 10000).cast("string")
    date = F.concat_ws("-", pad("year", 20, 4, 2010), pad("month", 12, 2, 1), pad("day", 28, 2, 1))
    time = F.concat(F.concat_ws(":", pad("hour", 24, 2), pad("minute", 60, 2), pad("second", 60, 2)), F.lit("Z"))
    host = F.concat(F.lit("h"), n, F.lit(".example.org"))
    page = F.concat(F.lit("https://example.org/"), n)
    made = {
        "email": F.concat(F.lit("p"), n, F.lit("@example.org")), "uuid": F.concat_ws("-", hexa("a", 8), hexa("b", 4), hexa("c", 4), hexa("d", 4), hexa("e", 12)), "date": date, "time": time, "date-time": F.concat(date, F.lit("T"), time),
        "duration": F.concat(F.lit("P"), pad("days", 30, 1, 1), F.lit("DT"), pad("hours", 24, 1), F.lit("H")), "ipv4": F.concat_ws(".", *[pick(f"o{i}", 256).cast("string") for i in range(4)]), "ipv6": F.concat_ws(":", *[hexa(f"g{i}", 4) for i in range(8)]),
        "hostname": host, "uri": page, "uri-reference": F.concat(F.lit("/r/"), n), "relative-json-pointer": F.concat(F.lit("1/r/"), n), "byte": F.base64(F.concat(F.lit("bytes "), n).cast("binary")), "regex": F.concat(F.lit("^a{0,"), n, F.lit("}$")),
    }
    same = {"idn-email": "email", "datetime": "date-time", "idn-hostname": "hostname", "url": "uri", "iri": "uri", "iri-reference": "uri", "uri-template": "uri", "json-pointer": "uri-reference"}
    return made.get(same.get(name, name), F.concat(F.lit("Pw-"), n))


def random_json(schema: object, key: Column, seed: int = 7, levels: int = 4) -> Column:
    """JSON text of a record that the schema's types, limits, options and formats allow, one a key."""

    def value(s: object, path: Column, open_: tuple[int, ...]) -> Column:
        if not isinstance(s, dict):
            return F.lit("null")
        pick = lambda what, n: F.pmod(draw(key, F.concat(path, F.lit(f"/{what}")), seed), F.lit(max(1, n)) if not isinstance(n, Column) else n)
        if "$ref" in s:
            try:
                to = target(schema, s["$ref"])
            except KeyError:
                return F.lit("null")
            return F.lit("null") if open_.count(id(to)) and len(open_) >= levels else value(to, path, (*open_, id(to)))
        if s.get("enum"):
            return F.element_at(F.array(*[F.lit(json.dumps(x, ensure_ascii=False)) for x in s["enum"]]), (pick("enum", len(s["enum"])) + 1).cast("int"))
        if "const" in s:
            return F.lit(json.dumps(s["const"], ensure_ascii=False))
        union = s.get("anyOf") or s.get("oneOf")
        if union:
            out = value(union[-1], path, open_)
            for i in range(len(union) - 2, -1, -1):
                out = F.when(pick("union", len(union)) == i, value(union[i], path, open_)).otherwise(out)
            return out
        kind = s.get("type")
        lo, hi = s.get("minimum", 0), s.get("maximum")
        hi = max(lo, 0) + 100 if hi is None else hi
        lo = min(lo, hi)
        if kind == "boolean":
            return F.when(pick("bool", 2) == 0, "false").otherwise("true")
        if kind == "integer":
            return (F.lit(int(lo)) + pick("int", int(hi) - int(lo) + 1)).cast("string")
        if kind == "number":
            first, last = math.ceil(lo * 100), math.floor(hi * 100)  # hundredths, if the range holds any
            return ((F.lit(first) + pick("num", last - first + 1)) / F.lit(100)).cast("decimal(24,2)").cast("string") if first <= last else F.lit(json.dumps(lo))
        if kind == "string":
            if "format" in s:
                return F.concat(F.lit('"'), _formatted(s["format"], pick), F.lit('"'))
            least = s.get("minLength", min(1, s.get("maxLength", 1)))
            most = s.get("maxLength", max(least, 20))
            return F.concat(F.lit('"'), _letters(key, path, F.lit(least) + pick("length", most - least + 1), seed), F.lit('"'))
        if kind == "array":
            least = s.get("minItems", min(1, s.get("maxItems", 1)))
            most = max(least, s.get("maxItems", max(least, 3)))
            n = F.lit(least) + pick("items", most - least + 1)
            each = F.transform(F.sequence(F.lit(0), F.lit(max(most - 1, 0))), lambda i: value(s.get("items", {}), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), open_))
            return F.concat(F.lit("["), F.array_join(F.slice(each, F.lit(1), n.cast("int")), ","), F.lit("]"))
        if kind == "object" or "properties" in s:
            parts = [F.concat(F.lit(json.dumps(k, ensure_ascii=False) + ":"), value(p, F.concat(path, F.lit(f".{k}")), open_)) for k, p in s.get("properties", {}).items()]
            return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
        return F.lit("null")

    return value(schema, F.lit("$"), ())
