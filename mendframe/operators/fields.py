"""Fields of JSON by path: keys, [i] for an element, [] for all of them; a path is compiled to one Column.

A path that is malformed gives its fault for every row; a value without the path gives why.
Of several elements without it, the first one's reason counts. A null text, and one that isn't
JSON, gives an error of its own.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .nested import field

#: A step: a key, a place, or None for each element.
Step = str | int | None


def steps(path: str) -> list[Step]:
    """The steps of a path; ValueError says what is wrong with it."""
    out: list[Step] = []
    at = 0
    while at < len(path):
        at += path[at] == "."
        if path[at : at + 1] == "[":
            end = path.find("]", at)
            inside = path[at + 1 : end if end >= 0 else len(path)]
            if end < 0:
                raise ValueError(f"unclosed bracket in: {path}")
            if inside and not (inside.removeprefix("+").isascii() and inside.removeprefix("+").isdigit()):
                raise ValueError(f"invalid index: {inside}")
            out.append(int(inside) if inside else None)
            at = end + 1
        else:
            end = min((i for i in (path.find(".", at), path.find("[", at)) if i >= 0), default=len(path))
            if end == at:
                raise ValueError(f"empty key in: {path}")
            out.append(path[at:end])
            at = end
    return out


_FOUND = "struct<values:array<variant>,error:string>"


def worked_out_once(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), with c worked out once."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def _failed(why: str) -> Column:
    return F.struct(F.array().cast("array<variant>").alias("values"), F.lit(why).alias("error"))


def _resolved(v: Column, path: list[Step]) -> Column:
    """values and error of a present VARIANT."""
    if not path:
        return F.struct(F.array(v).alias("values"), F.lit(None).cast("string").alias("error"))
    step, rest = path[0], path[1:]
    if isinstance(step, str):
        return worked_out_once(field(v, step), lambda x: F.when(x.isNull(), _failed(f"field not found: {step}")).otherwise(_resolved(x, rest)))
    items = F.try_variant_get(v, "$", "array<variant>")  # null for what is no array
    if step is not None:
        inside = lambda x: F.when(x.isNull(), _failed("expected array")).when(F.size(x) <= step, _failed(f"index out of bounds: {step}")).otherwise(_resolved(F.get(x, F.lit(step)), rest))
        return worked_out_once(items, inside)
    each = F.transform(items, lambda x: _resolved(x, rest))
    whole = lambda r: F.struct(F.flatten(F.transform(r, lambda x: x["values"])).alias("values"), F.get(F.filter(F.transform(r, lambda x: x["error"]), lambda e: e.isNotNull()), F.lit(0)).alias("error"))
    return worked_out_once(each, lambda r: F.when(r.isNull(), _failed("expected array for []")).otherwise(whole(r)))


def _shown(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))  # a container as its JSON, a null as null


def extracted(text: Column, path: str) -> Column:
    """A struct of text (values as text, one a line; a lone array by its elements) and error, one of them null."""
    return extracted_from(F.try_parse_json(text), path)


def extracted_from(value: Column, path: str) -> Column:
    """extracted() of a text that has been parsed, a VARIANT, so that several paths parse it once."""
    one = lambda t, e: F.struct(t.cast("string").alias("text"), e.cast("string").alias("error"))
    none = F.lit(None)
    try:
        parsed = steps(path)
    except ValueError as e:
        return one(none, F.lit(str(e)))
    lone = lambda x: F.coalesce(F.when(F.size(x) == 1, F.try_variant_get(F.get(x, F.lit(0)), "$", "array<variant>")), x)
    lines = lambda r: F.array_join(F.transform(lone(r["values"]), _shown), "\n")
    found = lambda r: F.when(r["error"].isNotNull(), one(none, r["error"])).otherwise(one(lines(r), none))
    return worked_out_once(value, lambda v: F.when(v.isNull(), one(none, F.lit("invalid JSON"))).otherwise(worked_out_once(_resolved(v, parsed), found)))
