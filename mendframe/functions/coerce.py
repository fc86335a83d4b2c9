"""Schema-driven coercion of text scalars as Columns, with the kind of each change.

ANSI mode is on by default, so every cast here is a try_cast behind a shape test.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def to_number(c: Column) -> Column:
    """Digits with thousands commas, or with a suffix k (1e3) or m (1e6); else null."""
    s = F.trim(F.replace(c, F.lit(","), F.lit("")))
    body = F.trim(F.regexp_replace(s, "[kKmM]$", ""))
    factor = F.when(s.rlike("[kK]$"), 1e3).when(s.rlike("[mM]$"), 1e6).otherwise(1.0)
    return F.when(body.rlike(_NUMBER), body.try_cast("double") * factor)


def to_boolean(c: Column) -> Column:
    """true, false and their beginnings; yes, y, on, no, n, off in any case; else null."""
    s = F.trim(c)
    low = F.lower(s)
    return F.when(low.isin("yes", "y", "on") | ((s != "") & F.lit("true").startswith(s)), True).when(low.isin("no", "n", "off") | ((s != "") & F.lit("false").startswith(s)), False)


def to_enum(c: Column, members: list[str]) -> Column:
    """The member equal to the trimmed text, else the one equal but for case, else the text."""
    s = F.trim(c)
    cased = F.filter(F.array(*[F.lit(m) for m in members]), lambda m: F.lower(m) == F.lower(s))
    return F.when(s.isin(*members), s).otherwise(F.coalesce(F.get(cased, F.lit(0)), c))


def change_kind(raw: Column, value: Column, kind: str) -> Column:
    """How a text became a value of schema type `kind`: the log's name for it, or null if nothing changed."""
    if kind == "string":
        return F.when(raw.isNull() & value.isNotNull(), "default_fill").when(raw == value, None).when(F.lower(raw) == F.lower(value), "enum_case").when(F.trim(raw) == value, "string_trim").otherwise("string_transform")
    name = {"integer": "string_to_int", "number": "string_to_number", "boolean": "string_to_bool"}[kind]
    return F.when(raw.isNull() & value.isNotNull(), "default_fill").when(value.isNotNull(), name)


def confidence(raw: Column, value: Column, valid: Column, numeric: bool) -> Column:
    """Trust in a coerced field: 0 where invalid, 1 where plain, less the more was guessed."""
    same = raw == value.cast("string")
    plain = raw.rlike(_NUMBER) if numeric else F.trim(raw) == value
    cased = F.lit(False) if numeric else F.lower(raw) == F.lower(value)
    return F.when(~valid, 0.0).when(same | plain, 1.0).when(cased, 0.9).when(raw.isNull(), 0.6).otherwise(0.7)
