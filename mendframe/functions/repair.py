"""Repair of damaged JSON text: one Arrow pass, linear in the text.

A small reader per text takes one token at a time and keeps the containers that are open. It
forgives: code fences, prose and comments around the JSON, bare keys, stray and missing commas
and closers, half-written literals and strings, and spellings of booleans. Text that is JSON
already comes back as it is.
"""

from __future__ import annotations

import json
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

LONGEST = 16 * 1024 * 1024
DEEPEST = 512
# Spellings of booleans, in any case.
TRUE, FALSE = {"yes", "y", "on"}, {"no", "off"}

_TOKEN = re.compile(r'[ \t\r\n]+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?P<mark>[{}\[\]:,])|"(?P<string>(?:[^"\\]|\\.)*)(?:"|\\?\Z)|(?P<number>[-\d]\d*(?:\.\d*)?(?:[eE][+-]?\d*)?)|(?P<word>[A-Za-z_$][A-Za-z0-9_$]*)|(?P<other>.)', re.S)
_OUTSIDE = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*(?:"|\\?\Z)|([{\[])', re.S)
_SPACE = re.compile(r"(?:\s|//[^\n]*|/\*.*?(?:\*/|\Z))*", re.S)
_FENCE = re.compile(r"```json[^\n]*\n(.*?)(?:```|\Z)", re.S)
_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|(.))", re.S)
_HUGE = re.compile(r"\d[eE]\+?\d{3}")
_PAIR = re.compile(r"[\ud800-\udbff][\udc00-\udfff]")
_PARSED = StructType([StructField("json", StringType()), StructField("code", StringType()), StructField("errors", ArrayType(StringType()))])
_LETTERS = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def _string(raw: str) -> str:
    """A string's text: escapes spelt out, half surrogates left out."""
    if "\\" not in raw:
        return raw
    out = _ESCAPE.sub(lambda m: chr(int(m[1], 16)) if m[1] else "\\u" if m[2] == "u" else _LETTERS.get(m[2], m[2]), raw)
    out = _PAIR.sub(lambda m: m[0].encode("utf-16", "surrogatepass").decode("utf-16"), out)
    return "".join(c for c in out if not "\ud800" <= c <= "\udfff")


def _number(raw: str) -> int | float:
    for kind in (int, float):
        try:
            value = kind(raw)
        except ValueError:
            continue
        if kind is float or -(1 << 63) <= value < 1 << 63:
            return value if abs(value) != float("inf") else 0
    return 0


def _literal(word: str) -> object:
    """The value of a literal, of its beginning or of another spelling; Ellipsis if it is none."""
    low = word.lower()
    if "true".startswith(word) or low in TRUE:
        return True
    if "false".startswith(word) or low in FALSE:
        return False
    return None if len(word) > 1 and "null".startswith(word) else ...


def _around(text: str, at: int) -> str:
    """An error's place: 10 characters before it and 20 after."""
    lo, hi = max(0, at - 10), min(len(text), at + 20)
    return "..." * (lo > 0) + text[lo:at] + "→" + text[at:hi] + "..." * (hi < len(text))


def _primitive(text: str) -> tuple[object, bool]:
    """(value, whether the text starts with one that is no container); what follows it is ignored."""
    m = _TOKEN.match(text)
    if m and m.lastgroup == "string":
        return _string(m["string"]), True
    if m and m.lastgroup == "number":
        return _number(m["number"]), True
    for k, v in (("true", True), ("false", False), ("null", None)):
        if text.startswith(k) or k.startswith(text) and (v is not None or len(text) > 1):
            return v, True
    low = text.lower()
    return (True, True) if low in TRUE else (False, True) if low in FALSE else (None, False)


def _read(text: str, at: int) -> tuple[object, list[str]]:
    """(value, what was expected at each error) of the container at that place."""
    errors: list[str] = []
    root: object = None
    open_: list[list] = []  # container, key, state: key, colon or value

    def put(value: object) -> None:
        nonlocal root
        if not open_:
            root = value
        elif isinstance(open_[-1][0], list):
            open_[-1][0].append(value)
        else:
            open_[-1][0][open_[-1][1]] = value
            open_[-1][2] = "key"

    def expected(what: str, place: int) -> None:
        errors.append(f"{what} at {_around(text, place)}")

    while True:
        m = _TOKEN.match(text, at)
        if not m:
            break
        kind, here = m.lastgroup, at
        at = m.end()
        if kind is None:
            continue
        got = m[kind]
        while open_ and open_[-1][2] != "value":  # keys; what can't be one ends the object and is its holder's
            held = open_[-1]
            if held[2] == "key":
                if got == "," and kind == "mark" or got == "}" and kind == "mark":
                    break
                if kind in ("string", "word"):
                    held[1], held[2] = _string(got) if kind == "string" else got, "colon"
                    got = None
                    break
                expected("string key", here)
            elif kind == "mark" and got == ":":
                held[2] = "value"
                got = None
                break
            else:
                expected("':'", here)
            open_.pop()
            if not open_:
                return root, errors
        if got is None:
            continue
        in_list = bool(open_) and isinstance(open_[-1][0], list)
        if kind == "mark" and got in "{[":
            if len(open_) >= DEEPEST:
                expected("fewer levels", here)
                break
            new: object = {} if got == "{" else []
            put(new)
            open_.append([new, None, "key" if got == "{" else "value"])
        elif kind == "mark" and got in "}],":
            if open_ and not in_list and open_[-1][2] == "value":  # no value: null, and the mark counts for the object
                put(None)
            if got != "," and open_ and (got == "]") == in_list:
                open_.pop()
                if not open_:
                    break
        elif kind == "string":
            put(_string(got))
        elif kind == "number":
            put(_number(got))
        elif kind == "word" and _literal(got) is not ...:
            put(_literal(got))
        else:
            expected(f"unquoted string '{got}'" if kind == "word" else "value", here)
            if kind == "word":
                put(None)
                at = next((i for i in range(at, len(text)) if text[i] in ",}]"), len(text))
    return root, errors


def read(text: str | None) -> tuple[str | None, str | None, list[str]]:
    """(JSON text or None, code of failure or None, errors met on the way)."""
    if text is None:
        return None, None, []
    if len(text.encode("utf-8", "replace")) > LONGEST:
        return None, "P003", ["input within 16MB"]
    if not _HUGE.search(text):  # numbers beyond doubles are read leniently
        try:
            twice: list[bool] = []
            value = json.loads(text, parse_constant=_Strange, object_pairs_hook=lambda p: twice.append(True) or dict(p) if len(d := dict(p)) < len(p) else d)
            return written(value) if twice else text.strip(), None, []  # of repeated keys the last counts
        except (ValueError, RecursionError):
            pass
    bare = text.strip()
    fence = None if bare[:1] in ("{", "[", '"') else _FENCE.search(text)
    body = fence[1].strip() if fence else bare
    if not body:
        return None, "P001", ["empty input"]
    value, simple = _primitive(body)
    errors: list[str] = []
    if not simple:
        start = next((m.start() for m in _OUTSIDE.finditer(body) if m[1]), None)
        if start is None:
            value, simple = _primitive(body[_SPACE.match(body).end() :] or "?")
            if not simple:
                return None, "P002", ["JSON value"]
        else:
            value, errors = _read(body, start)
    return written(value), None, errors


def written(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


class _Strange(ValueError):
    """NaN and infinities, which JSON lacks."""

    def __init__(self, name: str):
        raise ValueError(name)


@F.pandas_udf(_PARSED)
def parsed(texts: pd.Series) -> pd.DataFrame:
    """json (null on failure), code (P001 empty, P002 no value, P003 too large) and what was expected at each error."""
    return pd.DataFrame([read(t) for t in texts], columns=["json", "code", "errors"])


@F.arrow_udf(StringType())
def last_wins(texts: pa.Array) -> pa.Array:
    """JSON text written anew, of repeated keys with the last; null for what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else written(json.loads(text, parse_constant=_Strange))
        except (ValueError, RecursionError):
            return None

    return pa.array([one(t) for t in texts.to_pylist()], pa.string())


def variant(text: Column) -> Column:
    """The VARIANT of a JSON text, of repeated keys with the last; null for what isn't JSON. Only texts that the JVM refuses leave it."""
    first = F.try_parse_json(text)
    return F.coalesce(first, F.try_parse_json(last_wins(F.when(first.isNull(), text))))


def repair(c: Column) -> Column:
    """JSON text, or null where the text holds no value."""
    return parsed(c)["json"]
