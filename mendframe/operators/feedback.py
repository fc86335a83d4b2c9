"""A record printed with its errors beside the values they are about.

The value's tree and the errors' paths are merged in one pass: keys in order, then the
properties that only errors name, as undefined; elements, then those that errors at path[]
miss. Errors without a place in the value are listed below. Text in, text out, any depth.
"""

from __future__ import annotations

import json
import sys
from collections import defaultdict
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .walk import _FRAMES

# Fixed values.
MARK, OTHERS = " // ❌ ", "\n\n**Unmappable validation errors:**\n```json\n["


def _plain(v: object) -> str:
    if type(v) is int:
        return str(v)
    if isinstance(v, str) and v.isalnum():
        return f'"{v}"'
    if isinstance(v, str):
        for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            v = v.replace(a, b)
        return f'"{v}"'
    return json.dumps(v).replace("e+", "e")


class _Printer:
    def __init__(self, errors: list[dict]):
        self.at: dict[str, list[dict]] = defaultdict(list)
        self.named: dict[str, set[str]] = defaultdict(set)  # a path and the properties below it that errors name
        self.used: set[str] = set()
        self.out: list[str] = []
        for e in errors:
            self.at[e["path"]].append(e)
            above, dot, name = e["path"].rpartition(".")
            if dot and "[" not in name:
                self.named[above].add(name)

    def note(self, path: str) -> str:
        if path not in self.at:
            return ""
        self.used.add(path)
        said = lambda e: "" if e["description"] is None else ',"description":"' + e["description"].replace('"', '\\"').replace("\n", "\\n") + '"'
        return f"{MARK}[{','.join(f'{{"path":"{e["path"]}","expected":"{e["expected"]}"{said(e)}}}' for e in self.at[path])}]"

    def show(self, v: object, path: str, pad: str, lead: str, tail: str) -> None:
        """Lines of a value; lead comes before it, tail (a comma or nothing) after it and before its note."""
        note, inner = self.note(path), pad + "  "
        if isinstance(v, list):
            lost = self.at.get(f"{path}[]", [])
            if lost:
                self.used.add(f"{path}[]")
            parts = [(x, f"{path}[{i}]", inner, None) for i, x in enumerate(v)] + [(..., e["path"], inner, e) for e in lost]
            ends = "[]"
        elif isinstance(v, dict):
            keys = sorted(v, key=str.encode) + sorted(self.named.get(path, set()) - v.keys(), key=str.encode)
            parts = [(v.get(k, ...), f"{path}.{k}", f'{inner}"{k}": ', None) for k in keys]
            ends = "{}"
        else:
            self.out.append(f"{lead}{_plain(v)}{tail}{note}")
            return
        if not parts:
            self.out.append(f"{lead}{ends}{tail}{note}")
            return
        self.out.append(f"{lead}{ends[0]}{note}")
        for i, (x, at, before, error) in enumerate(parts):
            comma = "," if i < len(parts) - 1 else ""
            if error:
                self.out.append(f'{before}undefined{comma}{MARK}[{{"path":"{error["path"]}","expected":"{error["expected"]}"}}]')
            elif x is ... or x is None and isinstance(v, list):
                self.out.append(f"{before}undefined{comma}{self.note(at)}")
            else:
                self.show(x, at, inner, before, comma)
        self.out.append(f"{pad}{ends[1]}{tail}")


def printed(text: str, errors: list[dict]) -> str:
    p = _Printer(errors)
    p.show(json.loads(text), "$input", "", "", "")
    whole = "```json\n" + "\n".join(p.out) + "\n```"
    rest = [e for e in errors if e["path"] not in p.used]
    return whole + (OTHERS + ",".join(f'\n  {{"path":"{e["path"]}","expected":"{e["expected"]}"}}' for e in rest) + "\n]\n```" if rest else "")


def lists_of_errors(errors: pa.ListArray) -> list[list[dict]]:
    """Errors by record, read a field at a time: a list for null is empty."""
    flat = errors.flatten()
    rows = iter([{"path": p, "expected": e, "description": d} for p, e, d in zip(*(flat.field(n).to_pylist() for n in ("path", "expected", "description")), strict=True)])
    return [list(islice(rows, n or 0)) for n in errors.value_lengths().to_pylist()]


@F.arrow_udf(StringType())
def _printed(texts: pa.Array, errors: pa.Array) -> pa.Array:
    sys.setrecursionlimit(_FRAMES)
    return pa.array([printed(t, e) if t is not None and e else None for t, e in zip(texts.to_pylist(), lists_of_errors(errors), strict=True)], pa.string())


def record_feedback(text: Column, errors: Column) -> Column:
    """The feedback on a record (JSON text) with its errors; null where there are none, or no text."""
    told = F.transform(errors, lambda e: F.struct(e["path"].alias("path"), e["expected"].alias("expected"), e["description"].alias("description")))  # values stand in the text
    return _printed(F.when(F.size(errors) > 0, text), told)
