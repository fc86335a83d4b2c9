"""The format predicates for values that a task holds: formats.py's patterns and rules, text by text."""

from __future__ import annotations

import functools
import ipaddress
import re

from .formats import LONGEST, PATTERNS

try:
    import regex as engine  # knows \\p{..}
except ImportError:
    engine = re


@functools.cache
def pattern(text: str) -> re.Pattern:
    return engine.compile(text)


@functools.cache
def _whole(name: str) -> re.Pattern:
    source = PATTERNS[name]
    return re.compile((source[:-1] + r"\Z" if source.endswith("$") else source), re.ASCII if name not in ("idn-email", "iri") else 0)


def _compiles(text: str) -> bool:
    try:
        engine.compile(text)
    except (engine.error, OverflowError, RecursionError, ValueError):
        return False
    return True


def _ipv6(text: str) -> bool:
    try:
        return "%" not in text and ipaddress.IPv6Address(text) is not None
    except ValueError:
        return False


def has_format(text: str, name: str) -> bool:
    """Whether the text has the format; unknown formats accept all, none accepts more than LONGEST bytes."""
    name = {"datetime": "date-time", "iri-reference": "iri"}.get(name, name)
    size = len(text.encode("utf-8", "surrogatepass"))
    if size > LONGEST:
        return False
    if name == "uri-reference":
        return text == "" or text[0] in "/#?" or bool(_whole("uri").match(text))
    if name == "idn-hostname":
        return text != "" and size <= 253 and all(x and len(x.encode()) <= 63 and x[0] != "-" != x[-1] for x in text.split("."))
    if name == "ipv6":
        return _ipv6(text)
    if name == "regex":
        return _compiles(text)
    if name not in PATTERNS or not _whole(name).match(text):
        return name not in PATTERNS
    return {"duration": text not in ("P", "PT"), "hostname": len(text.removesuffix(".")) <= 253}.get(name, True)
