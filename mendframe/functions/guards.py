"""Safety classifiers of urls and prompts, and name rules, as Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BLOCKED_HOSTS = ["localhost", "metadata.google.internal", "metadata.internal"]
INJECTIONS = [
    "ignore previous instructions", "ignore all instructions", "ignore above", "ignore the above", "disregard previous", "disregard all previous", "disregard above", "forget your instructions",
    "forget all instructions", "forget everything above", "system override", "system prompt", "new instructions", "you are now", "act as", "pretend you are", "do not follow", "override your", "bypass", "jailbreak",
]


def url_host(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(url, r"^(?:https?://)+([^/:]*)", 1), r"^\[+", ""), r"\]+$", "")


def url_code(url: Column) -> Column:
    """The security code against a url, or null if it may be fetched."""
    host = url_host(url)
    low = F.lower(host)
    parts = F.split(host, r"\.")
    octets = F.transform(parts, lambda p: F.when(p.rlike(r"^(0|[1-9]\d{0,2})$"), p.try_cast("int")))
    a, b = F.get(octets, F.lit(0)), F.get(octets, F.lit(1))
    is_ip = (F.size(parts) == 4) & F.forall(octets, lambda o: o.isNotNull() & (o <= 255))
    private = a.isin(0, 10, 127) | (a >= 224) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168))
    blocked = F.lit(False)
    for h in BLOCKED_HOSTS:
        blocked = blocked | (low == h) | low.endswith(f".{h}")
    numeric = host.rlike(r"^[0-9.]+$")
    return (
        F.when(~url.rlike("^https?://") | (host == ""), "SEC001")
        .when(host.rlike("[^A-Za-z0-9.-]"), "SEC005")
        .when(numeric & ~F.coalesce(is_ip, F.lit(False)), "SEC005")
        .when(numeric & private, "SEC003")
        .when(blocked, "SEC002")
        .when(low.rlike("^0[xo]") | low.contains("ffff"), "SEC005")
    )


def path_component(name: Column) -> Column:
    return F.translate(name, "/\\: .", "_____")


def sanitized(text: Column) -> Column:
    """text with each injection phrase, in any case, put as [filtered]; the longest phrase at a place wins."""
    phrases = "|".join(re.escape(p) for p in sorted(INJECTIONS, key=len, reverse=True))
    return F.regexp_replace(text, f"(?i)({phrases})", "[filtered]")


def task_scale(description: Column, lines: Column) -> Column:
    """S, M or L: by estimated lines, else by words of the description."""
    low = F.lower(description)
    words = F.when(low.rlike("fix|bug|typo|rename"), "S").when(low.rlike("feature|add|implement"), "M").otherwise("L")
    return F.when(lines < 50, "S").when(lines < 500, "M").otherwise(words)
