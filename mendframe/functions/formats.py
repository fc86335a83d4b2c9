"""String formats as Column predicates. Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

# What each format accepts.
PATTERNS = {
    "email": r"(?i)^[a-z0-9!#$%&'*+/=?^_`{|}~-]+(?:\.[a-z0-9!#$%&'*+/=?^_`{|}~-]+)*@(?:[a-z0-9](?:[a-z0-9-]*[a-z0-9])?\.)+[a-z0-9](?:[a-z0-9-]*[a-z0-9])?$",
    "idn-email": r"^.+@([^<>()\[\].,;:\s@]+\.)+[^<>()\[\].,;:\s@]{2,}$",
    "uri": r"(?i)^[a-z][a-z0-9+\-.]*:.+$",
    "url": r"(?i)^https?://[^\s/$.?#].[^\s]*$",
    "uri-template": r"(?i)^([^\x00-\x20<>%\\^`|]|%[0-9a-f]{2}|\{[+#./;?&=,!@|]?[a-z0-9_,%]+\})*$",
    "iri": r"^[A-Za-z][\d+\-.A-Za-z]*:[^\x00-\x20<>\\^`|]*$",
    "uuid": r"(?i)^(?:urn:uuid:)?[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$",
    "date-time": r"(?i)^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])[T\s]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,9})?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$",
    "date": r"^[0-9]{4}-(0[1-9]|1[0-2])-(0[1-9]|[12][0-9]|3[01])$",
    "time": r"(?i)^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]{1,9})?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$",
    "duration": r"^P((\d+Y)?(\d+M)?(\d+D)?(T(\d+H)?(\d+M)?(\d+S)?)?|(\d+W))$",
    "ipv4": rf"^({_OCTET}\.){{3}}{_OCTET}$",
    "hostname": r"(?i)^[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?(?:\.[a-z0-9](?:[-0-9a-z]{0,61}[0-9a-z])?)*\.?$",
    "json-pointer": r"^(?:/(?:[^~/]|~0|~1)*)*$",
    "relative-json-pointer": r"^(?:0|[1-9][0-9]*)(?:#|(?:/(?:[^~/]|~0|~1)*)*)$",
    "byte": r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$",
}
#: Names of character properties: general categories, and scripts and blocks by their usual form.
_PROPERTY = r"^(\^?(L[ulmot]?|M[nce]?|N[dlo]?|P[cdseifo]?|S[mcko]?|Z[slp]?|C[cfson]?)|Alpha(betic)?|Letter|Number|Punctuation|Symbol|Upper(case)?|Lower(case)?|White_?Space|Is\w+|In\w+|(Script|sc|Block|blk|General_Category|gc)=\w+|Latin|Greek|Cyrillic|Han|Hiragana|Katakana|Hangul|Arabic|Hebrew|Thai)$"
LONGEST = 10_000
SUPPORTED = sorted({*PATTERNS, "idn-hostname", "iri-reference", "uri-reference", "ipv6", "regex", "password"})


def ipv6(c: Column) -> Column:
    """Up to eight groups of one to four hex digits, one run of them left out, an IPv4 address for the last two."""
    v4 = F.regexp_extract(c, rf"^(?:.*:)({_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET})$", 1)
    s = F.when(v4 != "", F.regexp_replace(c, r"[^:]+$", "0:0")).otherwise(c)
    groups = F.split(s, ":")
    short = s.contains("::")
    good = F.forall(groups, lambda g: g.rlike("(?i)^[0-9a-f]{0,4}\\z"))
    # Empty groups stand only where the run is left out: one within, two at an end, three alone.
    empty = F.size(F.filter(groups, lambda g: g == ""))
    room = F.when(s == "::", 3).when(s.startswith("::") | s.endswith("::"), 2).otherwise(1)
    return good & ~s.contains(":::") & F.when(short, (empty == room) & (F.size(groups) - empty <= 7)).otherwise((empty == 0) & (F.size(groups) == 8))


def _whole(pattern: str) -> str:
    """The pattern with an end that no line feed may follow: Java's $ lets one."""
    return pattern[:-1] + r"\z" if pattern.endswith("$") else pattern


def regex(c: Column) -> Column:
    """Whether a text can be a regular expression: no lone backslash at its end, brackets closed, nothing repeated where nothing stands."""
    bare = F.regexp_replace(c, r"(?s)\\.", "x")
    classes = F.regexp_replace(bare, r"\[\^?\]?[^\]]*\]", "x")
    steps = F.transform(F.split(F.regexp_replace(classes, "[^()]", ""), ""), lambda p: F.when(p == "(", 1).when(p == ")", -1).otherwise(0))
    # The depth, or a large negative number once a bracket closes nothing.
    depth = F.aggregate(steps, F.lit(0), lambda d, p: F.when(d + p < 0, F.lit(-1 << 20)).otherwise(d + p))
    # Ranges and counts that run backwards, and properties that no engine knows.
    ranges = F.regexp_extract_all(c, F.lit(r"(?s)\[\^?\]?[^\]]*\]"), F.lit(0))
    spans = lambda k: F.flatten(F.transform(ranges, lambda r: F.regexp_extract_all(r, F.lit(r"([A-Za-z0-9])-([A-Za-z0-9])"), F.lit(k))))
    backwards = F.exists(F.zip_with(spans(1), spans(2), lambda a, b: F.ascii(a) > F.ascii(b)), lambda x: x)
    least, most = (F.regexp_extract_all(classes, F.lit(r"\{(\d+),(\d+)\}"), F.lit(k)) for k in (1, 2))
    counts = F.exists(F.zip_with(least, most, lambda a, b: F.coalesce(a.try_cast("decimal(38,0)") > b.try_cast("decimal(38,0)"), F.lit(False))), lambda x: x)
    named = F.transform(F.regexp_extract_all(c, F.lit(r"\\[pP]\{([^}]*)\}"), F.lit(1)), lambda n: ~n.rlike(_PROPERTY))
    odd = backwards | counts | F.exists(named, lambda x: x)
    return ~bare.endswith("\\") & ~classes.contains("[") & (depth == 0) & ~classes.rlike(r"^[*+?]|[(|][*+]|\|\?") & ~odd


def is_format(c: Column, name: str) -> Column:
    """Whether the text has the format; unknown formats accept all, none accepts more than LONGEST bytes."""
    name = {"datetime": "date-time", "iri-reference": "iri"}.get(name, name)
    if name == "uri-reference":
        ok = (c == "") | c.rlike(_whole(PATTERNS["uri"])) | c.rlike("^[/#?]")
    elif name == "idn-hostname":
        label = lambda x: (F.length(x) > 0) & (F.octet_length(x) <= 63) & ~x.startswith("-") & ~x.endswith("-")
        ok = (c != "") & (F.octet_length(c) <= 253) & F.forall(F.split(c, r"\."), label)
    elif name == "duration":
        ok = c.rlike(_whole(PATTERNS[name])) & ~c.isin("P", "PT")
    elif name == "hostname":
        ok = c.rlike(_whole(PATTERNS[name])) & (F.octet_length(F.regexp_replace(c, r"\.$", "")) <= 253)
    elif name == "ipv6":
        ok = ipv6(c)
    elif name == "regex":
        ok = regex(c)
    else:
        ok = c.rlike(_whole(PATTERNS[name])) if name in PATTERNS else F.lit(True)
    return (F.octet_length(c) <= LONGEST) & ok
