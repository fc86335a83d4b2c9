"""Validation of flat records against a schema, statistics and feedback, as DataFrame operators.

A schema is a dict in JSON Schema's terms. It is compiled once, on the driver, into one array
Column of error structs, so a scan, its checks and the statistics on them are one stage.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formats import is_format

ERROR = "struct<path:string,expected:string,value:string,description:string>"


def _error(path: str, expected: str, value: Column, description: Column | None = None) -> Column:
    return F.struct(F.lit(path).alias("path"), F.lit(expected).alias("expected"), value.cast("string").alias("value"), (F.lit(None).cast("string") if description is None else description).alias("description"))


def _number(limit: float) -> str:
    return f"{'integer' if float(limit).is_integer() else 'number'} & "


def _limit(x: float) -> str:
    return str(int(x)) if float(x).is_integer() else str(x)


_INTEGER, _REAL = r"^\s*[+-]?\d+\s*\z", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def _fraction(kind: Column, text: Column) -> Column:
    number = text.try_cast("double")
    return kind.rlike("^(float|double|decimal)") & (number != F.rint(number))


#: Whether a column of some kind holds what can't be a value of a schema's type: texts that don't read as one, fractions for integers.
_UNREAD = {
    "integer": lambda kind, text: ((kind == "string") & ~text.rlike(_INTEGER)) | F.coalesce(_fraction(kind, text), F.lit(False)),
    "number": lambda kind, text: (kind == "string") & ~text.rlike(_REAL),
    "boolean": lambda kind, text: ((kind == "string") & ~text.isin("true", "false")) | kind.rlike("^(tinyint|smallint|int|bigint|float|double|decimal)"),
}


def field_errors(name: str, rules: dict, value: Column, required: bool) -> list[Column]:
    """A Column for each keyword: an error struct where it is broken, else null."""
    path, text = f"$input.{name}", value.cast("string")
    found = []

    def add(bad: Column, expected: str) -> None:
        found.append(F.when(value.isNotNull() & bad, _error(path, expected, text)))

    if required:
        missing = F.lit(f"The value at `{path}` is `undefined`.")
        found.append(F.when(value.isNull(), _error(path, "required property", F.lit("null"), missing)))
    if rules.get("type") in _UNREAD:
        add(_UNREAD[rules["type"]](F.typeof(value), text), rules["type"])
    for key, (op, label) in {
        "minimum": (lambda v, x: v < x, "Minimum"), "maximum": (lambda v, x: v > x, "Maximum"),
        "exclusiveMinimum": (lambda v, x: v <= x, "ExclusiveMinimum"), "exclusiveMaximum": (lambda v, x: v >= x, "ExclusiveMaximum"),
    }.items():
        if key in rules:
            add(op(value, rules[key]), f"{_number(rules[key])}{label}<{_limit(rules[key])}>")
    if rules.get("multipleOf"):  # 0 breaks nothing
        from .nested import is_multiple

        add(~is_multiple(value.try_cast("decimal(38,10)"), value.try_cast("double"), rules["multipleOf"]), f"number & MultipleOf<{_limit(rules['multipleOf'])}>")
    if "minLength" in rules:
        add(F.length(text) < rules["minLength"], f"string & MinLength<{rules['minLength']}>")
    if "maxLength" in rules:
        add(F.length(text) > rules["maxLength"], f"string & MaxLength<{rules['maxLength']}>")
    if "pattern" in rules:
        add(~text.rlike(rules["pattern"]), f'string & Pattern<"{rules["pattern"]}">')
    if "format" in rules:
        add(~is_format(text, rules["format"]), f'string & Format<"{rules["format"]}">')
    if "enum" in rules:
        add(~value.isin(*rules["enum"]), f"one of {json.dumps(rules['enum'], separators=(',', ':'))}")
    if "const" in rules:
        add(value != rules["const"], f"const {json.dumps(rules['const'])}")
    return found


def errors_of(schema: dict) -> Column:
    """All errors of a record whose columns are the schema's properties."""
    needed = set(schema.get("required", []))
    found = [e for name, rules in schema["properties"].items() for e in field_errors(name, rules, F.col(name), name in needed)]
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast(f"array<{ERROR}>")


def relation_errors(relations: list[tuple[str, str, str]]) -> Column:
    """Broken (a, operator, b) between numbers; a missing side breaks nothing, nor does an unknown operator."""
    broken = {
        "gte": lambda a, b: a < b, ">=": lambda a, b: a < b, "lte": lambda a, b: a > b, "<=": lambda a, b: a > b, "gt": lambda a, b: a <= b, ">": lambda a, b: a <= b,
        "lt": lambda a, b: a >= b, "<": lambda a, b: a >= b, "eq": lambda a, b: F.abs(a - b) > 2.0**-52, "==": lambda a, b: F.abs(a - b) > 2.0**-52,
    }
    found = [F.when(broken[op](F.col(a).try_cast("double"), F.col(b).try_cast("double")), F.lit(f"{a} must be {op} {b}")) for a, op, b in relations if op in broken]
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>")


def validated(df: DataFrame, schema: dict) -> DataFrame:
    return df.withColumn("errors", errors_of(schema)).withColumn("valid", F.size("errors") == 0)


def error_class(expected: Column, description: Column) -> Column:
    return (
        F.when(expected.contains("Format<"), "format")
        .when(expected.contains("Minimum<") | expected.contains("Maximum<"), "range")
        .when(expected.contains("one of"), "enum")
        .when(F.coalesce(description.contains("undefined"), F.lit(False)), "required")
        .otherwise("type")
    )


def long_errors(df: DataFrame, keys: list[str]) -> DataFrame:
    """A row an error."""
    e = df.select(*keys, F.explode("errors").alias("e")).select(*keys, "e.*")
    return e.withColumn("class", error_class(F.col("expected"), F.col("description")))


def error_counts(df: DataFrame) -> DataFrame:
    """class, path, n: errors by class and field, both also summed (grouping sets)."""
    return long_errors(df, []).cube("class", "path").agg(F.count("*").alias("n"))


def success_rate(df: DataFrame, *keys: str) -> DataFrame:
    """total, successes and rate by keys; a rate over no rows is 0."""
    return df.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if("valid").alias("successes"), F.coalesce(F.avg(F.col("valid").cast("int")), F.lit(0.0)).alias("rate"))


def top_failing(df: DataFrame, n: int) -> DataFrame:
    """path, n of the fields that fail most; ties by name."""
    return long_errors(df, []).groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(n)


# Fixed values.
HINTS = {
    "format": "Add format examples to prompt (e.g., 'email must be user@domain.com')", "range": "State numeric ranges explicitly in prompt", "enum": "List all allowed values in prompt",
    "required": "Emphasize required fields with 'MUST include'", "type": "Check type constraints in schema",
}


def prompt_hints(df: DataFrame) -> DataFrame:
    """hint: one for each of the five fields that fail most and each class of more than three errors."""
    by_field = top_failing(df, 5).select(F.format_string("Field '%s' fails %d times — add explicit constraint to prompt", "path", "n").alias("hint"))
    text = F.element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), F.col("class"))
    by_class = long_errors(df, []).groupBy("class").agg(F.count("*").alias("n")).where("n > 3")
    return by_field.unionByName(by_class.select(F.format_string("%s: %d errors — %s", "class", "n", text).alias("hint")))


def _note(errors: Column) -> Column:
    """Errors as JSON objects, with their descriptions where they have one."""
    said = lambda e: F.when(e["description"].isNotNull(), F.concat(F.lit(',"description":"'), F.replace(F.replace(e["description"], F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))).otherwise("")
    return F.transform(errors, lambda e: F.concat(F.lit('{"path":"'), e["path"], F.lit('","expected":"'), e["expected"], F.lit('"'), said(e), F.lit("}")))


def feedback(df: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """keys, feedback: an invalid record as fenced JSON, each broken field followed by its errors in a comment; errors of other fields in a list below."""

    def line(name: str) -> Column:
        own = F.filter("errors", lambda e: e["path"] == f"$input.{name}")
        value = F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col(name).alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit(""))
        shown = F.when(F.col(name).isNull(), "undefined").otherwise(value)
        return F.concat(F.lit(f'  "{name}": '), shown, F.lit("" if name == names[-1] else ","), F.when(F.size(own) > 0, F.concat(F.lit(" // ❌ ["), F.array_join(_note(own), ","), F.lit("]"))).otherwise(""))

    other = F.filter("errors", lambda e: ~e["path"].isin(*[f"$input.{n}" for n in names]))
    bare = F.transform(other, lambda e: F.concat(F.lit('\n  {"path":"'), e["path"], F.lit('","expected":"'), e["expected"], F.lit('"}')))
    rest = F.when(F.size(other) > 0, F.concat(F.lit("\n\n**Unmappable validation errors:**\n```json\n["), F.array_join(bare, ","), F.lit("\n]\n```"))).otherwise("")
    text = F.concat(F.lit("```json\n{\n"), F.concat_ws("\n", *[line(n) for n in names]), F.lit("\n}\n```"), rest)
    return df.where(~F.col("valid")).select(*keys, text.alias("feedback"))


def compressed(df: DataFrame, keys: list[str], text: str, most: int = 20) -> DataFrame:
    """keys, text: of more than `most` lines, the first two of each "expected" and a count of the others."""
    lines = df.select(*keys, F.posexplode(F.split(text, "\n")).alias("at", "line"), F.size(F.split(text, "\n")).alias("n"))
    kind = F.nullif(F.regexp_extract("line", r'"expected":"((?:[^"]|"(?=[^,}]))*)"', 1), F.lit(""))
    lines = lines.withColumn("kind", kind)
    nth = F.row_number().over(Window.partitionBy(*keys, "kind").orderBy("at"))
    last = F.count("*").over(Window.partitionBy(*keys, "kind"))
    lines = lines.withColumns({"nth": nth, "times": last})
    kept = lines.where((F.col("n") <= most) | F.col("kind").isNull() | (F.col("nth") <= 3))
    more = (F.col("n") > most) & F.col("kind").isNotNull() & (F.col("nth") == 3)
    shown = F.when(more, F.concat(F.lit("  ("), (F.col("times") - 2).cast("string"), F.lit(" more '"), F.col("kind"), F.lit("' errors omitted)"))).otherwise(F.col("line"))
    whole = kept.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at", shown.alias("line")))).alias("parts"))
    return whole.select(*keys, F.array_join(F.transform("parts", lambda p: p["line"]), "\n").alias(text))


def truthy(c: Column) -> Column:
    """Whether a value of any type counts as true: all but null, false, 0, an empty text and an empty array."""
    text = F.to_json(c.cast("variant"))
    return F.coalesce(~text.isin("null", "false", '""', "[]") & ~text.rlike(r"^-?0(\.0+)?(E-?\d+)?\z"), F.lit(False))


def _true(c: Column, logic: object) -> Column:
    """Whether what a rule gives counts as true: booleans as they are, numbers against 0, texts against the empty one; others by truthy()."""
    kind = _result(logic)
    if kind == "boolean":
        return F.coalesce(c, F.lit(False)) if isinstance(logic, dict) else c
    if kind == "number":
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(c != "", F.lit(False)) if kind == "string" else truthy(c)


_BOOLEAN = {"==", "===", "!=", "!==", "<", "<=", ">", ">=", "and", "or", "!", "!!", "in", "some", "all", "none"}
_NUMERIC = {"+", "-", "*", "/", "%", "min", "max"}


def _result(logic: object) -> str:
    """The kind of value that a rule gives, as far as it tells: a column's isn't known."""
    if isinstance(logic, dict) and len(logic) == 1:
        op = next(iter(logic))
        return "boolean" if op in _BOOLEAN else "number" if op in _NUMERIC else "string" if op in ("cat", "substr") else op
    return "boolean" if isinstance(logic, bool) else "number" if isinstance(logic, (int, float)) else "string" if isinstance(logic, str) else "null" if logic is None else "list"


def _equal(a: Column, b: Column, left: object, right: object) -> Column:
    """Equality; beside a constant the other side is read as its type."""
    kinds = {_result(left), _result(right)}
    if kinds & {"number"}:
        return a.try_cast("double").eqNullSafe(b.try_cast("double"))
    if kinds & {"string", "boolean"}:
        return a.cast("string").eqNullSafe(b.cast("string"))
    return a.eqNullSafe(b)


def _variable(name: str, record: Column | None) -> Column:
    """A variable by dotted path; a number in it is an element's place."""
    if record is not None and name == "":
        return record
    first, *rest = name.split(".")
    out = F.col(first) if record is None else record[first]
    for step in rest:
        out = F.get(out, F.lit(int(step))) if step.isdigit() else out[step]
    return out


def _unlike(left: object, right: object) -> bool:
    """Whether two sides are known to be of different kinds: for the strict comparisons that is enough to differ."""
    kinds = [_result(left), _result(right)]
    return all(k in ("boolean", "number", "string", "null", "list") for k in kinds) and kinds[0] != kinds[1]


def compile_rule(logic: object, record: Column | None = None, columns: list[str] | None = None) -> Column:
    """A JSONLogic rule as a Column over the record's columns: variables, arithmetic, comparison, boolean, conditional and array operators.

    columns: those there are; a variable that isn't among them is null. Raises ValueError on an
    operator that isn't known; the caller reports that as a violation.
    """
    if isinstance(logic, list):
        return F.array(*[compile_rule(x, record, columns) for x in logic])
    if not isinstance(logic, dict):
        return F.lit(logic)
    (op, args), = logic.items()
    inner = lambda x: compile_rule(x, record, columns)
    known = lambda name: columns is None or record is not None or str(name).split(".")[0] in columns
    value = lambda name: _variable(str(name), record) if known(name) else F.lit(None)
    listed = args if isinstance(args, list) else [args]
    if op == "var":
        name = listed[0] if listed else ""
        return F.coalesce(value(name), F.lit(listed[1])) if len(listed) > 1 else value(name)
    if op in ("missing", "missing_some"):
        names = listed[1] if op == "missing_some" else listed
        lost = F.filter(F.array(*[F.when(value(n).isNull() | (value(n).cast("string") == ""), F.lit(n)) for n in names]), lambda x: x.isNotNull())
        return lost if op == "missing" else F.when(F.lit(len(names)) - F.size(lost) >= listed[0], F.array().cast("array<string>")).otherwise(lost)
    if op in ("some", "all", "none", "map", "filter"):
        items = inner(listed[0])
        each = lambda e: compile_rule(listed[1], e, columns)
        if op == "map":
            return F.transform(items, each)
        if op == "filter":
            return F.filter(items, lambda e: _true(each(e), listed[1]))
        any_ = F.coalesce(F.exists(items, lambda e: _true(each(e), listed[1])), F.lit(False))
        return any_ if op == "some" else ~any_ if op == "none" else F.coalesce(F.forall(items, lambda e: _true(each(e), listed[1])) & (F.size(items) > 0), F.lit(False))
    if op == "reduce":
        items = inner(listed[0])
        return F.aggregate(items, inner(listed[2]).cast("double"), lambda acc, e: compile_rule(listed[1], F.struct(e.alias("current"), acc.alias("accumulator")), columns).cast("double"))
    if op == "in" and isinstance(listed[1], list):
        return inner(listed[0]).isin(*listed[1])
    parts = [inner(a) for a in listed]
    chain = lambda f: f(parts[0], parts[1]) & f(parts[1], parts[2]) if len(parts) == 3 else f(parts[0], parts[1])
    if op in ("==", "===", "!=", "!=="):
        same = F.lit(False) if len(op) == 3 and _unlike(*listed) else _equal(*parts, *listed)
        return same if op[0] == "=" else ~same
    compare = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
    if op in compare:
        if any(_result(x) == "number" for x in listed):
            parts = [p.try_cast("double") for p in parts]
        return F.coalesce(chain(compare[op]), F.lit(False))
    if op in ("and", "or"):
        if not parts:
            return F.lit(None)
        out = _true(parts[0], listed[0])
        for p, x in zip(parts[1:], listed[1:], strict=True):
            out = out & _true(p, x) if op == "and" else out | _true(p, x)
        return out
    if op in ("!", "!!"):
        return ~_true(parts[0], listed[0]) if op == "!" else _true(parts[0], listed[0])
    if op in ("if", "?:"):
        if len(parts) == 1:
            return parts[0]
        results = [x for i, x in enumerate(listed) if i % 2 or i == len(listed) - 1]
        mixed = len({_result(x) for x in results} - {"null"}) > 1
        as_one = lambda c: c.cast("variant") if mixed else c
        out = as_one(parts[-1]) if len(parts) % 2 else F.lit(None)
        for i in range(len(parts) - 2 - len(parts) % 2, -1, -2):
            out = F.when(_true(parts[i], listed[i]), as_one(parts[i + 1])).otherwise(out)
        return out
    fold = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: a / F.nullif(b, F.lit(0.0)), "%": lambda a, b: a % F.nullif(b, F.lit(0.0))}
    if op in fold:
        parts = [p if _result(x) == "number" else p.try_cast("double") for p, x in zip(parts, listed, strict=True)]
        out = -parts[0] if op == "-" and len(parts) == 1 else parts[0]
        for p in parts[1:]:
            out = fold[op](out, p)
        return out
    if op in ("min", "max"):
        return (F.least if op == "min" else F.greatest)(*parts) if len(parts) > 1 else parts[0]
    if op == "in":
        return F.contains(parts[1].cast("string"), parts[0].cast("string"))
    if op == "cat":
        return F.concat_ws("", *[p.cast("string") for p in parts])
    if op == "merge":
        return F.concat(*[p if _result(x) in ("list", "missing", "merge", "map", "filter", "var") else F.array(p) for p, x in zip(parts, listed, strict=True)])
    if op == "substr":
        start, text = listed[1], parts[0].cast("string")
        tail = F.substring(text, start + 1 if start >= 0 else start, 1 << 30)
        return tail if len(listed) < 3 else F.substring(tail, F.lit(1), F.lit(listed[2]) if listed[2] >= 0 else F.length(tail) + listed[2])
    raise ValueError(f"unknown operator {op}")


def rule_errors(rules: list[tuple[str, object]], columns: list[str] | None = None) -> Column:
    """Descriptions of the rules that a record breaks; a rule that can't be evaluated breaks. columns: the record's, so that other names are null."""
    found = []
    for description, logic in rules:
        try:
            found.append(F.when(~_true(compile_rule(logic, columns=columns), logic), F.lit(description)))
        except ValueError as e:
            found.append(F.lit(f"{description}: rule evaluation error: {e}"))
    return F.filter(F.array(*found), lambda e: e.isNotNull()) if found else F.array().cast("array<string>")


def cross_field_document(relations: Column, rules: Column) -> Column:
    """The violations as one JSON document with codes REL001 and RULE001; null where there are none."""
    entry = lambda code: lambda m: F.struct(F.lit(code).alias("code"), m.alias("message"))
    both = F.concat(F.transform(relations, entry("REL001")), F.transform(rules, entry("RULE001")))
    return F.when(F.size(both) > 0, F.to_json(F.struct(F.lit("Cross-field constraints violated").alias("feedback"), both.alias("diagnostics"))))


def guard(df: DataFrame, schema: dict, relations: list, rules: list) -> DataFrame:
    """df with errors, relation and rule violations, and whether the record passes all."""
    out = validated(df, schema).withColumns({"relations": relation_errors(relations), "rules": rule_errors(rules, df.columns)})
    return out.withColumn("passes", F.col("valid") & (F.size("relations") + F.size("rules") == 0))
