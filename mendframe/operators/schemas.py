"""Schemas as data: one row a property, (schema_id, path, type, format, minimum, maximum, values, required, description, default).

minimum and maximum are doubles, values (an enum's) an array of strings, the rest strings and
a boolean. flat_properties() makes such rows of schema texts.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FACETS = ["type", "format", "minimum", "maximum", "values", "description", "default"]
ROW = "path string, type string, format string, minimum double, maximum double, `values` array<string>, required boolean, description string, `default` string"
DEEPEST = 16


def resolved(schema: dict, root: dict, depth: int = 0) -> dict:
    """schema with its reference followed, by the last name of the pointer, and the parts of allOf laid over each other."""
    while "$ref" in schema and depth < DEEPEST:
        name, depth = schema["$ref"].rsplit("/", 1)[-1], depth + 1
        found = (root.get("$defs") or {}).get(name) or (root.get("definitions") or {}).get(name)
        if found is None:
            return schema
        schema = found
    if "allOf" in schema:
        out: dict = {"properties": {}, "required": []}
        for part in schema["allOf"]:
            own = resolved(part, root, depth + 1) if depth < DEEPEST else {}
            out["properties"] |= own.get("properties", {})
            out["required"] += own.get("required", [])
        return {k: v for k, v in schema.items() if k not in ("allOf", "properties", "required")} | out
    return schema


def flattened(schema: dict, root: dict | None = None, prefix: str = "", depth: int = 0) -> list[dict]:
    """Rows of a schema's properties by dotted path; arrays aren't entered."""
    root = schema if root is None else root
    own, out = resolved(schema, root), []
    for name, raw in sorted((own.get("properties") or {}).items()):
        p = resolved(raw, root)
        if p.get("properties") and depth < DEEPEST:
            out += flattened(p, root, f"{prefix}{name}.", depth + 1)
            continue
        text = lambda v: v if isinstance(v, str) or v is None else json.dumps(v, sort_keys=True)
        number = lambda v: float(v) if isinstance(v, (int, float)) else None
        out.append({
            "path": prefix + name, "type": text(p.get("type")), "format": p.get("format"), "minimum": number(p.get("minimum")), "maximum": number(p.get("maximum")),
            "values": [text(v) for v in p["enum"]] if "enum" in p else None, "required": name in own.get("required", []), "description": p.get("description"), "default": text(p.get("default")),
        })
    return out


def flat_properties(schemas: DataFrame) -> DataFrame:
    """schema_id and property rows of (schema_id, body), in one Arrow pass; a body that isn't a JSON object has none."""
    target = schemas.sparkSession.createDataFrame([], f"schema_id string, {ROW}").schema

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(target)
        for batch in batches:
            rows = []
            for schema_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    schema = json.loads(body or "")
                except ValueError:
                    continue
                rows += [{"schema_id": schema_id, **r} for r in flattened(schema)] if isinstance(schema, dict) else []
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return schemas.select(F.col("schema_id").cast("string"), "body").mapInArrow(run, target)


def _facet_texts(alias: str) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("field"), F.when(F.col(f"{alias}.{f}").isNotNull(), F.to_json(F.struct(F.col(f"{alias}.{f}").alias("v")))).alias("v")) for f in FACETS])


def diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, path, change (added, removed, changed), field, old, new between property rows; unchanged properties give none."""
    on = [*keys, "path"]
    both = old.alias("o").join(new.alias("n"), on, "full_outer")
    gone, came = F.col("n.type").isNull() & F.col("n.required").isNull(), F.col("o.type").isNull() & F.col("o.required").isNull()
    pairs = F.zip_with(_facet_texts("o"), _facet_texts("n"), lambda a, b: F.struct(a["field"].alias("field"), a["v"].alias("old"), b["v"].alias("new")))
    changed = F.filter(pairs, lambda p: ~p["old"].eqNullSafe(p["new"]))
    value = lambda c: F.regexp_extract(c, r'^\{"v":(.*)\}$', 1)
    none = F.lit(None).cast("string")
    rows = (
        F.when(gone, F.array(F.struct(F.lit("removed").alias("change"), none.alias("field"), none.alias("old"), none.alias("new"))))
        .when(came, F.array(F.struct(F.lit("added").alias("change"), none.alias("field"), none.alias("old"), none.alias("new"))))
        .otherwise(F.transform(changed, lambda p: F.struct(F.lit("changed").alias("change"), p["field"].alias("field"), value(p["old"]).alias("old"), value(p["new"]).alias("new"))))
    )
    return both.select(*on, F.explode(rows).alias("d")).select(*on, "d.*")


def compatible(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_changes, compatible: nothing removed, only descriptions and defaults changed."""
    mild = (F.col("change") == "added") | ((F.col("change") == "changed") & F.col("field").isin("description", "default", "example"))
    return diffs.groupBy(*keys).agg(F.count("*").alias("n_changes"), F.bool_and(mild).alias("compatible"))


def enum_agreement(props: DataFrame) -> DataFrame:
    """path, n_schemas, all_values, common_values of properties with enums: union and intersection over schemas."""
    with_enum = props.where("values is not null").select("path", "schema_id", F.array_distinct("values").alias("values"))
    n = with_enum.groupBy("path").agg(F.countDistinct("schema_id").alias("n_schemas"))
    each = with_enum.select("path", "schema_id", F.explode("values").alias("value")).groupBy("path", "value").agg(F.countDistinct("schema_id").alias("held"))
    both = each.join(n, "path")
    return both.groupBy("path", "n_schemas").agg(
        F.array_join(F.sort_array(F.collect_list("value")), ",").alias("all_values"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("held") == F.col("n_schemas"), F.col("value")))), ",").alias("common_values"),
    )


def facet_agreement(props: DataFrame) -> DataFrame:
    """path, facet, n, total, universal, value: whether the schemas that set a facet agree on it, and required counts. One aggregation gives all facets."""
    eps = 2.0**-52
    row = lambda facet, n, same, value: F.struct(F.lit(facet).alias("facet"), n.alias("n"), F.count("*").alias("total"), same.alias("universal"), F.when(same, value).cast("string").alias("value"))
    rows = [row(f, F.count(f), F.max(f) - F.min(f) <= eps, F.min(f)) for f in ("minimum", "maximum")]
    rows += [row(f, F.count(f), F.min(f) == F.max(f), F.min(f)) for f in ("format", "type")]
    rows.append(row("required", F.count_if("required"), F.count_if("required") == F.count("*"), F.lit(None).cast("string")))
    return props.groupBy("path").agg(F.array(*rows).alias("rows")).select("path", F.inline("rows")).where("n > 0 or facet = 'required'")


def shape_warnings(schemas: DataFrame) -> DataFrame:
    """schema_id, code, severity, path of (schema_id, body): S007 a root that says no type, S004 arrays without items, S008 objects without properties."""
    v = F.try_parse_json("body")
    has = lambda c, k: F.try_variant_get(c, f"$.{k}", "variant").isNotNull()
    parsed = schemas.select("schema_id", v.alias("v")).where("v is not null")
    bare = ~(has(F.col("v"), "type") | has(F.col("v"), "anyOf") | has(F.col("v"), "oneOf") | has(F.col("v"), "`$ref`".strip("`")))
    kind = lambda p: F.try_variant_get(p["value"], "$.type", "string")
    entries = F.map_entries(F.try_variant_get("v", "$.properties", "map<string,variant>"))
    warn = lambda code: lambda p: F.struct(F.lit(code).alias("code"), F.lit("Warn").alias("severity"), F.concat(F.lit("$."), p["key"]).alias("path"))
    lists = F.transform(F.filter(entries, lambda p: (kind(p) == "array") & ~has(p["value"], "items")), warn("S004"))
    objects = F.transform(F.filter(entries, lambda p: (kind(p) == "object") & ~has(p["value"], "properties")), warn("S008"))
    root = F.when(bare, F.array(F.struct(F.lit("S007").alias("code"), F.lit("Block").alias("severity"), F.lit("$").alias("path"))))
    none = F.array().cast("array<struct<code:string,severity:string,path:string>>")
    return parsed.select("schema_id", F.inline(F.concat(*[F.coalesce(x, none) for x in (root, lists, objects)])))


def strictness(props: DataFrame) -> DataFrame:
    """schema_id, code, severity, path: what makes schemas too loose."""
    free = (F.col("type") == "string") & F.col("format").isNull() & F.col("values").isNull()
    strings = F.count_if(F.col("type") == "string")
    whole = props.groupBy("schema_id").agg(F.count("*").alias("n"), F.count_if("required").alias("needed"), strings.alias("strings"), F.count_if(free).alias("free"))
    codes = F.array(
        F.when((F.col("n") >= 3) & (F.col("needed") == 0), "S001"), F.when((F.col("strings") >= 3) & (F.col("n") >= 3) & (F.col("free") == F.col("strings")), "S002"), F.when((F.col("n") >= 3) & (F.col("strings") == F.col("n")), "S005")
    )
    blocks = whole.select("schema_id", F.explode(F.filter(codes, lambda c: c.isNotNull())).alias("code"), F.lit("Block").alias("severity"), F.lit("$").alias("path"))
    own = F.array(F.when(F.col("type").isin("number", "integer") & F.col("minimum").isNull() & F.col("maximum").isNull(), "S003"), F.when(F.size("values") >= 50, "S006"))
    warns = props.select("schema_id", F.explode(F.filter(own, lambda c: c.isNotNull())).alias("code"), F.lit("Warn").alias("severity"), F.concat(F.lit("$."), "path").alias("path"))
    return blocks.unionByName(warns)


def loosening(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, code, severity, path: where a new version of a schema accepts more."""
    on = [*keys, "path"]
    both = old.alias("o").join(new.alias("n"), on, "full_outer").withColumns({"was": F.col("o.required").isNotNull(), "is": F.col("n.required").isNotNull()})
    lost = F.coalesce(F.col("o.required"), F.lit(False)) & ~F.coalesce(F.col("n.required"), F.lit(False))
    bare = F.col("n.format").isNull() & F.col("n.values").isNull() & F.col("n.minimum").isNull() & F.col("n.maximum").isNull()
    found = F.array(
        F.when(lost, F.struct(F.lit("L001").alias("code"), F.lit("Block").alias("severity"))),
        F.when(F.col("was") & F.col("is") & F.col("o.format").isNotNull() & F.col("n.format").isNull(), F.struct(F.lit("L003").alias("code"), F.lit("Warn").alias("severity"))),
        F.when((F.col("n.minimum") < F.col("o.minimum")) | (F.col("n.maximum") > F.col("o.maximum")), F.struct(F.lit("L004").alias("code"), F.lit("Warn").alias("severity"))),
        F.when(F.col("o.type").isin("integer", "number", "boolean", "array", "object") & (F.col("n.type") == "string"), F.struct(F.lit("L005").alias("code"), F.lit("Block").alias("severity"))),
        F.when(~F.col("was") & F.col("is") & bare, F.struct(F.lit("L006").alias("code"), F.lit("Warn").alias("severity"))),
    )
    rows = both.select(*on, F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x")).select(*keys, "x.code", "x.severity", F.concat(F.lit("$."), "path").alias("path"))
    counts = both.groupBy(*keys).agg(F.count_if("o.required").alias("a"), F.count_if("n.required").alias("b"))
    fewer = counts.where("a > 0 and 2 * b <= a").select(*keys, F.lit("L007").alias("code"), F.lit("Block").alias("severity"), F.lit("$").alias("path"))
    return rows.unionByName(fewer)


def summary(props: DataFrame) -> DataFrame:
    """schema_id, summary: "name(type, lo-hi, required)" of each property."""
    number = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c).cast("string")).otherwise(F.col(c).cast("string"))
    span = F.when(F.col("minimum").isNotNull() | F.col("maximum").isNotNull(), F.concat(F.coalesce(number("minimum"), F.lit("")), F.lit("-"), F.coalesce(number("maximum"), F.lit(""))))
    text = F.concat("path", F.lit("("), F.concat_ws(", ", "type", span, F.when(F.col("required"), "required")), F.lit(")"))
    return props.groupBy("schema_id").agg(F.array_join(F.sort_array(F.collect_list(text)), ", ").alias("summary"))


def boundary_cases(props: DataFrame) -> DataFrame:
    """schema_id, path, value, valid, kind: the values at and around each limit."""
    case = lambda value, valid, kind: F.struct(value.cast("string").alias("value"), F.lit(valid).alias("valid"), F.lit(kind).alias("kind"))
    whole = lambda c: F.when(F.col(c) == F.floor(c), F.floor(c))
    lo, hi = whole("minimum"), whole("maximum")
    none = F.array().cast("array<struct<value:string,valid:boolean,kind:string>>")
    low = F.when(lo.isNotNull(), F.array(case(lo, True, "min"), case(lo - 1, False, "min-1"), case(lo + 1, True, "min+1"))).otherwise(none)
    high = F.when(hi.isNotNull(), F.array(case(hi, True, "max"), case(hi + 1, False, "max+1"), case(hi - 1, True, "max-1"))).otherwise(none)
    members = F.transform(F.coalesce("values", F.array().cast("array<string>")), lambda v: F.struct(v.alias("value"), F.lit(True).alias("valid"), F.lit("enum").alias("kind")))
    strange = F.when(F.col("values").isNotNull(), F.array(case(F.lit("__INVALID__"), False, "not_in_enum"), case(F.lit(""), False, "empty"))).otherwise(none)
    both = F.when(F.col("type") == "boolean", F.array(case(F.lit("true"), True, "boolean"), case(F.lit("false"), True, "boolean"))).otherwise(none)
    needed = F.when(F.col("required"), F.array(case(F.lit(None), False, "absent"), case(F.lit("present_value"), True, "present"))).otherwise(none)
    return props.select("schema_id", "path", F.explode(F.concat(low, high, members, strange, both, needed)).alias("c")).select("schema_id", "path", "c.*")


def random_rows(spark: SparkSession, props: list[dict], n: int, seed: int = 7) -> DataFrame:
    """n rows of values that the property rows allow; row i is the same in every run."""
    unit = lambda name: F.pmod(F.xxhash64("row", F.lit(name), F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    columns = []
    for p in props:
        u, lo, hi = unit(p["path"]), p.get("minimum"), p.get("maximum")
        lo = 0 if lo is None else lo
        hi = lo + 100 if hi is None else hi
        if p.get("values"):
            v = F.element_at(F.array(*[F.lit(x) for x in p["values"]]), (F.floor(u * len(p["values"])) + 1).cast("int"))
        elif p.get("type") == "integer":
            v = (F.lit(int(lo)) + F.floor(u * (int(hi) - int(lo) + 1))).cast("long")
        elif p.get("type") == "number":
            v = F.round(F.lit(float(lo)) + u * (float(hi) - float(lo)), 2)
        elif p.get("type") == "boolean":
            v = u < 0.5
        elif p.get("format") == "email":
            v = F.concat(F.substring(F.md5(u.cast("string")), 1, 8), F.lit("@example.com"))
        elif p.get("format") == "date":
            v = F.date_format(F.date_add(F.lit("2000-01-01").cast("date"), F.floor(u * 9000).cast("int")), "yyyy-MM-dd")
        else:
            v = F.substring(F.translate(F.md5(u.cast("string")), "0123456789", "ghijklmnop"), 1, 12)
        columns.append(v.alias(p["path"]))
    return spark.range(n).withColumnRenamed("id", "row").select("row", *columns)


def inferred(values: DataFrame) -> DataFrame:
    """path, type, n, required from rows (sample, path, type): the first sample's type, and whether every sample has it."""
    total = values.agg(F.countDistinct("sample")).first()[0]
    by_path = values.groupBy("path").agg(F.min_by("type", "sample").alias("type"), F.countDistinct("sample").alias("n"))
    return by_path.select("path", "type", "n", (F.col("n") == total).alias("required"))


def evolution(props: DataFrame, failures: DataFrame, threshold: int) -> DataFrame:
    """schema_id, path, rate, kind, approval: changes that failure rates suggest. failures: schema_id, path, n, and runs of the schema, of which `threshold` must be in."""
    p = props.join(failures.where(F.col("runs") >= threshold), ["schema_id", "path"]).withColumn("rate", F.col("n") / F.col("runs").cast("double"))
    rows = F.array(
        F.when((F.col("rate") >= 0.1) & F.col("description").isNull(), F.struct(F.lit("DescriptionEnrich").alias("kind"), F.lit("Auto").alias("approval"))),
        F.when((F.col("rate") >= 0.2) & F.col("default").isNull(), F.struct(F.lit("DefaultAdd").alias("kind"), F.lit("Auto").alias("approval"))),
        F.when((F.col("rate") >= 0.3) & F.col("values").isNotNull(), F.struct(F.lit("EnumAdd").alias("kind"), F.lit("Async").alias("approval"))),
        F.when((F.col("rate") >= 0.4) & (F.col("minimum").isNotNull() | F.col("maximum").isNotNull()), F.struct(F.lit("RangeExpand").alias("kind"), F.lit("Async").alias("approval"))),
        F.when(F.col("rate") >= 0.5, F.struct(F.lit("TypeChange").alias("kind"), F.lit("Sync").alias("approval"))),
    )
    return p.select("schema_id", "path", "rate", F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("schema_id", "path", "rate", "x.*")


def evolved(props: DataFrame, proposals: DataFrame) -> DataFrame:
    """props with the proposals that need nobody's approval applied: descriptions and defaults filled in."""
    auto = proposals.where("approval = 'Auto'").groupBy("schema_id", "path").agg(F.bool_or(F.col("kind") == "DescriptionEnrich").alias("_said"), F.bool_or(F.col("kind") == "DefaultAdd").alias("_filled"))
    both = props.join(auto, ["schema_id", "path"], "left")
    zero = F.when(F.col("type").isin("integer", "number"), "0").when(F.col("type") == "boolean", "false").otherwise("")
    made = {"description": F.when(F.col("_said"), F.coalesce("description", F.concat(F.lit("The "), "path"))).otherwise(F.col("description")), "default": F.when(F.col("_filled"), F.coalesce("default", zero)).otherwise(F.col("default"))}
    return both.withColumns(made).select(*props.columns)


def changes(old: DataFrame, new: DataFrame, keys: list[str], content: str) -> DataFrame:
    """keys, status (New, Updated, Unchanged, Removed) of catalog snapshots compared by the digest of their content."""
    a = old.select(*keys, F.sha2(content, 256).alias("old_hash"))
    b = new.select(*keys, F.sha2(content, 256).alias("new_hash"))
    status = F.when(F.col("old_hash").isNull(), "New").when(F.col("new_hash").isNull(), "Removed").when(F.col("old_hash") == F.col("new_hash"), "Unchanged").otherwise("Updated")
    return a.join(b, keys, "full_outer").select(*keys, status.alias("status"))


def ranked(catalog: DataFrame, keyword: str, most: int) -> DataFrame:
    """name, title, score of the entries with the keyword: 3 in the name, 2 in the title, 1 in the description."""
    has = lambda c: F.contains(F.lower(c), F.lit(keyword.lower()))
    score = F.when(has(F.col("name")), 3).when(has(F.col("title")), 2).when(has(F.col("description")), 1)
    return catalog.select("name", "title", score.alias("score")).where("score is not null").orderBy(F.desc("score"), "name").limit(most)


def current_version(versions: DataFrame, pointers: DataFrame) -> DataFrame:
    """Versions that the last pointer of each store names; pushes and rollbacks are rows of pointers (store, seq, version)."""
    last = pointers.groupBy("store").agg(F.max_by("version", "seq").alias("version"))
    return versions.join(last, ["store", "version"])


def ring(traces: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """The last `size` traces of each key."""
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))
    return traces.withColumn("nth", nth).where(F.col("nth") <= size)


def trace_analysis(traces: DataFrame, keys: list[str], order: str, size: int) -> DataFrame:
    """keys, total_runs, failure_rate, most_failed, stalled: over the ring, but most_failed over all failures (message not null)."""
    kept = ring(traces, keys, order, size)
    recent = kept.groupBy(*keys).agg(
        F.count("*").alias("total_runs"), F.avg(F.col("message").isNotNull().cast("int")).alias("failure_rate"),
        ((F.count_if((F.col("nth") <= 3) & F.col("message").isNotNull()) == 3) & (F.count_distinct(F.when(F.col("nth") <= 3, F.col("message"))) == 1)).alias("stalled"),
    )
    counts = traces.where("message is not null").groupBy(*keys, "message").agg(F.count("*").alias("n"))
    most = counts.groupBy(*keys).agg(F.max(F.struct("n", "message")).getField("message").alias("most_failed"))
    return recent.join(most, keys, "left")


def cosine(a: Column, b: Column) -> Column:
    """0 for empty, unequal or zero vectors."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def similar(queries: DataFrame, rows: DataFrame, least: float, block: int = 500) -> DataFrame:
    """a, b, similarity of pairs of a query (id, vector) and another row (id, vector) with cosine above `least`.

    Both sides are packed into blocks of some `block` vectors of length 1; each block of rows
    meets each block of queries by its number, and a pair of blocks is one matrix product.
    Vectors of other lengths than a block's first, and zero vectors, are like nothing.
    """

    def packed(df: DataFrame, name: str) -> tuple[DataFrame, int]:
        n = 1 + df.count() // block
        unit = F.transform("vector", lambda x: x.cast("double"))
        parts = df.select(F.pmod(F.xxhash64("id"), F.lit(n)).cast("int").alias(name), F.struct("id", unit.alias("vector")).alias("v"))
        return parts.groupBy(name).agg(F.collect_list("v").alias(f"{name}s")), n

    q, n_q = packed(queries, "query")
    r, _ = packed(rows, "row")
    met = r.withColumn("query", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(q, "query").select("querys", "rows")

    def compare(batches):
        for b in batches:
            for i in range(b.num_rows):
                (ids, x), (others, y) = (_units(b.column(k)[i].values) for k in (0, 1))
                s = x @ y.T if x.shape[1] == y.shape[1] else np.zeros((len(x), len(y)))
                at = np.argwhere((s > least) & (ids[:, None] != others[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[:, 0]]), pa.array(others[at[:, 1]]), pa.array(s[at[:, 0], at[:, 1]])], names=["a", "b", "similarity"])

    return met.mapInArrow(compare, "a long, b long, similarity double")


def _units(values: pa.StructArray) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and vectors scaled to length 1; those that have no direction or another length stay 0."""
    ids, vectors = values.field("id").to_numpy(zero_copy_only=False), values.field("vector").to_pylist()
    width = len(next((v for v in vectors if v), []))
    x = np.array([v if v and len(v) == width and None not in v else [0.0] * width for v in vectors], np.float64).reshape(len(vectors), width)
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return ids, np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def tool_rows(functions: DataFrame, layout: str) -> DataFrame:
    """name, tool: a function's description (name, description, parameters as JSON text) in a provider's layout."""
    q = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("v"))), r"^\{\"v\":(.*)\}$", 1)
    if layout == "nested":
        text = F.concat(F.lit('{"type":"function","function":{"name":'), q("name"), F.lit(',"description":'), q("description"), F.lit(',"parameters":'), "parameters", F.lit("}}"))
    else:
        text = F.concat(F.lit('{"name":'), q("name"), F.lit(',"description":'), q("description"), F.lit(',"input_schema":'), "parameters", F.lit("}"))
    return functions.select("name", text.alias("tool"))


def merged_fields(original: DataFrame, corrections: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """original with the failed fields (array column `failed`) taken from corrections where these have them, and what stays failed."""
    both = original.alias("o").join(corrections.alias("c"), key, "left")
    take = lambda f: F.array_contains("o.failed", f) & F.col(f"c.{f}").isNotNull()
    still = F.filter(F.array(*[F.when(F.array_contains("o.failed", f) & F.col(f"c.{f}").isNull(), F.lit(f)) for f in fields]), lambda x: x.isNotNull())
    return both.select(key, *[F.when(take(f), F.col(f"c.{f}")).otherwise(F.col(f"o.{f}")).alias(f) for f in fields], still.alias("unmerged"))
