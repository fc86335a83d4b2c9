"""Consistency of cross-field rules: bounds carried along relations to a fixpoint, cycles, sums, examples.

Fields are rows (schema_id, path, lo, hi; null: none), relations rows (schema_id, a, op, b).
A round carries on only the bounds that the round before has changed: one join each way on
schema and field and one aggregation; rounds end when nothing changes, so a chain may have any
length. Within a ring of relations bounds are carried without their gaps, else a strict ring
would raise them for ever; strict rings are conflicts of their own. All work is by schema and
field, so many schemas are as many keys; a schema's part is bounded by its own fields and rules.

Relations with a null side, with an operator that isn't known or with a field that has no
bounds say nothing. Repeated relations count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..stage import cut, drop


def ordered_pairs(relations: DataFrame) -> DataFrame:
    """schema_id, low, high, gap of relations (schema_id, a, op, b): low + gap <= high. Strict relations leave a gap of 1; eq goes both ways; unknown operators say nothing."""
    le = lambda low, high, gap: F.struct(F.col(low).alias("low"), F.col(high).alias("high"), F.lit(float(gap)).alias("gap"))
    pairs = (
        F.when(F.col("op").isin("lt", "<"), F.array(le("a", "b", 1))).when(F.col("op").isin("lte", "<="), F.array(le("a", "b", 0)))
        .when(F.col("op").isin("gt", ">"), F.array(le("b", "a", 1))).when(F.col("op").isin("gte", ">="), F.array(le("b", "a", 0)))
        .when(F.col("op").isin("eq", "==") & ~_is_sum(F.col("b")), F.array(le("a", "b", 0), le("b", "a", 0)))
    )
    return relations.where("a is not null and b is not null").select("schema_id", F.explode(pairs).alias("p")).select("schema_id", "p.*").groupBy("schema_id", "low", "high").agg(F.max("gap").alias("gap"))


def _is_sum(c: Column) -> Column:
    return c.contains("+") | c.contains("-")


def _core(pairs: DataFrame) -> DataFrame:
    """The pairs whose ends both have pairs before and behind them: all rings, and what lies between rings."""
    now = cut(pairs, "core")
    n = now.count()
    while n:
        behind = now.select("schema_id", F.col("high").alias("low")).distinct()
        before = now.select("schema_id", F.col("low").alias("high")).distinct()
        less = cut(now.join(behind, ["schema_id", "low"], "left_semi").join(before, ["schema_id", "high"], "left_semi"), "core")
        drop(now)
        now, was, n = less, n, less.count()
        if n == was:
            break
    return now


def reachable(pairs: DataFrame) -> DataFrame:
    """schema_id, low, high, gap (1 if some way between them is strict): which fields come before which, by doubling ways."""
    now = cut(pairs.select("schema_id", "low", "high", F.least("gap", F.lit(1.0)).alias("gap")), "ways")
    while True:
        a, b = now.alias("a"), now.alias("b")
        longer = a.join(b, (F.col("a.schema_id") == F.col("b.schema_id")) & (F.col("a.high") == F.col("b.low"))).select("a.schema_id", "a.low", "b.high", F.greatest("a.gap", "b.gap").alias("gap"))
        more = cut(now.unionByName(longer).groupBy("schema_id", "low", "high").agg(F.max("gap").alias("gap")), "ways")
        same = more.agg(F.count("*"), F.sum("gap")).first() == now.agg(F.count("*"), F.sum("gap")).first()
        drop(now)
        now = more
        if same:
            return now


def propagated(bounds: DataFrame, pairs: DataFrame) -> DataFrame:
    """bounds after all that pairs imply."""
    none = F.lit(None).cast("double")
    now = cut(bounds.groupBy("schema_id", "path").agg(F.max("lo").alias("lo"), F.min("hi").alias("hi")).withColumn("changed", F.lit(True)), "bounds")
    while not (moved := now.where("changed")).isEmpty():
        up = pairs.join(moved.where("lo is not null").withColumnRenamed("path", "low"), ["schema_id", "low"]).select("schema_id", F.col("high").alias("path"), (F.col("lo") + F.col("gap")).alias("lo"), none.alias("hi"))
        down = pairs.join(moved.where("hi is not null").withColumnRenamed("path", "high"), ["schema_id", "high"]).select("schema_id", F.col("low").alias("path"), none.alias("lo"), (F.col("hi") - F.col("gap")).alias("hi"))
        old = now.select("schema_id", "path", "lo", "hi", F.col("lo").alias("was_lo"), F.col("hi").alias("was_hi"))
        new = up.unionByName(down).withColumns({"was_lo": none, "was_hi": none})
        all_ = old.unionByName(new).groupBy("schema_id", "path").agg(*[f(c).alias(c) for f, c in ((F.max, "lo"), (F.min, "hi"), (F.max, "was_lo"), (F.min, "was_hi"))])
        still = F.col("lo").eqNullSafe(F.col("was_lo")) & F.col("hi").eqNullSafe(F.col("was_hi"))
        more = cut(all_.select("schema_id", "path", "lo", "hi", (~still).alias("changed")), "bounds")
        drop(now)
        now = more
    return now.drop("changed")


def solved(bounds: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bounds at the fixpoint; schema_id and path of fields on strict rings)."""
    pairs = cut(ordered_pairs(relations), "pairs")
    core = _core(pairs)
    ways = reachable(core)
    rings = ways.select("schema_id", F.col("low").alias("high"), F.col("high").alias("low"), F.lit(True).alias("ring"))  # a pair is on a ring if its high end comes before its low one
    level = pairs.join(rings, ["schema_id", "low", "high"], "left").select("schema_id", "low", "high", F.when(F.col("ring"), 0.0).otherwise(F.col("gap")).alias("gap"))
    return propagated(bounds, level), ways.where("low = high and gap > 0").select("schema_id", F.col("low").alias("path"))


def consistency(bounds: DataFrame, relations: DataFrame) -> DataFrame:
    """schema_id, path, lo, hi, consistent, witness: whether a value is left for each field, and the middle one."""
    out = solved(bounds, relations)[0]
    ok = F.coalesce(F.col("lo") <= F.col("hi"), F.lit(True))
    middle = F.when(F.col("lo").isNotNull() & F.col("hi").isNotNull(), (F.col("lo") + F.col("hi")) / 2).otherwise(F.coalesce("lo", "hi"))
    return out.withColumns({"consistent": ok, "witness": F.when(ok, middle)})


def _shown(c: Column) -> Column:
    """A double without exponent and without a fraction of zeros."""
    whole = (c == F.rint(c)) & (F.abs(c) < 9e18)
    plain = F.regexp_replace(F.regexp_replace(c.try_cast("decimal(38,12)").cast("string"), "0+$", ""), r"\.$", "")
    return F.when(whole, c.try_cast("long").cast("string")).otherwise(F.when((F.abs(c) >= 1e-3) & (F.abs(c) < 1e7), c.cast("string")).otherwise(F.coalesce(plain, c.cast("string"))))


def sums(relations: DataFrame) -> DataFrame:
    """schema_id, a, b, field, sign of relations eq with a sum or difference on the right; a sign holds for the next field."""
    words = F.filter(F.split("b", r"\s+"), lambda w: w != "")
    signed = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("field"), F.when((i > 0) & (F.get(words, i - 1) == "-"), -1.0).otherwise(1.0).alias("sign"))), lambda x: ~x["field"].isin("+", "-"))
    return relations.where((F.col("op") == "eq") & F.col("a").isNotNull() & _is_sum(F.col("b"))).select("schema_id", "a", "b").distinct().select("schema_id", "a", "b", F.explode(signed).alias("t")).select("schema_id", "a", "b", "t.*")


def conflicts(bounds: DataFrame, relations: DataFrame) -> DataFrame:
    """schema_id, rule_a, rule_b, reason: fields without a value left, strict rings, sums that can't meet their bounds. All from one fixpoint."""
    held, rings = solved(bounds, relations)
    return _conflicts(held, rings, relations)


def _conflicts(held: DataFrame, rings: DataFrame, relations: DataFrame) -> DataFrame:
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    row = lambda a, b, why: ["schema_id", a.alias("rule_a"), b.alias("rule_b"), why.alias("reason")]
    f, lo, hi = F.col("path"), _shown(F.col("lo")), _shown(F.col("hi"))
    ranges = held.where("lo > hi").select(*row(text(f, ".min = ", lo), text(f, ".max = ", hi), text("range conflict: ", f, " requires min(", lo, ") <= max(", hi, ")")))
    cycles = rings.select(*row(text(f, " < ... < ", f), F.lit(""), text("cycle conflict: strict ordering cycle through ", f)))
    inf = F.lit(float("inf"))
    parts = sums(relations).join(held.select("schema_id", F.col("path").alias("field"), "lo", "hi", F.lit(True).alias("known")), ["schema_id", "field"], "left")
    plus = F.col("sign") > 0
    least = F.when(plus, F.coalesce("lo", -inf)).otherwise(F.coalesce(-F.col("hi"), -inf))
    most = F.when(plus, F.coalesce("hi", inf)).otherwise(F.coalesce(-F.col("lo"), inf))
    both = parts.groupBy("schema_id", "a", "b").agg(F.sum(least).alias("least"), F.sum(most).alias("most"), F.count_if(F.col("known").isNull()).alias("unknown")).where("unknown = 0")
    met = both.join(held.withColumnRenamed("path", "a"), ["schema_id", "a"])
    a, b = F.col("a"), F.col("b")
    rule = text(a, " = ", b)
    low = met.where("least > hi").select(*row(rule, text(a, ".max = ", hi), text("arithmetic infeasibility: ", b, " minimum possible value (", _shown(F.col("least")), ") > ", a, ".max (", hi, ")")))
    high = met.where("most < lo").select(*row(rule, text(a, ".min = ", lo), text("arithmetic infeasibility: ", b, " maximum possible value (", _shown(F.col("most")), ") < ", a, ".min (", lo, ")")))
    return ranges.unionByName(cycles).unionByName(low).unionByName(high)


def examples(bounds: DataFrame, relations: DataFrame, types: DataFrame) -> DataFrame:
    """schema_id, example: JSON of a record whose fields lie within their bounds, for schemas without a conflict. types: schema_id, path, type; its fields are shown, by name."""
    held, rings = solved(bounds, relations)
    bad = _conflicts(held, rings, relations).select("schema_id").distinct()
    lo, hi = F.col("lo"), F.col("hi")
    v = F.when(lo.isNotNull() & hi.isNotNull(), (lo + hi) / 2).when(lo.isNotNull(), lo + 1).when(hi.isNotNull(), hi - 1).otherwise(0.0)
    shown = F.when(F.col("type") == "integer", v.cast("long").cast("string")).otherwise(F.when(v == F.rint(v), F.concat(_shown(v), F.lit(".0"))).otherwise(_shown(v)))
    key = F.regexp_extract(F.to_json(F.struct(F.col("path").alias("k"))), r"(?s)^\{\"k\":(.*)\}$", 1)
    fields = types.join(held, ["schema_id", "path"], "left").join(bad, "schema_id", "left_anti").select("schema_id", F.struct("path", F.concat(key, F.lit(":"), shown).alias("text")).alias("x"))
    whole = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["text"])  # as many as a schema has fields
    return fields.groupBy("schema_id").agg(F.concat(F.lit("{"), F.array_join(whole, ","), F.lit("}")).alias("example"))
