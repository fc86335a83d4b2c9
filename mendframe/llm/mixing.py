"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

A source's target is its weighted share of all words, capped at `most` times its own size,
with the excess shared again by weight (water filling, solved in closed form over sorted
caps). Whole epochs come first: every document as often as the target holds the source. What
remains is filled in ascending order of -ln(u) / quality, the sampling keys of weighted
sampling without replacement, along running word counts; the document that crosses the
budget gives its first words only, so a source meets its target to the word.

u comes from a digest of the document's id and a seed, so reruns agree. Running counts are
never taken over a whole source: keys fall into ranges, ranges are summed, and only the one
range that crosses the budget is sorted.

Nulls: a null text has size 0 and quality 1; null sources are one source, the last; null
doc_ids are drawn like an id "null". Repeated rows are taken each for itself, in a fixed order
among themselves. Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, staged, table

RANGES = 1024


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: str = "text") -> Column:
    """From 1 (no ASCII punctuation or digit in the text) down to 0.05."""
    clean = F.length(F.regexp_replace(F.col(text), r"[!-@\[-`{-~]", ""))
    return F.coalesce(F.greatest(F.lit(0.05), clean / F.nullif(F.length(text), F.lit(0))), F.lit(1.0))


def sampling_unit(doc_id: str = "doc_id", seed: str = "mix") -> Column:
    """A number in (0, 1) from 48 bits of a digest."""
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: list[float], most: float, total: float | None = None) -> DataFrame:
    """source, source_size, target from one row (source, source_size) a source.

    The rows of sources are few against documents: they are sorted in one task.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(ordered) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = s.withColumns({
        "total": F.sum("source_size").over(everything) if total is None else F.lit(float(total)),
        "caps_before": F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "w_from": F.sum("w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)),
    })
    s = s.withColumn("capped", F.col("cap") * F.col("w_from") <= (F.col("total") - F.col("caps_before")) * F.col("w"))
    free = F.sum(F.when(~F.col("capped"), F.col("w"))).over(everything)
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), F.lit(0.0))
    return s.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(left * F.col("w") / free).cast("double").alias("target"))


def _few(plan: DataFrame, most: int = 100_000) -> DataFrame:
    """Broadcast a table of sources only where it is counted to be small; else the join shuffles."""
    return F.broadcast(plan) if plan.count() <= most else plan


def mix(docs: DataFrame, weights: list[float], most: float = 3) -> DataFrame:
    """docs (doc_id, source, size, weight and more) with source_size, target, epochs, extra and taken.

    docs is read twice and must be the same both times.
    """
    key = -F.log(sampling_unit()) / F.col("weight")
    # The range is a rising function of the key; the document itself lies somewhere in it.
    d = docs.withColumn("_key", key).withColumn("_range", F.floor((1 - F.exp(-F.col("_key"))) * RANGES).cast("int"))
    ranges = staged(d.groupBy("source", F.col("_range").alias("range")).agg(F.sum("size").alias("words")), "ranges")
    sizes = ranges.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, most)
    epochs = F.least(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(int(most)))
    targets = targets.withColumn("epochs", F.coalesce(epochs, F.lit(0)).cast("long"))
    targets = targets.withColumn("budget", F.floor(F.col("target")).cast("long") - F.col("epochs") * F.col("source_size"))

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = ranges.withColumn("before", before)
    plan = sums.join(targets, same(sums, targets)).drop(targets["source"])
    # For each source: ranges below `cross` are in, those above are out.
    crossing = (F.col("before") <= F.col("budget")) & (F.col("before") + F.col("words") > F.col("budget"))
    plan = plan.groupBy("source", "source_size", "target", "epochs", "budget").agg(F.max(F.when(crossing, F.struct("range", "before"))).alias("x"))
    plan = plan.select(F.col("source").alias("_source"), "source_size", "target", "epochs", F.coalesce("x.range", F.lit(RANGES + 1)).alias("_cross"), (F.col("budget") - F.coalesce("x.before", F.lit(0))).alias("_rest"))

    e = d.join(_few(staged(plan, "plan")), F.col("source").eqNullSafe(F.col("_source")))
    outside = e.where("_range <> _cross").withColumn("extra", F.when(F.col("_range") < F.col("_cross"), F.col("size")).otherwise(F.lit(0)).cast("long"))
    inside = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    room = F.col("_rest") - F.coalesce(F.sum("size").over(inside), F.lit(0))
    at = e.where("_range = _cross").withColumn("extra", F.greatest(F.lit(0), F.least(F.col("size"), room)).cast("long"))
    out = outside.unionByName(at).withColumn("taken", (F.col("epochs") * F.col("size") + F.col("extra")).cast("long"))
    return out.drop("_key", "_range", "_source", "_cross", "_rest")


WEIGHTS = [5.0, 2.0, 1.0]


def mixed_documents(docs: DataFrame) -> DataFrame:
    """docs as the mix has them: a row for each time that a document is taken.

    The document that crosses its source's budget comes once more with its first words only
    (and n_chars to match); what the mix doesn't take, or has no words, goes.
    """
    packed = docs.select("doc_id", "source", n_words().alias("size"), quality().alias("weight"), F.struct("*").alias("doc"))
    taken = mix(packed, WEIGHTS).where("taken > 0")
    cut = (F.col("extra") > 0) & (F.col("extra") < F.col("size"))
    times = F.col("epochs") + (F.col("extra") > 0).cast("long")
    copies = taken.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).withColumn("cut", cut & (F.col("copy") > F.col("epochs")))
    runs = F.regexp_extract_all(F.col("doc.text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    head = F.array_join(F.slice(runs, 1, F.col("extra").cast("int")), "")
    text = F.when(F.col("cut"), head).otherwise(F.col("doc.text"))
    made = {"text": text, "n_chars": F.when(F.col("cut"), F.length(head)).otherwise(F.col("doc.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return copies.select(*[made[c].cast(docs.schema[c].dataType).alias(c) if c in made else F.col(f"doc.`{c}`").alias(c) for c in docs.columns])


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a mix of all documents at weights 5, 2, 1 takes of each."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", n_words().alias("size"), quality().alias("weight"))
    return mix(staged(docs, "sizes"), WEIGHTS).select("doc_id", "size", "source_size", "target", "taken", "source", "epochs", "extra")


#: The closed form of the targets and running sums over whole sources, as plain SQL.
_SQL = """
WITH d AS (
  SELECT doc_id, source,
    CASE WHEN text IS NULL THEN 0 ELSE length(regexp_replace(regexp_replace(text, '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) END AS size,
    CASE WHEN text IS NULL OR text = '' THEN 1.0 ELSE greatest(0.05, length(regexp_replace(text, '[!-@\\[-`{-~]', '', 'g'))::DOUBLE / length(text)) END AS weight,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT + 0.5) / 281474976710656.0 AS u
  FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, 3 * source_size AS cap FROM s),
c AS (SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
    sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_from FROM w),
f AS (SELECT *, cap * w_from <= (total - caps_before) * w AS capped FROM c),
t AS (SELECT source, source_size,
    CASE WHEN capped THEN cap ELSE (total - coalesce(sum(cap) FILTER (WHERE capped) OVER (), 0)) * w / (sum(w) FILTER (WHERE NOT capped) OVER ()) END AS target FROM f),
e AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END AS epochs FROM t),
r AS (SELECT d.doc_id, d.size, e.source_size, e.target, e.epochs, d.source, floor(e.target) - e.epochs * e.source_size
      - coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY -ln(d.u) / d.weight, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room
      FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size::BIGINT AS source_size, target,
  (epochs * size + greatest(0, least(size, room)))::BIGINT AS taken, source, epochs::BIGINT AS epochs, greatest(0, least(size, room))::BIGINT AS extra
FROM r
"""

QUERIES = {"op1_source_mix": op1_source_mix}
ORACLES = {"op1_source_mix": _SQL}
