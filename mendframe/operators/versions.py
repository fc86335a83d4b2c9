"""Versions of schemas as of a time: pushes, rollbacks, differences and the changelog, as joins.

versions: (store, version, at, body), pointers: (store, at, version); the last pointer at or
before a time names the current version, of several at one time the one of the highest
version. A store's own history is short, whatever the number of requests for it: pointers
become intervals, and requests meet them by an equality on the store, which skew handling can
split. Null stores and times have no version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .schemas import diff, flat_properties


def intervals(pointers: DataFrame) -> DataFrame:
    """store, version, since, until (null: still): when each version was the current one."""
    one = pointers.where("store is not null and at is not null").groupBy("store", "at").agg(F.max("version").alias("version"))
    by_time = Window.partitionBy("store").orderBy("at")  # a store's pushes and rollbacks
    return one.select("store", "version", F.col("at").alias("since"), F.lead("at").over(by_time).alias("until"))


def as_of(requests: DataFrame, pointers: DataFrame) -> DataFrame:
    """requests (store, at, ...) with the version that was current then; null before the first."""
    packed = requests.select(F.col("store").alias("_store"), F.col("at").alias("_at"), F.struct("*").alias("_row"))
    when = intervals(pointers)
    held = (F.col("_store") == F.col("store")) & (F.col("_at") >= F.col("since")) & (F.col("until").isNull() | (F.col("_at") < F.col("until")))
    return packed.join(when, held, "left").select("_row.*", F.col("version").alias("current_version"))


def _known(pairs: DataFrame, versions: DataFrame, column: str) -> tuple[Column, DataFrame]:
    """An error where `column` names no version of its store, and pairs with the number of versions."""
    n = versions.groupBy("store").agg(F.max("version").alias("_n"))
    out = pairs.join(n, "store", "left").withColumn("_n", F.coalesce("_n", F.lit(0)))
    v = F.col(column)
    return F.when(v.isNull() | (v < 1) | (v > F.col("_n")), F.concat(F.lit("version "), F.coalesce(v.cast("string"), F.lit("null")), F.lit(" out of range (1..="), F.col("_n").cast("string"), F.lit(")"))), out


def rolled_back(requests: DataFrame, versions: DataFrame) -> DataFrame:
    """store, at, version, error of requests (store, at, version): those without error are pointers to append."""
    error, out = _known(requests, versions, "version")
    return out.select("store", "at", "version", error.alias("error"))


def version_diff(pairs: DataFrame, versions: DataFrame) -> DataFrame:
    """store, from, to, path, change, field, old, new of pairs (store, from, to) that exist; of others one row with error."""
    error, out = _known(pairs, versions, "from")
    out = out.withColumn("_e", F.when(error.isNotNull(), F.concat(F.lit("from "), error))).drop("_n")
    error, out = _known(out, versions, "to")
    out = out.select("store", "from", "to", F.coalesce("_e", F.when(error.isNotNull(), F.concat(F.lit("to "), error))).alias("error"))
    body = versions.select("store", F.col("version").alias("v"), "body")
    good = out.where("error is null").drop("error").distinct()

    def props(side: str) -> DataFrame:
        own = good.withColumn("v", F.col(side)).join(body, ["store", "v"])
        key = F.to_json(F.struct("store", "from", "to"))
        return flat_properties(own.select(key.alias("schema_id"), "body"))

    rows = diff(props("from"), props("to"), ["schema_id"]).withColumn("k", F.from_json("schema_id", "store string, `from` int, `to` int"))
    found = rows.select("k.store", "k.from", "k.to", "path", "change", "field", "old", "new", F.lit(None).cast("string").alias("error"))
    none = F.lit(None).cast("string")
    return found.unionByName(out.where("error is not null").select("store", F.col("from").cast("int"), F.col("to").cast("int"), *[none.alias(c) for c in ("path", "change", "field", "old", "new")], "error"))


def changelog(versions: DataFrame) -> DataFrame:
    """version_diff of each version and the one before it."""
    return version_diff(versions.where("version > 1").select("store", (F.col("version") - 1).alias("from"), F.col("version").alias("to")), versions)
