"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node that an edge (src, dst) of long ids touches; component is its least node.

    Each step is a min-aggregation and a join, so a node of many edges is combined map-side
    and split by skew handling; a step's edges are staged in the shared folder. Steps end when
    the edges are stars: every node points once, at a node that points nowhere.
    """
    now = staged(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    while not _stars(now):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        new = staged(small.select("e.u", "e.v").where("u <> v").distinct(), "edges")
        unstage(now)
        now = new
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _stars(edges: DataFrame) -> bool:
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in")), F.struct(F.col("v").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("in")))).alias("e")).select("e.*")
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return nodes.where("out > 1 or (out = 1 and in = 1)").isEmpty()
