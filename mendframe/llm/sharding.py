"""Sharding by a weighted hash tree: a row descends from region to rack to shard by weighted draws of its key.

At each node every child draws -ln(u) / weight, where u is a hash of the child's name and the
key; the least draw wins. A node weighs what its shards weigh together, so a shard gets rows
in proportion to its weight. A draw depends on its own node's name and weight only: where one
subtree's weight grows, rows move into it or stay, and where it shrinks, they leave it or stay;
no row moves between two other subtrees. A shard that is added stands in a region of its own
(grown()), so it takes rows into itself only, and no row moves between the shards there were.
The law is `key`: the key and the tree decide, whatever the rows, their number or their texts;
equal texts of different keys may go apart.

A null key is a key as any other. Null and empty texts count no bytes. Repeated rows go to the
same shard, each to a slot of its own. Other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prefix_sums, staged, table

#: Bytes that a row takes besides its text.
ROW = 16


@dataclass(frozen=True)
class Node:
    """A region, rack or shard (which has a number and no children)."""

    name: str
    children: tuple[Node, ...] = ()
    shard: int | None = None
    own: float = 1.0
    weight: float = field(init=False)

    def __post_init__(self):
        object.__setattr__(self, "weight", sum(c.weight for c in self.children) if self.children else self.own)

    def shards(self) -> list[Node]:
        return [s for c in self.children for s in c.shards()] if self.children else [self]


def tree(regions: int = 4, racks: int = 2, shards: int = 5, weights: dict[int, float] | None = None) -> Node:
    """A regular tree; shards are numbered from 0 in order and weigh 1, or what weights says by number."""
    leaf = lambda i: Node(f"shard{i}", shard=i, own=(weights or {}).get(i, 1.0))
    rack = lambda r, k: Node(f"rack{r}.{k}", tuple(leaf((r * racks + k) * shards + s) for s in range(shards)))
    return Node("root", tuple(Node(f"region{r}", tuple(rack(r, k) for k in range(racks))) for r in range(regions)))


def grown(root: Node, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region of its own."""
    i = 1 + max(s.shard for s in root.shards())
    return Node(root.name, (*root.children, Node(f"region+{i}", (Node(f"rack+{i}", (Node(f"shard{i}", shard=i, own=weight),)),))))


def _draw(key: Column, child: Column) -> Column:
    cut = F.conv(F.substring(F.md5(F.concat(child["name"], F.lit(":"), key)), 1, 12), 16, 10).cast("double")
    return -F.log((cut + 0.5) / float(1 << 48)) / child["weight"]


def placed(df: DataFrame, key: str, root: Node, name: str) -> DataFrame:
    """df with the shard (int) of its key column: one Column that holds the tree as a table of children, so nothing is shuffled."""
    nodes, depth = [root], 0
    level = [root]
    while any(n.children for n in level):
        level = [c for n in level for c in n.children]
        nodes += level
        depth += 1
    number = {n.name: i for i, n in enumerate(nodes)}
    child = lambda n: F.struct(F.lit(n.name).alias("name"), F.lit(float(n.weight)).alias("weight"), F.lit(number[n.name]).alias("node"))
    below = F.array(*[F.array(*[child(c) for c in n.children or (n,)]) for n in nodes])  # a shard stays where it is
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    # The least draw wins, the earlier child on a tie.
    step = lambda at, _: F.array_min(F.transform(F.get(below, at), lambda c: F.struct(_draw(text, c).alias("draw"), c["node"].alias("node"))))["node"]
    at = F.aggregate(F.sequence(F.lit(1), F.lit(depth)), F.lit(0), step)
    return df.withColumn(name, F.get(F.array(*[F.lit(n.shard).cast("int") for n in nodes]), at))


def shard_documents(docs: DataFrame, root: Node, later: Node | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and the shard by a later tree.

    A slot is a row's place in its shard, by doc_id (nulls first), checksum and size. Places
    come from one range shuffle of these small rows and sums by partition; no shard is ever
    one task's. Equal rows are told apart by where they were read, so that they spread too.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), (F.octet_length(text) + ROW).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = placed(placed(rows, "doc_id", root, "shard"), "doc_id", later or grown(root), "grown_shard")
    rows = staged(rows.withColumns({"_row": F.monotonically_increasing_id(), "_one": F.lit(1).cast("long")}), "placed")
    out = prefix_sums(rows, ["shard", "doc_id", "text_crc32", "size", "_row"], {"_place": "_one"}, "slots")
    starts = out.groupBy("shard").agg(F.min("_place").alias("_start"))  # a row a shard
    out = out.join(F.broadcast(starts), "shard")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_place") - F.col("_start")).alias("slot"), "grown_shard")


def op13_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of four regions of two racks, and where they go with one shard more."""
    return shard_documents(table(spark, sf_dir, "documents"), tree())


def _sql_shard(node: Node) -> str:
    """The descent as SQL over a column k."""
    if not node.children:
        return str(node.shard)
    if len(node.children) == 1:
        return _sql_shard(node.children[0])
    draws = ", ".join(f"-ln((('0x' || substr(md5('{c.name}:' || k), 1, 12))::BIGINT + 0.5) / 281474976710656.0) / {c.weight}" for c in node.children)
    cases = " ".join(f"WHEN {i + 1} THEN {_sql_shard(c)}" for i, c in enumerate(node.children))
    return f"CASE list_position([{draws}], list_min([{draws}])) {cases} END"


_SQL = f"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS k, octet_length(encode(coalesce(text, '')))::BIGINT + {ROW} AS size,
  xor(list_reduce([4294967295::BIGINT] || list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) AS text_crc32
  FROM documents, t),
s AS (SELECT *, {_sql_shard(tree())} AS shard, {_sql_shard(grown(tree()))} AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard::INT AS shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1)::BIGINT AS slot, grown_shard::INT AS grown_shard FROM s
"""

QUERIES = {"op13_hash_tree": op13_hash_tree}
ORACLES = {"op13_hash_tree": _SQL}
