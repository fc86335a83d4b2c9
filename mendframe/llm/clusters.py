"""k-means over integer vectors by Hamerly's bounds: exact results, few full scans.

Vectors are cut into blocks of rows and stored once, bucketed by block. A round's state is a
second table, bucketed alike: for each vector its centroid, one upper bound of the distance to
it and one lower bound of the distance to the second nearest. A round joins the two without a
shuffle. Bounds are loosened by how far centroids have drifted; where they can't tell the
nearest centroid, the distance to a vector's own is taken anew, and where that doesn't do
either, the vector is scanned against all centroids in exact integers. Bounds are rounded
outwards, so doubles never decide a tie. Sums of clusters are kept by what moved, as integers.

Only vectors with exactly `size` components, none null or non-finite, are kept; each component
x becomes floor(1024 * x). A vector with a component of 2**26 or more in size stops the query,
as squared distances would leave 64 bits. A repeated row counts each time. A null vec_id is
clustered but never an initial centroid. Fewer than k vectors give fewer centroids; an empty
table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, shared_dir, table, unstage

#: Vectors in a block, blocks in a bucket, the factor of integers, the largest component, how far a bound is rounded outwards.
BLOCK, EACH, SCALE, MOST, SLACK = 4096, 64, 1024, 1 << 26, 1e-12


class _Bucketed:
    """A table in the shared folder, bucketed by block: joins by block need no shuffle."""

    def __init__(self, df: DataFrame, buckets: int, name: str):
        self.spark, self.name = df.sparkSession, f"mendframe_{name}_{uuid.uuid4().hex}"
        path = f"{shared_dir(self.spark)}/{self.name}"
        df.write.bucketBy(buckets, "block").sortBy("block").option("path", path).option("compression", "zstd").saveAsTable(self.name)
        self.df = self.spark.table(self.name)
        self.df.staged_at = path

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE {self.name}")
        unstage(self.df)


def _wide(row: pa.RecordBatch, name: str, dtype) -> np.ndarray:
    return np.frombuffer(row.column(name)[0].as_py(), dtype)


def integer_vectors(vectors: DataFrame, size: int) -> DataFrame:
    """vec_id and components x of kept vectors, x as doubles."""
    x = F.col("embedding")
    fine = (F.size(x) == size) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return vectors.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("long"), F.transform(x, lambda e: e.cast("double")).alias("x"))


def _floors(x: np.ndarray) -> np.ndarray:
    x = np.floor(SCALE * x)
    if x.size and np.abs(x).max() >= MOST:
        raise ValueError(f"a component of {MOST} or more: squared distances don't fit 64 bits")
    return x.astype(np.int64)


def _blocks(kept: DataFrame, size: int) -> DataFrame:
    """A row for each BLOCK vectors of a partition: block, ids (with nulls), vectors as bytes of 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made = TaskContext.get().partitionId() << 32, 0
        for b in batches:
            for lo in range(0, b.num_rows, BLOCK):
                cut = b.slice(lo, BLOCK)
                x = _floors(cut.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size))
                yield pa.RecordBatch.from_pydict({"block": pa.array([part + made], pa.int64()), "ids": pa.array([cut.column(0).to_pylist()], pa.list_(pa.int64())), "vectors": pa.array([x.astype(np.int32).tobytes()], pa.binary())})
                made += 1
        release()

    return kept.mapInArrow(run, "block long, ids array<long>, vectors binary")


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest digests of seed:vec_id; those of equal digest by their components."""
    named = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "x")
    rows = named.orderBy("h", "x").limit(k).collect()
    return _floors(np.array([r.x for r in rows], np.float64)) if rows else np.empty((0, 0), np.int64)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every row of c, exact."""
    return np.stack([((x - y) ** 2).sum(1) for y in c], 1)


def _root(squared: np.ndarray, outwards: float) -> np.ndarray:
    return np.sqrt(squared.astype(np.float64)) * (1 + outwards * SLACK)


def scanned(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nearest centroid, the smaller number on a tie; upper bound; lower bound of the second nearest)."""
    d = distances(x, c)
    at = d.argmin(1)
    upper = _root(d[np.arange(len(x)), at], 1)
    d[np.arange(len(x)), at] = np.iinfo(np.int64).max
    return at.astype(np.int32), upper, _root(d.min(1), -1) if len(c) > 1 else np.full(len(x), np.inf)


def rebounded(x: np.ndarray, c: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The next assignment and bounds, and how many vectors were scanned in full. drift: an upper bound of how far each centroid went."""
    order = np.argsort(drift)
    others = np.full(len(c), drift[order[-1]])
    others[order[-1]] = drift[order[-2]] if len(c) > 1 else 0
    upper = (upper + drift[at]) * (1 + SLACK)
    lower = np.maximum(lower - others[at], 0) * (1 - SLACK)
    between = distances(c, c)
    between[np.arange(len(c)), np.arange(len(c))] = np.iinfo(np.int64).max
    half = _root(between.min(1), -1) / 2 if len(c) > 1 else np.full(len(c), np.inf)
    bound = np.maximum(lower, half[at])
    unsure = np.flatnonzero(upper >= bound)
    if len(unsure):
        upper[unsure] = _root(((x[unsure] - c[at[unsure]]) ** 2).sum(1), 1)
        unsure = unsure[upper[unsure] >= bound[unsure]]
    if len(unsure):
        at = at.copy()
        at[unsure], upper[unsure], lower[unsure] = scanned(x[unsure], c)
    return at, upper, lower, len(unsure)


_STATE = "block long, nearest binary, upper binary, lower binary, moved array<long>, scanned long"


def _round(blocks: DataFrame, state: DataFrame | None, c: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The state after a round: bounds, and what sums and counts of clusters gain by the block, as one array."""
    k, size = c.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                x = _wide(row, "vectors", np.int32).reshape(-1, size).astype(np.int64)
                gain = np.zeros((k, size + 1), np.int64)
                ones = np.concatenate([x, np.ones((len(x), 1), np.int64)], 1)
                if drift is None:
                    at, upper, lower = scanned(x, c)
                    many, changed = len(x), np.arange(len(x))
                else:
                    was = _wide(row, "nearest", np.int32)
                    at, upper, lower, many = rebounded(x, c, was, _wide(row, "upper", np.float64), _wide(row, "lower", np.float64), drift)
                    changed = np.flatnonzero(at != was)
                    np.subtract.at(gain, was[changed], ones[changed])
                np.add.at(gain, at[changed], ones[changed])
                yield pa.RecordBatch.from_pydict(
                    {"block": row.column("block"), "nearest": pa.array([at.tobytes()], pa.binary()), "upper": pa.array([upper.tobytes()], pa.binary()), "lower": pa.array([lower.tobytes()], pa.binary()),
                     "moved": pa.array([gain.ravel().tolist()], pa.list_(pa.int64())), "scanned": pa.array([many], pa.int64())})
        release()

    if state is None:
        return blocks.select("block", "vectors").mapInArrow(run, _STATE)
    return blocks.select("block", "vectors").join(state.select("block", "nearest", "upper", "lower").hint("merge"), "block").mapInArrow(run, _STATE)


def _gained(state: DataFrame, width: int) -> np.ndarray:
    """Sums of `moved` over all blocks: added within each partition, then by place; as many numbers as a block has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, np.int64)
        for b in batches:
            total += b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, width).sum(0)
        yield pa.RecordBatch.from_pydict({"at": pa.array(np.arange(width, dtype=np.int32)), "v": pa.array(total)})

    out = np.zeros(width, np.int64)
    for r in state.select("moved").mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[r["at"]] = r["v"]
    return out


def clustered(vectors: DataFrame, k: int = 8, rounds: int = 10, size: int = 64, seed: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    kept = integer_vectors(vectors, size)
    c = first_centroids(kept, k, seed)
    if not len(c):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    made = _blocks(kept, size)
    # As many buckets as blocks need: a count of kept rows is enough to tell.
    buckets = max(spark.sparkContext.defaultParallelism, -(-kept.count() // (BLOCK * EACH)))
    blocks = _Bucketed(made.repartition(buckets, "block"), buckets, "vectors")
    state, drift = None, None
    sums = np.zeros((len(c), size + 1), object)
    for n in range(rounds + 1):
        new = _Bucketed(_round(blocks.df, state and state.df, c, drift), buckets, "bounds")
        if state:
            state.drop()
        state = new
        if n == rounds:
            break
        sums = sums + _gained(state.df, sums.size).reshape(sums.shape).astype(object)
        moved = np.array([[int(v) // int(s[-1]) for v in s[:-1]] if s[-1] else old.tolist() for s, old in zip(sums, c, strict=True)], np.int64)
        drift, c = _root(((moved - c) ** 2).sum(1), 1), moved
    final = c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1)
                x, at = _wide(row, "vectors", np.int32).reshape(-1, size).astype(np.int64), _wide(row, "nearest", np.int32)
                yield pa.RecordBatch.from_pydict({"vec_id": row.column("ids").flatten(), "cluster": pa.array(at), "distance": pa.array(((x - final[at]) ** 2).sum(1))})

    rows = blocks.df.select("block", "ids", "vectors").join(state.df.select("block", "nearest").hint("merge"), "block").drop("block").mapInArrow(run, "vec_id long, cluster int, distance long")
    digests = [hashlib.sha256(",".join(map(str, y.tolist())).encode()).hexdigest() for y in c]
    names = spark.createDataFrame(list(enumerate(digests)), "cluster int, centroid_sha256 string")
    by_cluster = rows.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))  # k rows
    total = by_cluster.agg(F.sum("cluster_inertia").alias("inertia")).first()["inertia"]
    known = F.broadcast(by_cluster.join(F.broadcast(names), "cluster").withColumn("inertia", F.lit(total).cast("long")))
    return rows.join(known, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_hamerly_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in 8 clusters after 10 rounds."""
    return clustered(table(spark, sf_dir, "embeddings"))


QUERIES = {"op11_hamerly_clusters": op11_hamerly_clusters}
ORACLES: dict[str, str] = {}
