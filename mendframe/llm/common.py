"""Helpers shared by the corpus operators: staging, Arrow loops, word sets, ordered prefix sums."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: ASCII white space, the word separators of every contract here.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session of one JVM (tests) gets a temporary one where it is unset."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="mendframe-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def staged(df: DataFrame, name: str, at_once: int | None = None) -> DataFrame:
    """Cut lineage: write df as Parquet in the shared folder and read it back; at_once: the rows that writer and reader hold at most, for rows of megabytes."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if at_once:
        writer = writer.option("parquet.block.row.count.limit", at_once)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def unstage(df: DataFrame) -> None:
    """Delete a table that staged() wrote and that no later result reads."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df.staged_at)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release() -> None:
    """Give memory that a task has freed back to the system: the worker process outlives the task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def map_arrow(df: DataFrame, rows: Callable[..., dict], schema: str, *, setup: Callable | None = None, finish: Callable | None = None, limit: int = 1_000_000) -> DataFrame:
    """Apply rows(state, *columns) -> columns to slices of each Arrow batch.

    A slice holds at most about `limit` bytes of the last column (one row at least), so that
    the working set of a task doesn't depend on how long the texts of a batch are. finish(state)
    may give last rows of each partition.
    """
    target = df.sparkSession.createDataFrame([], schema).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, state = to_arrow_schema(target), setup() if setup else None

        def batch_of(out: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

        for batch in batches:
            for lo, hi in slices(batch.column(batch.num_columns - 1), limit):
                yield batch_of(rows(state, *(c.to_pylist() for c in batch.slice(lo, hi - lo).columns)))
        if finish:
            yield batch_of(finish(state))
        state = None
        release()

    return df.mapInArrow(run, target)


def slices(column: pa.Array, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes or list items of the column each."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        sizes = pc.binary_length(column)
    elif pa.types.is_list(kind) or pa.types.is_large_list(kind):
        sizes = pc.list_value_length(column)
    else:
        sizes = pa.array([1] * len(column))
    lo, held = 0, 0
    for i, n in enumerate(pc.fill_null(sizes, 0).to_pylist()):
        if held and held + n > limit:
            yield lo, i
            lo, held = i, 0
        held += n
    if lo < len(column):
        yield lo, len(column)


#: Bits of a bitmap of values.
BITMAP = 1 << 24


def cells(df: DataFrame, name: str) -> np.ndarray:
    """A bitmap of fixed size with the cells of a column of longs set."""
    cell = F.pmod(F.col(name), F.lit(BITMAP))
    words = df.groupBy(F.shiftright(cell, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod({name}, {BITMAP}) & 63 as int))")).alias("bits")).toArrow()
    bitmap = np.zeros(BITMAP >> 6, np.uint64)
    bitmap[words["w"].to_numpy().astype(np.int64)] = words["bits"].to_numpy().view(np.uint64)
    return bitmap


def among(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value's cell is set: of those that were counted always, of few others."""
    at = values % BITMAP
    return bitmap[at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1) == 1


def ascii_words(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z only) words between ASCII white space."""
    return (text or "").encode().lower().split()


_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    from pandas.util import hash_array

    if not words:
        return np.empty(0, dtype=np.uint64)
    values = np.empty(len(words), dtype=object)
    values[:] = words
    return hash_array(values, categorize=len(words) > 64)


def shingle_sets(texts: Iterable[str | None], size: int = 5) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of `size` consecutive words.

    A text of fewer words counts as one shingle of all of them; no words, no shingle.
    """
    words = [ascii_words(t) for t in texts]
    flat = word_hashes([w for ws in words for w in ws])
    out, at = [], 0
    for ws in words:
        h, at = flat[at : at + len(ws)], at + len(ws)
        k = min(size, len(h))
        if not k:
            out.append(h)
            continue
        rolled = np.full(len(h) - k + 1, k, dtype=np.uint64)
        for i in range(k):
            rolled = mix(rolled ^ (h[i : len(h) - k + 1 + i] * _MUL[i]))
        out.append(np.unique(rolled))
    return out


def prefix_sums(df: DataFrame, order: Sequence[str], values: dict[str, str], name: str = "prefix-sums") -> DataFrame:
    """df with exclusive running sums of columns of longs over a global order (nulls first), by new name.

    Rows are range-partitioned and sorted; each partition sums its own, and the partitions'
    totals (one row each) give each its start. Staged, so that a partition keeps its rows.
    """
    schema = StructType([*df.schema.fields, *[StructField(k, LongType()) for k in values], StructField("_part", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, part = to_arrow_schema(schema), TaskContext.get().partitionId()
        sums = dict.fromkeys(values, 0)
        for b in batches:
            columns = b.columns
            for k, v in values.items():
                x = b.column(b.schema.get_field_index(v)).to_numpy(zero_copy_only=False).astype(np.int64)
                ends = sums[k] + np.cumsum(x)
                columns.append(pa.array(ends - x))
                sums[k] = int(ends[-1]) if len(x) else sums[k]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.full(b.num_rows, part, np.int32))], schema=arrow)

    sorted_ = df.repartitionByRange(*[F.col(c).asc_nulls_first() for c in order]).sortWithinPartitions(*[F.col(c).asc_nulls_first() for c in order])
    parts = staged(sorted_.mapInArrow(run, schema), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = parts.groupBy("_part").agg(*[F.max(F.col(k) + F.col(v)).alias(f"_{k}") for k, v in values.items()])
    starts = totals.select(F.col("_part").alias("_its"), *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_{k}") for k in values])
    out = parts.join(F.broadcast(starts), F.col("_part") == F.col("_its"))
    return out.withColumns({k: F.col(k) + F.col(f"_{k}") for k in values}).select(*df.columns, *values)
