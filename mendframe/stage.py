"""Tables between rounds: written to the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What Spark counts a file's opening as, below which it doesn't split.
SPLIT = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only where that is unset and all runs in one JVM, as in tests."""
    sc = spark.sparkContext
    place = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not place:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = tempfile.mkdtemp(prefix="mendframe-")
        sc.setCheckpointDir(place)
    return place.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet and read back, so that later rounds don't repeat earlier ones."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.cut_at = path
    return out


def drop(*frames: DataFrame) -> None:
    """Delete tables that cut() wrote and nothing reads any more."""
    for df in frames:
        where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.cut_at)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def spread(df: DataFrame) -> DataFrame:
    """A table dealt to tasks of one SPLIT each, as many as there are cores at least, before costly work on its rows: a small file is wide in rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(cores, -(-size // SPLIT)))


def sealed(df: DataFrame, *names: str) -> DataFrame:
    """df as it is, but that conditions on these columns stay above them: pushed below, they would be worked out again, written out in full."""
    kept = [c for c in df.columns if c not in names]
    return df.select(*[F.col(f"`{c}`") for c in kept], F.inline_outer(F.array(F.struct(*names)))).select(*[F.col(f"`{c}`") for c in df.columns])
