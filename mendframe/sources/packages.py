"""Schema packages and their versions in files: read by Spark's own readers, so that any file system serves, a task a part.

read_packages() takes a folder or files of JSON texts, a package a file; what can't be read is a
row of its own. Versions are an append-only table by day: bodies, and pointers that say from
when on which version is the current one. Nothing is rewritten, so a rollback is one more
pointer, and any time in the past can be asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.packages import loaded

VERSIONS = "store string, version int, at timestamp, source string, body string"
POINTERS = "store string, at timestamp, version int"


def read_packages(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """file, text and what it holds: package, schema, relations, rules, counterexamples, bad (the text, where it isn't JSON)."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))
    return loaded(files, "text").withColumn("bad", F.when(F.col("schema").isNull(), F.col("text")))


def write_packages(packages: DataFrame, name: str, text: str, path: str) -> None:
    """Append a package's text to the folder of its name (name=..), a file each; a folder that is written again holds both."""
    packages.select(F.col(name).alias("name"), F.col(text).alias("value")).write.mode("append").partitionBy("name").option("maxRecordsPerFile", 1).text(path)


def append_versions(versions: DataFrame, path: str) -> None:
    """Add rows (VERSIONS) to the table of bodies."""
    versions.select("store", "version", "at", "source", "body").withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(f"{path}/versions")


def append_pointers(pointers: DataFrame, path: str) -> None:
    pointers.select("store", "at", "version").withColumn("day", F.to_date("at")).write.mode("append").partitionBy("day").parquet(f"{path}/pointers")


def read_versions(spark: SparkSession, path: str, until: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(versions, pointers), as they were at a time if one is given: later days aren't read."""
    out = []
    for name, kind in (("versions", VERSIONS), ("pointers", POINTERS)):
        df = spark.read.schema(f"{kind}, day date").parquet(f"{path}/{name}")
        if until:
            df = df.where((F.col("day") <= F.lit(until).cast("date")) & (F.col("at") <= F.lit(until).cast("timestamp")))
        out.append(df.drop("day"))
    return out[0], out[1]
