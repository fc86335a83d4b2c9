"""Corpus pipeline: toxicity, line deduplication, near-duplicate documents, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mendframe.llm import line_dedup, mixing, ngram_join, packing, toxicity
from mendframe.llm.common import staged, table


def accept(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier doesn't reject."""
    return toxicity.accepted_documents(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less their repeated lines."""
    return line_dedup.deduplicated_documents(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the least doc_id's."""
    return ngram_join.distinct_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", accept), ("line_dedup", dedup_lines), ("ngram_jaccard", dedup_documents), ("source_mix", mix_sources), ("packing", pack)]

#: Learned scores, edit distances and searches aren't SQL; tests hold the operators of the stages against brute force, and what each stage keeps against its rules.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
