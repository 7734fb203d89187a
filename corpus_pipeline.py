"""A corpus for training, from ``documents``: known language, no repeated lines, no near-duplicates, no benchmark
passages, mixed to source weights.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes it as Parquet to the shared
folder (``spark.checkpoint.dir``) and reads it again as the next stage's documents, so a lost executor never costs
more than the stage at work.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabscope.llm import decontaminate, langid, line_dedup, mixing, simhash
from tabscope.llm.shared import shared_dir, written


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be determined; the model learns from the rows that aren't held out."""
    return langid.known_language(docs, langid.fit(docs.where(~langid.held_out())))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten or more characters stay in the document with the smallest id only."""
    return line_dedup.dedup_lines(docs)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (3-word shingles, 2 bits) the document with the smallest id."""
    return simhash.one_per_group(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item (five-word shingles, 0.8)."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: the documents that the mix takes, whole, with size, source_size, target, epochs and taken (words, repeats counted)."""
    own = ("doc_id", "source", "size", "source_size", "target", "epochs", "taken")
    return mixing.mix(docs, keep=tuple(c for c in docs.columns if c.lower() not in own)).where("taken > 0")


STAGES = [
    ("language_id", known_language),
    ("line_dedup", without_repeated_lines),
    ("simhash_near_dedup", without_near_duplicates),
    ("benchmark_decontamination", without_benchmark),
    ("source_mixing", mixed_sources),
]

#: SQL has neither the language model nor XXH64, so the tests compare run() with a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{name}")
    return docs
