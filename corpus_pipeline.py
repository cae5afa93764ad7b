"""A training-data pipeline over ``documents``: five stages, each one an operator.

Every stage works on all that its predecessor kept. ``run`` writes each stage's
result to the work folder and reads it back as the next one's input.

All stages take null and empty texts as texts without words, judge rows and not ids (repeated and null ids
lose no row to another's fate), give an empty result for an empty table, and, but for the last, return all
columns of their input, whatever those are called.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import common, decontaminate, exact_dedup, ngram_join, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without texts scored as toxic; the score is learned from ``labels``, and without any label nothing goes."""
    return toxicity.filter_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each text, but for white space: that of the smallest id; null and empty texts are one text."""
    return exact_dedup.dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that links of five-word shingles at 0.8 hold together; texts without words are linked with nothing."""
    return ngram_join.dedup_similar(docs, size=5, num=80, den=100)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without texts that hold a window of ``benchmark``; an empty benchmark removes nothing."""
    return decontaminate.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece and its place in a sequence; a text without tokens is its end alone."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("ngram_join", drop_near_copies), ("decontamination", drop_leaks), ("packing", pack)]

#: Toxicity scores and token ids cannot be expressed in SQL; tests hold the
#: pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``: the packed pieces. Staged tables stay until ``common.drop_staged`` is called."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = common.staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
