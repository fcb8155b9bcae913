"""A training-corpus pipeline of the operators in ``strata.llm``.

Each stage takes what the one before kept and returns the columns of ``documents``; the last
returns the packed pieces.  ``ORACLE_SQL`` is None: fingerprints (XXH64), structural decoding
and tokenization cannot be stated in SQL, so ``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strata.llm import packing, quality, secrets, simhash, substring
from strata.sources.shared import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others lose the boilerplate lines of their host, lines of every
    length that are in more than five of its documents, however many it has."""
    ship(spark)
    return quality.cleaned(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: texts whose 5-word shingles resemble each other by
    0.8 (Jaccard) or more, or whose fingerprints of those differ in four bits or fewer."""
    ship(spark)
    return simhash.deduplicated(docs, jaccard=0.8, shingle=5)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages that occur elsewhere too go."""
    ship(spark)
    return substring.dedup(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark."""
    ship(spark)
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every id of every document that is left, in sequences of 2048."""
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("secret scan", secret_scan),
    ("packing", pack_sequences),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strata.llm import scratch

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
