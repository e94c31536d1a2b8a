"""From raw documents to packed training sequences: quality rules, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and reads nothing but docs, the rows its predecessor kept. All but the last return the
columns of docs. Null ids and texts, repeated rows and extra columns are handled as the operators say; an empty table
passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hemaspark.llm import mixing, packing, quality, secrets, simhash
from hemaspark.llm.common import written


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose posterior quality is too low, or that fail the base rule, go."""
    return quality.keep_good(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays:
    SimHash classes, verified on whole sets of shingles and completed."""
    return simhash.keep_one(docs, shingle=5, similarity=0.8)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets and linked parts of credentials are replaced by their kind."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat, or go, as their sources' target weights ask."""
    return mixing.mixed(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of tokens with their sequence and offset."""
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("quality_rules", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("source_mix", mixing_stage),
    ("packing", packing_stage),
]

#: Expectation-maximisation, XXH64 shingles and tokenizers aren't SQL: tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; what a stage keeps is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
