"""A corpus pipeline of five stages over documents; each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from koinea.llm import stages
from koinea.llm._tables import written

STAGES = [
    ("language ID", stages.language),
    ("line dedup", stages.lines),
    ("MinHash near-dedup", stages.near_copies),
    ("mixing sources to target weights", stages.mixture),
    ("SentencePiece encoding and decoding", stages.tokens),
]

#: Language identification and tokenising are not SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
