"""Writers: Parquet tables, delimited exports, parallel training text, and compact score tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koinea.operators.alignment import pair_lines


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet; maps and arrays stay as they are."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = "\t") -> None:
    """A delimited export with a header; nested columns become JSON, string arrays pipe-joined."""
    flat = [
        F.concat_ws("|", F.col(c)).alias(c) if t == "array<string>" else F.to_json(F.col(c)).alias(c) if t.startswith(("map", "array", "struct")) else F.col(c)
        for c, t in df.dtypes
    ]
    df.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).csv(path)


def write_training_pairs(df: DataFrame, path: str, key: str, pivot: str, others: Sequence[str]) -> DataFrame:
    """`pivot ||| other` lines as Parquet with their pair ids, in place of files linked by line order; returns what was written."""
    lines = pair_lines(df, key, pivot, others).withColumn("pair_id", F.xxhash64(key, "variety"))
    lines.write.mode("overwrite").parquet(path)
    return lines


def compact_scores(scores: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns that the table has."""
    return scores.select(*[c for c in wanted if c in scores.columns])
