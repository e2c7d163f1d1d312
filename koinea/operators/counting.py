"""Counts, conditional probabilities, sum-products and counter maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_domain(source: Column, target: Column, sources: Sequence | None, targets: Sequence | None) -> Column:
    """Both lists given: both must match; one given: that one; none: every row."""
    keep = F.lit(True)
    if sources is not None:
        keep = keep & source.isin(list(sources))
    if targets is not None:
        keep = keep & target.isin(list(targets))
    return keep


def contingency(df: DataFrame, group: str, a: str, b: str, *, sources: Sequence | None = None, targets: Sequence | None = None, places: int | None = 4) -> DataFrame:
    """P(a|b) and P(b|a) within group, from pair counts; rows with a null are left out.

    The pair counts combine before their shuffle; the margins are window sums over these counts.
    """
    rows = df.dropna(subset=[group, a, b]).where(in_domain(F.col(a), F.col(b), sources, targets))
    n = rows.groupBy(group, a, b).agg(F.count("*").alias("n"))
    p_a = F.col("n") / F.sum("n").over(Window.partitionBy(group, b))
    p_b = F.col("n") / F.sum("n").over(Window.partitionBy(group, a))
    if places is not None:
        p_a, p_b = F.round(p_a, places), F.round(p_b, places)
    return n.select(group, a, b, "n", p_a.alias("p_a_given_b"), p_b.alias("p_b_given_a"))


def sum_product(left: DataFrame, right: DataFrame, on: Sequence[str], keep: Sequence[str], p: str, q: str) -> DataFrame:
    """Sparse matrix product: sum of p * q over the shared keys that are not kept."""
    return left.join(right, list(on)).groupBy(*keep).agg(F.sum(F.col(p) * F.col(q)).alias("p"))


def normalized(df: DataFrame, group: Sequence[str], p: str) -> DataFrame:
    """p as a distribution within group; uniform where the mass is 0, so zero-mass members stay."""
    window = Window.partitionBy(*group)
    total = F.sum(p).over(window)
    return df.withColumn(p, F.when(total == 0, 1.0 / F.count("*").over(window)).otherwise(F.col(p) / F.nullif(total, F.lit(0.0))))


def counter(df: DataFrame, group: Sequence[str], term: str, order: str) -> DataFrame:
    """Counts of a term by group, with its first position; the long form of a counter map."""
    return df.where(F.col(term).isNotNull()).groupBy(*group, term).agg(F.count("*").alias("n"), F.min(order).alias("first_pos"))


def counter_maps(counted: DataFrame, group: Sequence[str], term: str) -> DataFrame:
    """The counter as one map<string,bigint> for each group."""
    return counted.groupBy(*group).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.col(term), F.col("n"))))).alias("counts"))


def top_term(counted: DataFrame, group: Sequence[str], term: str) -> DataFrame:
    """The most frequent term; of equal ones the first seen, then the smallest."""
    best = F.max_by(F.struct(term, "n"), F.struct(F.col("n"), -F.col("first_pos")))
    return counted.groupBy(*group).agg(best.alias("best")).select(*group, f"best.{term}", "best.n")


def last_write(df: DataFrame, group: Sequence[str], value: str, order: str) -> DataFrame:
    """The value with the largest order in each group."""
    return df.groupBy(*group).agg(F.max_by(value, order).alias(value))


def evidence(df: DataFrame, group: Sequence[str], set_of: str, conditions: dict[str, Column]) -> DataFrame:
    """The distinct values of a column and conditional counts by group."""
    return df.groupBy(*group).agg(
        F.concat_ws("|", F.array_sort(F.collect_set(set_of))).alias("members"), *[F.sum(F.when(c, 1).otherwise(0)).alias(n) for n, c in conditions.items()]
    )
