"""Connected components of an undirected graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from koinea.llm._tables import written


def components(links: DataFrame) -> DataFrame:
    """Rows (id, component) for every id of links(a, b); the component is its smallest id.

    Alternates large-star and small-star steps until the links no longer change. Every step takes
    minima by key, which combine before the shuffle, so a hub with a third of all links is no
    bottleneck. Self-links, repeated links and null ends are allowed; null ends count for nothing.
    An empty table gives an empty result.
    """
    links = links.where("a is not null and b is not null")
    lone = links.where("a = b").select(F.col("a").alias("id"), F.col("a").alias("component"))
    edges = written(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _state(edges)
    while mark[0]:
        edges = _small_star(_large_star(edges))
        edges = written(edges)
        now = _state(edges)
        if now == mark:
            break
        mark = now
    found = edges.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component"))
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return found.unionByName(roots).unionByName(lone).groupBy("id").agg(F.min("component").alias("component"))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where("b > a").join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of these."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
