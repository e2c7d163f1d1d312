"""How widely a word is shared across groups: distances to every group, then soft-gated scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from koinea.functions.scoring import freq_softmax, gate, gated_mean

THRESHOLDS = (0.3, 0.4, 0.5)


def aligned_words(rows: DataFrame, group: str, words: str, other_group: str, other_words: str) -> DataFrame:
    """Counts of aligned words of parallel sentences, both ways: (word, grp, tgt_grp, tgt_word, freq).

    Words at the same place of the two lists are aligned; this is local to a row. Counts combine before
    their shuffle, and no word is compared with others than those it is aligned with.
    """
    pairs = F.explode(F.arrays_zip(F.col(words).alias("a"), F.col(other_words).alias("b")))
    zipped = rows.select(F.col(group).alias("g"), F.col(other_group).alias("h"), pairs.alias("p")).where("p.a is not null and p.b is not null and g is not null and h is not null and g <> h")
    there = zipped.select(F.col("p.a").alias("word"), F.col("g").alias("grp"), F.col("h").alias("tgt_grp"), F.col("p.b").alias("tgt_word"))
    back = zipped.select(F.col("p.b").alias("word"), F.col("h").alias("grp"), F.col("g").alias("tgt_grp"), F.col("p.a").alias("tgt_word"))
    return there.unionByName(back).groupBy("word", "grp", "tgt_grp", "tgt_word").agg(F.count("*").alias("freq"))


def distances(aligned: DataFrame) -> DataFrame:
    """Aligned words with distance, the edit distance as a share of the longer word."""
    share = F.levenshtein("word", "tgt_word") / F.greatest(F.char_length("word"), F.char_length("tgt_word"))
    return aligned.withColumn("distance", share)


def group_distances(pairs: DataFrame, temperature: float = 5.0) -> DataFrame:
    """Nearest and frequency-softmax distance of a word to each other group."""
    key = ["word", "grp", "tgt_grp"]
    lowest = pairs.withColumn("_low", F.min("distance").over(Window.partitionBy(*key)))
    return lowest.groupBy(*key).agg(F.min("distance").alias("d_min"), freq_softmax(F.col("distance"), F.col("freq"), F.col("_low"), temperature).alias("d_soft"))


def scores(distances: DataFrame, groups: int, *, thresholds: Sequence[float] = THRESHOLDS, k: float = 20.0) -> DataFrame:
    """All gated scores of a word in one aggregate; its own group counts as distance 0, absent groups as 1."""
    own = distances.select("word", "grp").distinct().select("word", "grp", F.col("grp").alias("tgt_grp"), F.lit(0.0).alias("d_min"), F.lit(0.0).alias("d_soft"))
    named = [
        gated_mean(F.col(c), t, k, groups).alias(f"{label}_t_{str(t).replace('.', '_')}_k_{int(k)}")
        for label, c in (("min", "d_min"), ("softmax", "d_soft"))
        for t in thresholds
    ]
    return distances.unionByName(own).groupBy("word", "grp").agg(*named)


def score_table(distances: DataFrame, core: Sequence[str], others: Sequence[str], *, thresholds: Sequence[float] = THRESHOLDS, k: float = 20.0) -> DataFrame:
    """The wide score table: (word, grp, corpus, {min,softmax}_t_<t>_k_<k>_{c6,c26}).

    c6 is the mean gate over the core groups; c26 over all groups, null for a word with no group beyond the
    core (corpus 6). A word's own group has distance 0, a group without aligned words 1.
    """
    groups = [*core, *others]
    own = distances.select("word", "grp").distinct().select("word", "grp", F.col("grp").alias("tgt_grp"), F.lit(0.0).alias("d_min"), F.lit(0.0).alias("d_soft"))
    both = distances.unionByName(own).where(F.col("tgt_grp").isin(groups))
    in_core = F.col("tgt_grp").isin(list(core))
    corpus = F.when(F.max(F.when(in_core, 0).otherwise(1)) == 1, 26).otherwise(6)

    def mean(column: str, t: float, members: Column, n: int) -> Column:
        value = F.when(members, gate(F.col(column), t, k))
        return (F.coalesce(F.sum(value), F.lit(0.0)) + (F.lit(n) - F.count(value)) * gate(F.lit(1.0), t, k)) / F.lit(float(n))

    columns = []
    for label, c in (("min", "d_min"), ("softmax", "d_soft")):
        for t in thresholds:
            name = f"{label}_t_{str(t).replace('.', '_')}_k_{int(k)}"
            columns += [mean(c, t, in_core, len(core)).alias(f"{name}_c6"), F.when(corpus == 26, mean(c, t, F.lit(True), len(groups))).alias(f"{name}_c26")]
    return both.groupBy("word", "grp").agg(corpus.alias("corpus"), *columns)
