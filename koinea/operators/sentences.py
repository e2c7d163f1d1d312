"""Word and sentence scores: lexicon lookups, scorers that can be exchanged, and sentence means."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koinea.functions.scoring import generalized_harmonic_mean
from koinea.functions.text import mark_first, normalize_text, spoken_form, tokens

#: From rows with word and marked to the same rows with score; a scorer may join, or call a model on batches.
Scorer = Callable[[DataFrame], DataFrame]


def best_scores(entries: DataFrame) -> DataFrame:
    """(phrase, score): a phrase's best score, at least 0; null and empty phrases are left out."""
    return entries.where("phrase <> ''").groupBy("phrase").agg(F.greatest(F.max("score"), F.lit(0.0)).alias("score"))


def lookup(words: DataFrame, word: str, lexicon: DataFrame, normal: Callable[[Column], Column] = normalize_text, default: float = -1.0) -> DataFrame:
    """words with score: that of the word as it stands, else of its normal form, else the default.

    Each distinct word is looked up once, both ways; a null word has the default.
    """
    entry = lexicon.select(F.col("phrase").alias("_p"), F.col("score").alias("_s"))
    distinct = words.select(F.col(word).alias("_w")).distinct().withColumn("_n", normal(F.col("_w")))
    exact = distinct.join(entry, F.col("_w") == F.col("_p"), "left").select("_w", "_n", F.col("_s").alias("_exact"))
    both = exact.join(entry, F.col("_n") == F.col("_p"), "left").select("_w", F.coalesce("_exact", "_s", F.lit(default)).alias("score"))
    return words.join(both, F.col(word) == F.col("_w"), "left").drop("_w").withColumn("score", F.coalesce("score", F.lit(default)))


def lexicon_means(rows: DataFrame, key: str, words: str, lexicon: DataFrame, normal: Callable[[Column], Column] = normalize_text, default: float = -1.0) -> DataFrame:
    """(key, score): the mean lookup of an array of words; the default for none. Keys must be unique."""
    looked = lookup(rows.select(key, F.explode(words).alias("_word")), "_word", lexicon, normal, default)
    means = looked.groupBy(key).agg(F.avg("score").alias("score"))
    return rows.select(key).join(means, key, "left").withColumn("score", F.coalesce("score", F.lit(default)))


def table_scorer(lexicon: DataFrame, normal: Callable[[Column], Column] = normalize_text, default: float = -1.0) -> Scorer:
    """A scorer that looks words up; the default stands for a model's answer to unknown words."""
    return lambda rows: lookup(rows, "word", lexicon, normal, default)


def batch_scorer(predict: Callable[[pd.Series], pd.Series]) -> Scorer:
    """A scorer from a function of marked sentences, called on Arrow batches; for models."""
    call = F.pandas_udf(predict, "double")
    return lambda rows: rows.withColumn("score", call("marked"))


def score_sentences(rows: DataFrame, key: str, sentence: str, scorer: Scorer, *, k: int = 2, p: float = 2.0, floor: float = 1e-6, most: int | None = None, whole: bool = False) -> DataFrame:
    """Sentence scores from word scores: (key, n_words, words, scores, lowest, mean).

    The sentence is normalised without folding letters and each of its words is marked at its first
    place and scored; with whole, the sentence is scored once as its own word. lowest is the harmonic mean
    of the k lowest scores, none under floor; mean is the generalised harmonic mean with exponent p over
    all. most keeps the first words only, as a model with a limit needs. Sentences without words give no
    row. Keys must be unique.
    """
    plain = rows.select(key, spoken_form(F.col(sentence), fold=False).alias("_sentence"))
    words = F.array(F.col("_sentence")) if whole else tokens(F.col("_sentence"))
    if most is not None:
        words = F.slice(words, 1, most)
    spread = plain.where("_sentence <> ''").select(key, "_sentence", F.posexplode(words).alias("_pos", "word"))
    asked = spread.select(key, "_pos", "word", mark_first(F.col("_sentence"), F.col("word")).alias("marked"))
    scored = scorer(asked).select(key, "_pos", "word", F.col("score").cast("double").alias("_score"))
    gathered = scored.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("_pos", "word", "_score"))).alias("_all"),
        F.slice(F.sort_array(F.collect_list("_score")), 1, k).alias("_low"),
        generalized_harmonic_mean(F.col("_score"), p).alias("mean"),
    )
    inverse = F.aggregate("_low", F.lit(0.0), lambda a, x: a + 1.0 / F.greatest(x, F.lit(floor)))
    return gathered.select(key, F.size("_all").cast("long").alias("n_words"), F.col("_all.word").alias("words"), F.col("_all._score").alias("scores"), (F.size("_low") / inverse).alias("lowest"), "mean")
