"""From score tables to training rows: scores by corpus, slot filters, marked sentences, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from koinea.functions.text import is_word, mark_first, tokens
from koinea.operators.sampling import draw, exact_cut, stratified_split


def flatten_scores(df: DataFrame, scores: Sequence[str], corpus: int, core: Sequence[str] = ()) -> DataFrame:
    """Score maps as numbers: for corpus 6 the score of 6 in the core dialects' rows, else that of each row's own corpus.

    A score column that is no map stays as it is; a map without the key gives null.
    """
    kinds = dict(df.dtypes)
    kept = df.where(F.col("dialect").isin(list(core))) if corpus == 6 else df
    at = F.lit(6) if corpus == 6 else F.col("corpus").cast("int")
    return kept.withColumns({c: F.element_at(c, at) for c in scores if kinds[c].startswith("map")})


def unpack_scores(df: DataFrame, scores: Sequence[str], corpora: Sequence[int] = (6, 26)) -> DataFrame:
    """Each score map as a column for each corpus, <score>_c<corpus>; null where the map lacks it."""
    return df.select(*[c for c in df.columns if c not in scores], *[F.element_at(s, F.lit(c)).alias(f"{s}_c{c}") for s in scores for c in corpora])


def empty_slots(slots: Sequence[str]) -> Column:
    """How many of the count maps are empty or null."""
    none = F.lit(0)
    for c in slots:
        none = none + F.when(F.coalesce(F.size(c), F.lit(0)) < 1, 1).otherwise(0)
    return none


def slot_filter(df: DataFrame, slots: Sequence[str], limits: dict[int, int]) -> DataFrame:
    """Word rows with at most as many empty slots as their corpus allows; a corpus without a limit goes."""
    most = F.lit(None).cast("int")
    for corpus, limit in limits.items():
        most = F.when(F.col("corpus") == corpus, limit).otherwise(most)
    return df.where(is_word(F.col("word")) & (empty_slots(slots) <= most))


def marked_sentences(rows: DataFrame, sentences: DataFrame, *, seed: int = 42, most: int = 2) -> DataFrame:
    """One to ``most`` sentences with a word of each row marked: (row_id, dialect, sent_id, word, marked).

    rows: (row_id, dialect, words), words in order of preference; sentences: (sent_id, dialect, sentence).
    A row takes the first of its words that is a token of a sentence of its dialect or that has a space.
    The latter needs a sentence that has one of its parts as a token and contains it whole; if there is none
    the row gives nothing. A sentence that several parts lead to counts once for each, as in a draw with
    copies. How many sentences a row takes and which follow seeded draws. Ids join first and texts only for
    the checks and the rows taken; before any shuffle a partition keeps ``most`` candidates of a row.
    Nulls match nothing; row_id and (sent_id, dialect) must be unique.
    """
    spaced = F.transform("words", lambda w: F.contains(w, F.lit(" ")))
    until = F.coalesce(F.nullif(F.array_position(spaced, F.lit(True)), F.lit(0)), F.size("words"))
    wanted = rows.select("row_id", "dialect", F.posexplode(F.slice("words", F.lit(1), until)).alias("pos", "word")).where("word is not null")
    posts = sentences.select("sent_id", "dialect", F.explode(F.array_distinct(tokens(F.col("sentence")))).alias("tok"))
    texts = sentences.select("sent_id", "dialect", "sentence")
    single = wanted.where(~F.contains("word", F.lit(" "))).withColumn("tok", F.col("word"))
    exact = single.join(posts, ["dialect", "tok"]).select("row_id", "dialect", "pos", "word", "sent_id")
    parts = wanted.where(F.contains("word", F.lit(" "))).withColumn("tok", F.explode(tokens(F.col("word"))))
    near = parts.join(posts, ["dialect", "tok"]).groupBy("row_id", "dialect", "pos", "word", "sent_id").agg(F.count("*").alias("copies"))
    whole = near.join(texts, ["sent_id", "dialect"]).where(F.contains("sentence", "word"))
    hits = exact.withColumn("copy", F.lit(0)).unionByName(
        whole.select("row_id", "dialect", "pos", "word", "sent_id", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    )
    mine = Window.partitionBy("row_id")
    size = F.lit(1) + (F.conv(F.substring(draw(seed, "row_id"), 1, 8), 16, 10).cast("long") % most)
    first = hits.withColumn("_r", F.row_number().over(mine.orderBy("pos", draw(seed, "row_id", "sent_id", "copy"), "sent_id"))).where(F.col("_r") <= most)
    taken = first.withColumn("_pos", F.min("pos").over(mine)).where((F.col("pos") == F.col("_pos")) & (F.col("_r") <= size))
    return taken.join(texts, ["sent_id", "dialect"]).select("row_id", "dialect", "sent_id", "word", mark_first(F.col("sentence"), F.col("word")).alias("marked"))


def sentence_rows(df: DataFrame, sentences: DataFrame, target: str, *, seed: int = 42, test_size: float = 0.1) -> DataFrame:
    """Training rows (sentence, score, dialect, split) from df(row_id, dialect, words, target); the split is by dialect."""
    marked = marked_sentences(df.select("row_id", "dialect", "words"), sentences, seed=seed)
    scored = marked.join(df.select("row_id", F.col(target).alias("score")), "row_id").withColumn("_key", F.concat_ws("|", "row_id", "sent_id"))
    return stratified_split(scored, "dialect", "_key", seed=seed, share=1 - test_size).select(F.col("marked").alias("sentence"), "score", "dialect", "split")


def word_rows(df: DataFrame, target: str, *, seed: int = 42, test_size: float = 0.1) -> DataFrame:
    """Word-only training rows (word, generality, split): mean target by word, and an exact cut of the shuffled words."""
    means = df.where("word is not null").groupBy("word").agg(F.avg(target).alias("generality"))
    return exact_cut(means, "word", seed=seed, share=1 - test_size)
