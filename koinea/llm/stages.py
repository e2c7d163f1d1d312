"""The stages of the corpus pipeline; each works on all that its predecessor kept.

All take (spark, docs, sf_dir) and, but for the last, return the columns of documents. Other columns of
docs are left out. Rows without doc_id or text, repeated rows and empty tables are allowed; what becomes
of them is said for each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koinea.llm import langid, linededup, minhash, mixing, sentencepieces

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted, with lang set to it.

    Null, empty and letterless texts and unsure ones go; rows without doc_id stay if their text is
    accepted. If nothing can be learned, nothing is accepted.
    """
    model = langid.train(langid.training_sample(docs, ~langid.held_out(F.col("doc_id"), 4), 700, 4000))
    return langid.labelled(docs.select(*COLUMNS), model).where("accepted").select(
        *[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in COLUMNS]
    )


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated runs of lines, with n_chars of what stays.

    Documents of which only white space is left after a deletion go. Null and empty texts and rows without
    doc_id stay as they are, their n_chars set (null for null).
    """
    deduped = linededup.dedupe_lines(docs.select(*COLUMNS))
    return deduped.where("n_deleted = 0 or trim(text) <> ''").select(*COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies: five words, similarity 0.8.

    Rows that repeat that doc_id stay together; rows without doc_id or words are nobody's copies and stay.
    """
    found = minhash.near_duplicates(docs)
    kept = found.where("kept").select(F.col("doc_id").alias("_kept")).distinct().hint("shuffle_hash")
    joined = docs.select(*COLUMNS).join(kept, F.col("doc_id") == F.col("_kept"), "left")
    return joined.where("doc_id is null or _kept is not null").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources near their target weights; see mixing.mix_plan() for odd rows."""
    return mixing.mix_sources(docs.select(*COLUMNS))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, round_trip, parity) of every document of the mix; null and empty texts have no ids."""
    return sentencepieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip", "parity")
