"""Line deduplication by hashes of shortest passages, in DataFrame functions only.

The fingerprints of a document are its shortest passages of enough words: for each line, the one that
starts and the one that ends there. They are held against the first document with the same passage.
Any repeated run with enough words is the union of such passages, so none is missed, and no pair of
documents is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from koinea.llm._tables import written
from koinea.llm.mixing import word_count


def _length(words: Column, least: int) -> Column:
    """How many of the first items sum up to ``least``; 0 if all do not."""
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("n"))
    step = lambda s, x: F.when(s["total"] >= least, s).otherwise(F.struct((s["total"] + x).alias("total"), (s["n"] + 1).alias("n")))
    return F.aggregate(words, start, step, lambda s: F.when(s["total"] >= least, s["n"]).otherwise(0))


def _passages(words: Column, least: int) -> Column:
    """Structs (at, n) of the shortest runs with ``least`` words that start or end at each item; each item has a word."""
    forth = F.transform(words, lambda x, i: F.struct(i.alias("at"), _length(F.slice(words, i + 1, least), least).alias("n")))
    tails = F.transform(
        words,
        lambda x, i: F.struct(
            i.alias("at"),
            _length(F.reverse(F.slice(words, F.greatest(i - least + 2, F.lit(1)), F.least(i + 1, F.lit(least)))), least).alias("n"),
        ),
    )
    back = F.transform(tails, lambda s: F.struct((s["at"] - s["n"] + 1).alias("at"), s["n"].alias("n")))
    size = F.lit(least + 1).cast("long")  # a run is one number while equal ones are dropped, which takes a hash set only for numbers
    runs = F.array_distinct(F.transform(F.filter(F.concat(forth, back), lambda s: s["n"] > 0), lambda s: s["at"] * size + s["n"]))
    return F.transform(runs, lambda r: F.struct(F.floor(r / size).cast("int").alias("at"), (r % size).cast("int").alias("n")))


def repeated_runs(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """Rows (doc_id, text_key, position, words) of the lines that dedupe_lines() deletes."""
    base = docs.where("doc_id is not null and text is not null").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.col("text")).alias("text_key"), F.split(F.col("text"), "\n", -1).alias("lines")
    )
    base = base.withColumn("lines", F.transform("lines", lambda x: F.trim(x))).select(
        "doc_id", "text_key", "lines", F.transform("lines", lambda x: word_count(x).cast("int")).alias("counts")
    )
    places = F.transform("counts", lambda x, i: i)
    base = base.select(
        "doc_id",
        "text_key",
        "counts",
        F.transform("lines", lambda x: F.xxhash64(x)).alias("hashes"),
        F.filter(places, lambda p: F.get("counts", p) > 0).alias("full"),
        F.filter("lines", lambda x, i: F.get("counts", i) > 0).alias("texts"),
        F.filter("counts", lambda x: x > 0).alias("words"),
        F.filter(places, lambda p: F.get("counts", p) == 0).alias("blank"),
    ).withColumn("passages", _passages(F.col("words"), min_words))
    prints = F.transform(
        "passages",
        lambda s: F.struct(
            F.get("full", s["at"]).alias("p"),
            F.get("full", s["at"] + s["n"] - 1).alias("e"),
            F.unhex(F.md5(F.array_join(F.slice("texts", s["at"] + 1, s["n"]), "\n"))).alias("key"),
        ),
    )
    base = base.withColumn("sorted", F.array_sort(F.transform("hashes", lambda x, i: F.struct(x.alias("h"), i.alias("p")))))
    repeats = F.filter("sorted", lambda x, k: (k > 0) & (F.get("sorted", k - 1)["h"] == x["h"]))
    within = F.transform(repeats, lambda x: x["p"])
    base = written(base.select("doc_id", "text_key", "counts", "blank", within.alias("within"), prints.alias("prints")))
    spots = base.select("doc_id", "text_key", F.explode("prints").alias("f")).select("doc_id", "text_key", "f.*")
    first = spots.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id").drop("last_id")
    later = spots.join(first, "key").where("doc_id > first_id").select("doc_id", "text_key", "p", "e")
    # each passage gives the lines that those before it in its document leave
    before = F.max("e").over(Window.partitionBy("doc_id", "text_key").orderBy("p", "e").rowsBetween(Window.unboundedPreceding, -1))
    part = later.withColumn("p", F.greatest(F.col("p"), F.coalesce(before + 1, F.lit(0)))).where("p <= e")
    matched = part.select("doc_id", "text_key", F.explode(F.sequence("p", "e")).alias("p")).groupBy("doc_id", "text_key").agg(F.collect_list("p").alias("matched"))
    met = base.drop("prints").join(matched, ["doc_id", "text_key"], "left").where("matched is not null or size(within) > 0")
    places = F.array_distinct(F.concat(F.coalesce("matched", F.array().cast("array<int>")), "within", "blank"))
    covered = (
        met.select("doc_id", "text_key", F.explode(F.transform(places, lambda p: F.struct(p.alias("position"), F.get("counts", p).alias("words")))).alias("x"))
        .select("doc_id", "text_key", "x.*")
        .distinct()
    )
    row = F.row_number().over(Window.partitionBy("doc_id", "text_key").orderBy("position"))
    runs = covered.withColumn("run", F.col("position") - row)
    total = F.sum("words").over(Window.partitionBy("doc_id", "text_key", "run"))
    return runs.withColumn("total", total).where(F.col("total") >= min_words).select("doc_id", "text_key", "position", "words")


def dedupe_lines(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """docs(doc_id, text, ...) with repeated runs of lines taken out of text; adds n_lines, n_deleted, deleted_words.

    Lines end at a newline and are compared without outer spaces. A line is repeated if it stands
    earlier in its own document, or if it lies in a passage of at least ``min_words`` words that also
    stands, line by line, in an earlier document (smaller doc_id), whichever that is. Lines without
    words are skipped when passages are compared. Neighbouring repeated lines, those without words
    between them included, form a run, which is deleted if it has at least ``min_words`` words.

    Null text stays null, with no lines; an empty text is one blank line; rows without doc_id neither
    give nor lose lines; rows that repeat a doc_id count as one document and are not matched with each
    other. Other columns stay as they are, but for those named like the three added. An empty table
    gives an empty result.
    """
    gone = repeated_runs(docs, min_words=min_words).groupBy(
        F.col("doc_id").alias("_line_id"), F.col("text_key").alias("_line_key")
    ).agg(F.collect_list("position").alias("_line_gone"), F.sum("words").alias("_line_words"))
    plain = docs.drop("n_lines", "n_deleted", "deleted_words")
    keyed = plain.withColumn("_key", F.md5(F.col("text")))
    met = keyed.join(
        gone.hint("shuffle_hash"), (F.col("doc_id").cast("long") == F.col("_line_id")) & (F.col("_key") == F.col("_line_key")), "left"
    )
    met = met.withColumn("_lines", F.split("text", "\n", -1))  # a column of its own, or each line would split the text again
    lines = F.col("_lines")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "_line_gone")
    kept = F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    return met.select(
        *[F.when(F.col("_line_gone").isNotNull(), kept).otherwise(F.col("text")).alias("text") if c == "text" else F.col(f"`{c}`") for c in plain.columns],
        F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(F.col("_line_gone").isNull(), 0).otherwise(F.size("_line_gone")).cast("long").alias("n_deleted"),
        F.coalesce("_line_words", F.lit(0)).cast("long").alias("deleted_words"),
    )
