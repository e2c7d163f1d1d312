"""Word alignments: position tables, the ordered segment merge, and phrases."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from koinea.functions.text import normalize_text, parse_pairs, positions_to_words, tokens


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value evaluated once for a row, also where use needs it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def one_to_many(pairs: Column) -> Column:
    """array<struct<src,tgt>> as map<int,array<int>> from each source to its sorted distinct targets, cut from the sorted pairs where the source changes."""

    def cut(c: Column) -> Column:
        until = lambda k: F.coalesce(F.get(c["starts"], k + 1), F.size(c["o"]))
        targets = F.transform(c["starts"], lambda at, k: F.transform(F.slice(c["o"], at + 1, until(k) - at), lambda x: x["tgt"]))
        return F.map_from_arrays(F.transform(c["starts"], lambda at: F.get(c["o"], at)["src"]), targets)

    def starts(o: Column) -> Column:
        fresh = lambda i: (i == 0) | ~F.get(o, i)["src"].eqNullSafe(F.get(o, i - 1)["src"])
        return F.struct(o.alias("o"), F.filter(F.transform(o, lambda _, i: i), fresh).alias("starts"))

    ordered = F.array_sort(F.transform(pairs, lambda x: F.struct(x["src"].cast("int").alias("src"), x["tgt"].cast("int").alias("tgt"))))
    once = lambda o: F.filter(o, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(o, i - 1)))  # noqa: E731  array_distinct compares all structs with all
    return bound(bound(bound(ordered, once), starts), cut)


def alignment_table(df: DataFrame, key: Sequence[str], sentence: str, pairs: str) -> DataFrame:
    """A row for each word position of sentence with the sorted target positions aligned to it; row-local."""
    none = F.array().cast("array<int>")
    at = F.struct(tokens(F.col(sentence)).alias("words"), one_to_many(F.col(pairs)).alias("m"))
    rows = bound(at, lambda c: F.transform(c["words"], lambda w, i: F.struct(i.alias("idx"), w.alias("word"), F.coalesce(F.element_at(c["m"], i), none).alias("targets"))))
    return df.select(*key, F.explode(rows).alias("r")).select(*key, "r.idx", "r.word", "r.targets")


def segment_fold(steps: Column, columns: Sequence[str]) -> Column:
    """Merges neighbouring positions into segments; steps: array<struct<idx:int, <column>:array<int> ...>> in order.

    A position joins the segment before it if, for any column, its non-empty set equals the set that the
    segment has gathered so far; all columns' sets are then united. This follows the running union, which
    no lag window sees. Gives array<struct<idx:array<int>, <column>:array<int> ...>>.
    """

    kind = "struct<starts:array<int>,seen:int," + ",".join(f"{c}:array<int>" for c in columns) + ">"

    def tidy(x: Column) -> Column:
        return F.array_sort(F.array_distinct(x)).cast("array<int>")

    def step(acc: Column, x: Column) -> Column:
        same = F.lit(False)
        for c in columns:
            same = same | ((F.size(x[c]) > 0) & F.coalesce(tidy(x[c]) == acc[c], F.lit(False)))

        def moved(joins: Column) -> Column:
            starts = F.when(joins, acc["starts"]).otherwise(F.concat(acc["starts"], F.array(acc["seen"])))
            sets = [F.when(joins, tidy(F.concat(acc[c], x[c]))).otherwise(tidy(x[c])).alias(c) for c in columns]
            return F.struct(starts.alias("starts"), (acc["seen"] + 1).alias("seen"), *sets).cast(kind)

        return bound((acc["seen"] > 0) & same, moved)

    def cut(c: Column) -> Column:
        """Segments from where they start; only the open segment's sets travel along the walk."""

        def segment(at: Column, k: Column) -> Column:
            until = F.coalesce(F.get(c["starts"], k + 1), F.size(c["steps"]))
            sets = lambda piece: [tidy(F.flatten(F.transform(piece, lambda x: x[v]))).alias(v) for v in columns]
            return bound(F.slice(c["steps"], at + 1, until - at), lambda piece: F.struct(F.transform(piece, lambda x: x["idx"].cast("int")).alias("idx"), *sets(piece)))

        return F.transform(c["starts"], segment)

    none = F.array().cast("array<int>")
    start = F.struct(none.alias("starts"), F.lit(0).alias("seen"), *[none.alias(c) for c in columns]).cast(kind)
    walked = lambda s: F.struct(s.alias("steps"), F.aggregate(s, start, step)["starts"].alias("starts"))
    return bound(bound(steps, walked), cut)


def phrases(df: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """One row for each non-null phrase column, as (key, variety, phrase)."""
    entries = F.array(*[F.struct(F.lit(c).alias("variety"), F.col(c).alias("phrase")) for c in columns])
    return df.select(*key, F.explode(F.filter(entries, lambda x: x["phrase"].isNotNull())).alias("e")).select(*key, "e.variety", "e.phrase")


def pair_lines(df: DataFrame, key: str, pivot: str, others: Sequence[str]) -> DataFrame:
    """Training lines `pivot ||| other` with their row key and variety; null or blank sides are left out."""
    long = phrases(df.where(F.trim(pivot) != ""), [key, pivot], others).where(F.trim("phrase") != "")
    return long.select(key, "variety", F.concat_ws(" ||| ", F.trim(pivot), F.trim("phrase")).alias("line"))


def positional_zip(left: DataFrame, right: DataFrame, order_left: str, order_right: str, group: str) -> DataFrame:
    """Rows of two tables with the same rank within group; the ranks come from explicit order columns."""
    a = left.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order_left)))
    b = right.withColumn("pos", F.row_number().over(Window.partitionBy(group).orderBy(order_right)))
    return a.join(b, [group, "pos"])


def blank_blocks(df: DataFrame, group: str, order: str, *lines: str) -> DataFrame:
    """Numbers the blocks between rows whose lines are all blank, and drops those rows; empty blocks get no number."""
    blank = F.lit(True)
    for c in lines:
        blank = blank & (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    window = Window.partitionBy(group).orderBy(order)
    marked = df.withColumn("_blank", blank)
    starts = (~F.col("_blank") & F.coalesce(F.lag("_blank").over(window), F.lit(True))).cast("long")
    numbered = marked.withColumn("_start", starts).withColumn("block", F.sum("_start").over(window) - 1)
    return numbered.where(~F.col("_blank")).drop("_blank", "_start")


def parsed(df: DataFrame, line: str) -> DataFrame:
    """df with the pairs of an `i-j` line."""
    return df.withColumn("pairs", parse_pairs(F.col(line)))


def phrase_rows(df: DataFrame, key: Sequence[str], base: str, varieties: Sequence[str], pairs: str = "pairs") -> DataFrame:
    """Aligned phrases of parallel sentences: (key, segment, word, dialect, <base>, <varieties>).

    df: the sentences by column and pairs, a map from variety to array<struct<src,tgt>> against the base
    sentence. Positions of the base that share targets are merged by segment_fold(); a segment's phrases are the
    words of its positions, null for a variety without any. There is one row for each phrase, with all
    phrases of its segment beside it. Row-local: no shuffle. Rows without a base sentence give none.
    """
    columns, none = [base, *varieties], F.array().cast("array<int>")
    words = [tokens(F.col(c)).alias(f"w{k}") for k, c in enumerate(columns)]
    maps = [F.coalesce(one_to_many(F.element_at(pairs, v)), F.expr("cast(map() as map<int,array<int>>)")).alias(f"m{k}") for k, v in enumerate(varieties, 1)]

    def segments(c: Column) -> Column:
        positions = F.sequence(F.lit(0), F.size(c["w0"]) - 1)
        steps = F.transform(positions, lambda i: F.struct(i.alias("idx"), *[F.coalesce(F.element_at(c[f"m{k}"], i), none).alias(v) for k, v in enumerate(varieties, 1)]))
        own = lambda s, k, v: F.when(F.size(s[v]) > 0, positions_to_words(c[f"w{k}"], s[v])).alias(v)
        return F.transform(segment_fold(steps, varieties), lambda s: F.struct(positions_to_words(c["w0"], s["idx"]).alias(base), *[own(s, k, v) for k, v in enumerate(varieties, 1)]))

    told = df.where(F.size(tokens(F.col(base))) > 0).select(*key, F.posexplode_outer(bound(F.struct(*words, *maps), segments)).alias("segment", "_s")).where("segment is not null")  # outer, as a plain posexplode adds a filter that works all of this out once more
    entries = F.array(*[F.struct(F.lit(c).alias("dialect"), F.col(f"_s.{c}").alias("word")) for c in columns])
    spread = told.withColumn("_e", F.explode(F.filter(entries, lambda x: x["word"] != "")))
    return spread.select(*key, "segment", "_e.word", "_e.dialect", *[F.col(f"_s.{c}").alias(c) for c in columns])


def grouped_phrases(phrases_: DataFrame, varieties: Sequence[str]) -> DataFrame:
    """Count maps of phrase_rows() by normalised word and dialect: (word, dialect, <varieties> map<string,bigint>).

    Phrases are counted before any map is built, so a frequent word costs one entry for each phrase it is
    aligned with. A variety without phrases has an empty map.
    """
    entries = F.array(*[F.struct(F.lit(k).alias("variety"), F.nullif(F.col(v), F.lit("")).alias("phrase")) for k, v in enumerate(varieties)])
    told = phrases_.select(normalize_text(F.col("word")).alias("word"), "dialect", entries.alias("entries"))
    # one row at least for each word, so that none is lost without phrases
    some = F.filter("entries", lambda x: x["phrase"].isNotNull())
    counted = told.select("word", "dialect", F.explode_outer(some).alias("e")).groupBy("word", "dialect", "e.variety", "e.phrase").agg(F.count("*").alias("n"))
    mine = F.when(F.col("phrase").isNotNull(), F.struct("variety", "phrase", "n"))
    listed = counted.groupBy("word", "dialect").agg(F.sort_array(F.collect_list(mine)).alias("all"))
    own = lambda k: F.transform(F.filter("all", lambda x: x["variety"] == k), lambda x: F.struct(x["phrase"], x["n"]))
    return listed.select("word", "dialect", *[F.map_from_entries(own(k)).alias(v) for k, v in enumerate(varieties)])


def phrase_pairs(grouped: DataFrame, varieties: Sequence[str]) -> DataFrame:
    """grouped_phrases() as (word, grp, tgt_grp, tgt_word, freq) for the scores; a dialect is not paired with itself."""
    entries = F.array(*[F.struct(F.lit(v).alias("tgt_grp"), F.map_entries(v).alias("m")) for v in varieties])
    spread = grouped.select("word", F.col("dialect").alias("grp"), F.explode(entries).alias("e")).where("grp <> e.tgt_grp")
    return spread.select("word", "grp", "e.tgt_grp", F.explode("e.m").alias("x")).select("word", "grp", "tgt_grp", F.col("x.key").alias("tgt_word"), F.col("x.value").alias("freq"))
