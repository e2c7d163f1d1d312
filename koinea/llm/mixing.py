"""Mixing sources to target weights.

Tokens are summed by source, targets follow from the weights, and every document is emitted
floor(rate) times, plus once more with a hash-seeded chance equal to the fraction of the rate.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koinea.llm._tables import numbered, written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Runs without white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chance(seed: int, key: Column) -> Column:
    """A number in [0, 1) from the MD5 of seed and key; the same in every run and on every engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, weights: Sequence[int], most: int) -> DataFrame:
    """Targets for sizes(source, source_size): adds weight and target.

    Sources in code-point order, null last, weigh ``weights`` in turn. Targets share the total by
    weight but stop at ``most`` times a source's size; the excess is shared again by weight among the
    rest until none is above. Each round takes one row of sums to the driver, whatever the number of
    sources.
    """
    ordered = numbered(
        sizes.withColumn("_absent", F.col("source").isNull().cast("int")), "_absent", "source", name="_place"
    )
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    shares = written(ordered.select("source", "source_size", F.element_at(cycle, (F.col("_place") % len(weights)).cast("int") + 1).alias("weight")))
    total = shares.agg(F.sum("source_size")).first()[0] or 0
    limit = F.col("source_size") * F.lit(most)
    level, capped = None, -1
    while True:
        full = F.lit(False) if level is None else F.col("weight") * F.lit(level) > limit
        size, weight, n = shares.agg(
            F.coalesce(F.sum(F.when(full, limit)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)), F.count(F.when(full, 1))
        ).first()
        if n == capped:
            break
        level, capped = ((total - size) / weight if weight else 0.0), n
    full = F.col("weight") * F.lit(level) > limit
    return shares.withColumn("target", F.when(full, limit.cast("double")).otherwise(F.col("weight") * F.lit(level)))


def mix_plan(docs: DataFrame, *, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = 17) -> DataFrame:
    """docs(doc_id, text, source) with size, source_size, target and copies; other columns stay.

    size: words of the text, 0 for null. copies: floor(rate) plus one with probability equal to the
    rest, rate = target / source_size, at most ``most``. The chance hangs on seed and doc_id alone, so
    reruns agree and rows that repeat a doc_id share their fate. A source without words has rate 0. An
    empty table gives an empty result. Names used here that clash with columns of docs replace them.
    """
    sized = docs.withColumn("size", word_count(F.col("text").cast("string")))
    sizes = sized.groupBy(F.col("source").cast("string").alias("source")).agg(F.sum("size").alias("source_size"))
    targets = source_targets(written(sizes), weights, most).select(
        F.col("source").alias("_mix_source"), "source_size", "target", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(0.0).alias("_rate")
    )
    plain = sized.drop("source_size", "target", "copies", "_mix_source", "_rate")
    joined = plain.join(targets, F.col("source").cast("string").eqNullSafe(F.col("_mix_source")), "left")
    whole = F.floor("_rate")
    extra = (chance(seed, F.col("doc_id")) < F.col("_rate") - whole).cast("long")
    return joined.withColumn("copies", whole + extra).drop("_mix_source", "_rate")


def mix_sources(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: each row of docs as often as mix_plan() says, with the columns of docs only."""
    plan = mix_plan(docs.withColumn("_whole_row", F.struct(*[F.col(f"`{c}`") for c in docs.columns])), **options)
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    repeated = plan.where("copies > 0").select("_whole_row", copy.alias("_copy"))
    return repeated.select("_whole_row.*")
