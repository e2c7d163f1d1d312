"""Deterministic samples and splits: every draw follows the MD5 of a seed and the row's key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *keys: str) -> Column:
    """The sort key of a row."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from the row's sort key."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def sample_per_group(df: DataFrame, group: Sequence[str], key: str, *, seed: int = 42, most: int = 2) -> DataFrame:
    """One to ``most`` rows of each group, how many by the group's own draw."""
    size = F.lit(1) + (F.conv(F.substring(draw(seed, *group), 1, 8), 16, 10).cast("long") % most)
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(draw(seed, key)))
    return df.withColumn("_rank", rank).where((F.col("_rank") <= most) & (F.col("_rank") <= size)).drop("_rank")


def _cutoffs(df: DataFrame, stratum: Sequence[str], key: str, seed: int, share: float, digits: int) -> DataFrame:
    """(stratum, _cutoff): the draw of the last training row of each stratum; none where no row trains.

    Rows are counted by the first hex digits of their draws. The running counts of a stratum, at most
    16 ** digits of them, tell in which of these buckets its cut falls; only that bucket's rows are ranked.
    """
    drawn = df.select(*stratum, draw(seed, key).alias("_draw")).withColumn("_bucket", F.substring("_draw", 1, digits))
    counts = drawn.groupBy(*stratum, "_bucket").agg(F.count("*").alias("_n"))
    whole = Window.partitionBy(*stratum)
    running = counts.withColumn("_upto", F.sum("_n").over(whole.orderBy("_bucket"))).withColumn("_wanted", F.floor(F.sum("_n").over(whole) * F.lit(share)))
    at = running.where("_upto >= _wanted and _upto - _n < _wanted").select(*[F.col(c).alias(f"_s{k}") for k, c in enumerate(stratum)], F.col("_bucket").alias("_at"), (F.col("_wanted") - F.col("_upto") + F.col("_n")).alias("_rank"))
    same = F.col("_bucket") == F.col("_at")
    for k, c in enumerate(stratum):
        same = same & F.col(c).eqNullSafe(F.col(f"_s{k}"))
    near = drawn.join(at, same).withColumn("_r", F.row_number().over(whole.orderBy("_draw")))
    return near.where("_r = _rank").select(*[F.col(f"_s{k}") for k in range(len(stratum))], F.col("_draw").alias("_cutoff"))


def stratified_split(df: DataFrame, stratum: str, key: str, *, seed: int = 42, share: float = 0.9, digits: int = 4) -> DataFrame:
    """Adds split train or dev: the first floor(share * n) rows of each stratum in drawn order train.

    One draw for each stratum is found and every row is compared with it, so no stratum is sorted in one
    task. A null stratum is one too; rows that repeat a key go to one side together.
    """
    cut = _cutoffs(df, [stratum], key, seed, share, digits)
    joined = df.join(cut, F.col(stratum).eqNullSafe(F.col("_s0")), "left")
    return joined.withColumn("split", F.when(draw(seed, key) <= F.col("_cutoff"), "train").otherwise("dev")).drop("_s0", "_cutoff")


def exact_cut(df: DataFrame, key: str, *, seed: int = 42, share: float = 0.9, digits: int = 4) -> DataFrame:
    """Adds split: the first floor(share * n) rows of the whole table in drawn order train."""
    cut = _cutoffs(df.select(key, F.lit(0).alias("_all")), ["_all"], key, seed, share, digits)
    joined = df.join(F.broadcast(cut.select("_cutoff")), how="left")  # one row at most
    return joined.withColumn("split", F.when(draw(seed, key) <= F.col("_cutoff"), "train").otherwise("dev")).drop("_cutoff")


def threshold_split(df: DataFrame, key: str, *, seed: int = 42, share: float = 0.9) -> DataFrame:
    """Adds split by each row's own draw; needs no shuffle and holds the share on average."""
    return df.withColumn("split", F.when(uniform(seed, key) < share, "train").otherwise("dev"))
