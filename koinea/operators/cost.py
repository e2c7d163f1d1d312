"""Substitution costs between letters of two varieties, from probability tables, as joins and sums."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from koinea.functions.scoring import ratio

GAP = "-1"
PIVOT = "CODA"
ETYMOLOGICAL = 0.4  # share of etymological evidence from which a phoneme counts as etymological


def phoneme_evidence(cond: DataFrame, phon: DataFrame) -> DataFrame:
    """Candidates (dialect, letter, caphi) with their etymological share, default flag and P(caphi|letter)."""
    own = cond.select("dialect", F.col("coda").alias("letter"), "caphi", "default_mapping", ratio(F.col("etym_count"), F.col("total")).alias("etym")).distinct()
    return own.join(phon, ["dialect", "letter", "caphi"], "left").fillna({"p": 0.0, "etym": 0.0, "default_mapping": False})


def letter_vectors(cond: DataFrame, phon: DataFrame, alphabet: DataFrame) -> DataFrame:
    """V(dialect, letter, coda): the mass a letter puts on each letter of the common alphabet.

    The general cost is 1 - sum over coda of V1 * V2, so one small vector for each letter replaces a
    loop over three sets.
    """
    p_coda = cond.select("dialect", "coda", "caphi", F.col("p_coda_given_caphi").alias("q")).distinct()
    spread = phoneme_evidence(cond, phon).crossJoin(F.broadcast(alphabet.select("coda").distinct()))  # the alphabet has some 50 letters
    strong, same = F.col("etym") > ETYMOLOGICAL, F.col("letter") == F.col("coda")
    mass = (
        F.when(strong & ~same & ~F.col("default_mapping"), 0.0).when(strong & same, F.col("p")).otherwise(F.coalesce("q", F.lit(0.0)) * F.col("p"))
    )
    return spread.join(p_coda, ["dialect", "coda", "caphi"], "left").groupBy("dialect", "letter", "coda").agg(F.sum(mass).alias("v")).where("v <> 0")


def gap_mass(cond: DataFrame, phon: DataFrame) -> DataFrame:
    """(dialect, letter, g): the mass of a letter's phonemes that stand for nothing."""
    p_gap = cond.where(F.col("coda") == GAP).select("dialect", "caphi", F.col("p_coda_given_caphi").alias("q")).distinct()
    weak = phoneme_evidence(cond, phon).where(F.col("etym") < ETYMOLOGICAL)
    return weak.join(p_gap, ["dialect", "caphi"]).groupBy("dialect", "letter").agg(F.sum(F.col("q") * F.col("p")).alias("g"))


def pivot_mass(cond: DataFrame, phon: DataFrame) -> DataFrame:
    """(dialect, letter, coda, c): the mass of a letter of the pivot spelling; candidates of any dialect count."""
    share = phoneme_evidence(cond, phon).select("dialect", "letter", "caphi", "etym")
    any_dialect = cond.select(F.col("coda").alias("letter"), "caphi").distinct()
    q = cond.select("dialect", "coda", "caphi", F.col("p_coda_given_caphi").alias("q")).distinct()
    return (
        phon.join(any_dialect, ["letter", "caphi"], "left_semi")
        .join(share, ["dialect", "letter", "caphi"], "left")
        .where(F.coalesce("etym", F.lit(0.0)) < ETYMOLOGICAL)
        .join(q, ["dialect", "caphi"])
        .groupBy("dialect", "letter", "coda")
        .agg(F.sum(F.col("q") * F.col("p")).alias("c"))
    )


def substitution_costs(requests: DataFrame, cond: DataFrame, phon: DataFrame, raw: DataFrame, alphabet: DataFrame, *, threshold: float = 0.0) -> DataFrame:
    """Costs of requests(l1, d1, l2, d2): adds cost; `-1` is the gap and CODA the pivot spelling.

    cond: (dialect, coda, caphi, p_coda_given_caphi, default_mapping, etym_count, total); phon: (dialect,
    letter, caphi, p); raw: (dialect, raw, coda, p_raw_given_coda); alphabet: (coda). A cost under
    threshold is 0. Letters without candidates cost 1.
    """
    swap = F.col("d2") == PIVOT

    def pick(yes: str, no: str) -> Column:
        return F.when(swap, F.col(yes)).otherwise(F.col(no))

    sided = requests.select("*", pick("l2", "l1").alias("a"), F.when(swap, PIVOT).otherwise(F.col("d1")).alias("da"), pick("l1", "l2").alias("b"), pick("d1", "d2").alias("db"))
    pairs = sided.select("a", "da", "b", "db").distinct()
    known = cond.select("dialect", F.col("coda").alias("letter")).distinct()
    anywhere = known.select("letter").distinct()
    gaps = gap_mass(cond, phon)
    vectors = letter_vectors(cond, phon, alphabet)
    dots = (
        pairs.join(vectors.select(F.col("letter").alias("a"), F.col("dialect").alias("da"), "coda", F.col("v").alias("va")), ["a", "da"])
        .join(vectors.select(F.col("letter").alias("b"), F.col("dialect").alias("db"), "coda", F.col("v").alias("vb")), ["b", "db", "coda"])
        .groupBy("a", "da", "b", "db")
        .agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    )
    full = (
        pairs.join(known.select(F.col("letter").alias("a"), F.col("dialect").alias("da"), F.lit(True).alias("has_a")), ["a", "da"], "left")
        .join(anywhere.select(F.col("letter").alias("a"), F.lit(True).alias("any_a")), ["a"], "left")
        .join(known.select(F.col("letter").alias("b"), F.col("dialect").alias("db"), F.lit(True).alias("has_b")), ["b", "db"], "left")
        .join(gaps.select(F.col("letter").alias("a"), F.col("dialect").alias("da"), F.col("g").alias("gap_a")), ["a", "da"], "left")
        .join(gaps.select(F.col("letter").alias("b"), F.col("dialect").alias("db"), F.col("g").alias("gap_b")), ["b", "db"], "left")
        .join(raw.where(F.col("raw") == GAP).select(F.col("coda").alias("a"), F.col("dialect").alias("db"), F.col("p_raw_given_coda").alias("gap_raw")), ["a", "db"], "left")
        .join(pivot_mass(cond, phon).select(F.col("coda").alias("a"), F.col("letter").alias("b"), F.col("dialect").alias("db"), "c"), ["a", "b", "db"], "left")
        .join(dots, ["a", "da", "b", "db"], "left")
    )
    pivot, gap_a, gap_b = F.col("da") == PIVOT, F.col("a") == GAP, F.col("b") == GAP
    has_a = F.coalesce(F.when(pivot, F.col("any_a")).otherwise(F.col("has_a")), F.lit(False))
    mass = (
        F.when(gap_a & pivot, F.col("gap_b"))
        .when(gap_b & ~pivot, F.col("gap_a"))
        .when(gap_a, F.col("gap_b"))
        .when(gap_b, F.col("gap_raw"))
        .when(pivot, F.col("c"))
        .otherwise(F.col("dot"))
    )
    left = 1.0 - F.coalesce(mass, F.lit(0.0))
    cost = (
        F.when(~gap_a & ~gap_b & (~has_a | ~F.coalesce("has_b", F.lit(False))), 1.0)
        .when((F.col("a") == F.col("b")) & (F.col("da") == F.col("db")), 0.0)
        .when(left < threshold, 0.0)
        .otherwise(left)
    )
    return sided.join(full.select("a", "da", "b", "db", cost.alias("cost")), ["a", "da", "b", "db"]).drop("a", "da", "b", "db")


def letter_evidence(merged: DataFrame, defaults: DataFrame, known: DataFrame) -> DataFrame:
    """Counts how often a letter's phoneme speaks for sound or for origin: known plus phon_count, etym_count, total.

    merged: (coda, position, letter, by_dialect) of merged letter alignments; defaults: (letter, caphi);
    known: rows with (dialect, letter, caphi). If all phonemes at a place are defaults of the letter, each is
    phonological. Else, if dialects differ there, each is etymological, the defaults phonological as well,
    and both count twice in total. Places where all dialects share one other phoneme count nothing. Rows
    without evidence get zeros. Evidence combines before its shuffle, so common letters cost little.
    """
    usual = defaults.groupBy("letter").agg(F.collect_set("caphi").alias("_usual"))  # a letter has few phonemes
    placed = letter_kinds(merged).join(usual, "letter", "left").withColumn("_usual", F.coalesce("_usual", F.array().cast("array<string>")))
    return known.join(_evidence(placed), ["dialect", "letter", "caphi"], "left").fillna(0, ["phon_count", "etym_count", "total"])


def letter_kinds(merged: DataFrame) -> DataFrame:
    """(letter, heard array<struct<dialect,caphi>>, n): how many places have the same letter with the same phonemes by dialect."""
    heard = F.transform(F.map_entries("by_dialect"), lambda e: F.struct(e["key"].alias("dialect"), e["value"].alias("caphi")))
    return merged.select("letter", F.array_sort(heard).alias("heard")).groupBy("letter", "heard").agg(F.count("*").alias("n"))


def own_letter_evidence(merged: DataFrame, usual: Callable[[Column, Column], Column]) -> DataFrame:
    """letter_evidence() for all phonemes of merged, of which usual(letter, caphi) are defaults, in one pass over merged.

    Equal places are one row with their number before a letter's places come together.
    """
    listed = letter_kinds(merged).groupBy("letter").agg(F.collect_list(F.struct("heard", "n")).alias("kinds"))
    every = F.array_distinct(F.flatten(F.transform("kinds", lambda k: F.transform(k["heard"], lambda x: x["caphi"]))))
    own = listed.select("letter", F.filter(every, lambda c: usual(F.col("letter"), c)).alias("_usual"), F.explode("kinds").alias("k"))
    return _evidence(own.select("letter", "_usual", "k.heard", "k.n"))


def _evidence(placed: DataFrame) -> DataFrame:
    """Sums of evidence by (dialect, letter, caphi) from letter_kinds() with each letter's defaults in _usual."""
    heard = F.array_distinct(F.transform("heard", lambda x: x["caphi"]))
    plain, differ = F.size(F.array_except(heard, F.col("_usual"))) == 0, F.size(heard) > 1
    told = placed.select("letter", "_usual", "n", plain.alias("_plain"), differ.alias("_differ"), F.explode("heard").alias("h")).select("*", "h.dialect", "h.caphi")
    phon = F.col("_plain") | (F.col("_differ") & F.array_contains("_usual", F.col("caphi")))
    etym = ~F.col("_plain") & F.col("_differ")
    times = lambda c: F.sum(F.col("n") * c)
    return told.groupBy("dialect", "letter", "caphi").agg(
        times(phon.cast("long")).alias("phon_count"), times(etym.cast("long")).alias("etym_count"), times(F.when(F.col("_plain"), 1).when(etym, 2).otherwise(0)).alias("total")
    )


def evidence_examples(merged: DataFrame, defaults: DataFrame) -> DataFrame:
    """(dialect, letter, caphi, coda): the words whose letter is etymological evidence, one row for each place."""
    usual = defaults.groupBy("letter").agg(F.collect_set("caphi").alias("_usual"))
    placed = merged.join(usual, "letter", "left").withColumn("_usual", F.coalesce("_usual", F.array().cast("array<string>")))
    heard = F.array_distinct(F.map_values("by_dialect"))
    differing = placed.where((F.size(heard) > 1) & (F.size(F.array_except(heard, F.col("_usual"))) > 0))
    return differing.select("letter", "coda", F.explode("by_dialect").alias("dialect", "caphi")).select("dialect", "letter", "caphi", "coda")
