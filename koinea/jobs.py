"""The stages from a wide corpus to training rows as one command over a folder of tables.

Each stage reads the tables it needs from the folder and writes its own as Parquet, so that a run can
start and stop anywhere: `python -m koinea.jobs FOLDER --from phrases --to scores`. Aligning and model
training are not stages: alignments are read, models plug in as scorers (see operators.sentences).
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koinea.functions.scoring import rmse
from koinea.operators import alignment as A
from koinea.operators import generality as G
from koinea.operators import training as TR
from koinea.operators.sentences import best_scores, score_sentences, table_scorer
from koinea.sources import sinks, tables


@dataclass(frozen=True)
class Settings:
    """Parameters of all stages; paths are relative to the folder."""

    base: str = "MSA"
    core: Sequence[str] = ("MSA", "BEI", "CAI", "TUN", "DOH", "RAB")  # the base too
    others: Sequence[str] = ()
    cities: dict[str, str] = field(default_factory=dict)  # file stem -> variety; empty: corpus.tsv is wide already
    corpus_dir: str = "corpus"
    corpus: str = "corpus.tsv"
    alignments: str = "alignments.txt"
    alignment_ids: str = "alignment_ids.txt"
    evaluation: str = "evaluation.csv"
    temperature: float = 5.0
    thresholds: Sequence[float] = (0.3, 0.4, 0.5)
    k: float = 20.0
    target: str = "min_t_0_5_k_20"  # its c6 column, or that of a row's own corpus
    train_corpus: int = 6
    empty_slots: dict[int, int] = field(default_factory=lambda: {6: 1, 26: 6})
    seed: int = 42
    test_size: float = 0.1
    lowest: int = 2

    @property
    def varieties(self) -> list[str]:
        return [*self.core, *self.others]


class Workspace:
    """A folder of Parquet tables."""

    def __init__(self, spark: SparkSession, folder: str, settings: Settings):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def write(self, df: DataFrame, name: str) -> None:
        sinks.write_table(df, self.path(name))


def build_table(w: Workspace) -> None:
    """corpus: one row for each sentence (row_idx, varieties), normalised without folding."""
    s = w.settings
    if s.cities:
        long = tables.read_city_corpora(w.spark, w.path(s.corpus_dir), s.cities)
        wide = tables.normalized_columns(tables.wide_corpus(long, s.base, s.varieties), s.varieties, fold=False).withColumnRenamed("sent_id", "row_idx")
    else:
        wide = tables.read_wide_corpus(w.spark, w.path(s.corpus), s.varieties, fold=False)
        wide = tables.require(wide, ["row_idx"])
    w.write(wide.select(F.col("row_idx").cast("long").alias("row_idx"), *s.varieties), "table")


def export_pairs(w: Workspace) -> None:
    """aligner_input: `base ||| other` lines with their row and variety, for an aligner outside."""
    s = w.settings
    sinks.write_training_pairs(w.read("table"), w.path("aligner_input"), "row_idx", s.base, [v for v in s.varieties if v != s.base])


def phrases(w: Workspace) -> None:
    """phrases: count maps of aligned phrases by word and dialect, from the aligner's lines."""
    s = w.settings
    others = [v for v in s.varieties if v != s.base]
    pairs = tables.read_alignments(w.spark, w.path(s.alignments), w.path(s.alignment_ids))
    maps = pairs.groupBy("row_idx").agg(F.map_from_entries(F.collect_list(F.struct("variety", "pairs"))).alias("pairs"))  # a row has one entry for each variety
    rows = w.read("table").join(maps, "row_idx", "left").withColumn("pairs", F.coalesce("pairs", F.expr("cast(map() as map<string,array<struct<src:int,tgt:int>>>)")))
    w.write(A.grouped_phrases(A.phrase_rows(rows, ["row_idx"], s.base, others), s.varieties), "phrases")


def scores(w: Workspace) -> None:
    """scores: the twelve scores of each word and dialect beside its count maps."""
    s = w.settings
    grouped = w.read("phrases")
    pairs = G.distances(A.phrase_pairs(grouped, s.varieties))
    found = G.score_table(G.group_distances(pairs, s.temperature), s.core, s.others, thresholds=s.thresholds, k=s.k)
    w.write(grouped.join(found.withColumnRenamed("grp", "dialect"), ["word", "dialect"]), "scores")


def training_data(w: Workspace) -> None:
    """sentence_rows and word_rows with their splits, from the scores and the corpus."""
    s = w.settings
    table = w.read("scores")
    slots = list(s.core) if s.train_corpus == 6 else s.varieties
    if s.train_corpus == 6:
        table = table.where(F.col("dialect").isin(list(s.core)))
        limits = {c: s.empty_slots[6] for c in (6, 26)}
    else:
        limits = dict(s.empty_slots)
    kept = TR.slot_filter(table, slots, limits)
    own = F.coalesce(*[F.when(F.col("dialect") == v, F.map_entries(v)) for v in s.varieties])
    by_count = F.transform(F.reverse(F.array_sort(F.transform(own, lambda e: F.struct(e["value"], e["key"])))), lambda e: e["key"])
    score = F.col(f"{s.target}_c6")
    if s.train_corpus != 6:
        score = F.when(F.col("corpus") == 6, score).otherwise(F.col(f"{s.target}_c26"))
    rows = kept.select(F.concat_ws("|", "word", "dialect").alias("row_id"), "dialect", by_count.alias("words"), score.alias("score"))
    texts = A.phrases(w.read("table"), ["row_idx"], s.varieties).select(F.col("row_idx").alias("sent_id"), F.col("variety").alias("dialect"), F.col("phrase").alias("sentence"))
    w.write(TR.sentence_rows(rows, texts, "score", seed=s.seed, test_size=s.test_size), "sentence_rows")
    best = rows.where(F.size("words") > 0).select(F.get("words", F.lit(0)).alias("word"), "score")
    w.write(TR.word_rows(best, "score", seed=s.seed, test_size=s.test_size), "word_rows")


def evaluate(w: Workspace) -> None:
    """report: root mean squared error by split of sentence scores that the score table gives."""
    s = w.settings
    gold = tables.read_scored_sentences(w.spark, w.path(s.evaluation))
    entries = w.read("scores")
    own = F.coalesce(*[F.when(F.col("dialect") == v, F.map_keys(v)) for v in s.varieties])
    lexicon = best_scores(entries.select(F.explode(own).alias("phrase"), F.col(f"{s.target}_c6").alias("score")))
    found = score_sentences(gold.select("sentence", F.col("sentence").alias("text")).distinct(), "sentence", "text", table_scorer(lexicon), k=s.lowest).select("sentence", "lowest")
    told = gold.join(found, "sentence", "left").withColumn("lowest", F.coalesce("lowest", F.lit(0.0)))
    w.write(told.groupBy("split").agg(F.count("*").alias("sentences"), rmse(F.col("generality"), F.col("lowest")).alias("rmse")), "report")


STAGES: dict[str, Callable[[Workspace], None]] = {
    "table": build_table,
    "pairs": export_pairs,
    "phrases": phrases,
    "scores": scores,
    "training": training_data,
    "evaluate": evaluate,
}
DEFAULT_END = "scores"


def chosen(start: str | None = None, end: str | None = None, only: str | None = None) -> list[str]:
    """The stages of a run, in order; the default ends with the scores."""
    names = list(STAGES)
    for name in (start, end, only):
        if name is not None and name not in STAGES:
            raise ValueError(f"unknown stage {name}; there are {', '.join(names)}")
    if only:
        return [only]
    first, last = names.index(start or names[0]), names.index(end or DEFAULT_END)
    if first > last:
        raise ValueError(f"stage {start} comes after {end or DEFAULT_END}")
    return names[first : last + 1]


def run(spark: SparkSession, folder: str, settings: Settings | None = None, *, start: str | None = None, end: str | None = None, only: str | None = None) -> list[str]:
    """Runs stages in order and returns their names; the first that fails ends the run."""
    work = Workspace(spark, folder, settings or Settings())
    names = chosen(start, end, only)
    for name in names:
        STAGES[name](work)
    return names


def main(argv: Sequence[str] | None = None) -> int:
    """Command line: the folder, and which stages to run, list, or only name."""
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("folder", nargs="?", default=".")
    p.add_argument("--from", dest="start", choices=list(STAGES))
    p.add_argument("--to", dest="end", choices=list(STAGES))
    p.add_argument("--only", choices=list(STAGES))
    p.add_argument("--list", action="store_true")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--others", nargs="*", default=[], help="varieties beyond the core")
    p.add_argument("--corpus", type=int, choices=(6, 26), default=6)
    p.add_argument("--target-col", default=Settings.target)
    p.add_argument("--n-none-6", type=int, default=1)
    p.add_argument("--n-none-26", type=int, default=6)
    p.add_argument("--seed", type=int, default=42)
    p.add_argument("--k", type=int, default=2, help="how many of the lowest word scores a sentence score takes")
    args = p.parse_args(argv)
    if args.list or args.dry_run:
        print("\n".join(STAGES if args.list else chosen(args.start, args.end, args.only)))
        return 0
    settings = Settings(
        others=tuple(args.others), train_corpus=args.corpus, target=args.target_col, empty_slots={6: args.n_none_6, 26: args.n_none_26}, seed=args.seed, lowest=args.k
    )
    run(SparkSession.builder.appName("koinea-jobs").getOrCreate(), args.folder, settings, start=args.start, end=args.end, only=args.only)
    return 0


if __name__ == "__main__":
    sys.exit(main())
