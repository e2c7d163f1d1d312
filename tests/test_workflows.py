"""The training-row builder, lookups, scorers, phrase pipeline, evidence and the stage runner on small tables."""

import hashlib
import re

import pandas as pd
import pytest
from pyspark.sql import functions as F

from koinea import jobs
from koinea.operators import alignment as A
from koinea.operators import cost as C
from koinea.operators import phrases as P
from koinea.operators import sampling as S
from koinea.operators import sentences as N
from koinea.operators import training as TR
from koinea.plans import lexical
from koinea.sources import tables as T


def md5(*parts):
    return hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()


@pytest.mark.parametrize("share", [0.0, 0.05, 0.9, 1.0])
def test_cuts_match_a_full_sort(spark, share):
    df = spark.range(300).withColumn("g", F.when(F.col("id") < 200, "a").when(F.col("id") < 299, F.lit(None)).otherwise("b"))
    found = {r.id: r.split for r in S.stratified_split(df, "g", "id", share=share, digits=1).collect()}
    for members in (range(200), range(200, 299), [299]):
        order = sorted(members, key=lambda i: md5(42, i))
        cut = int(len(order) * share)
        assert [found[i] for i in order] == ["train"] * cut + ["dev"] * (len(order) - cut)
    whole = {r.id: r.split for r in S.exact_cut(df, "id", share=share).collect()}
    order = sorted(range(300), key=lambda i: md5(42, i))
    assert [whole[i] for i in order] == ["train"] * int(300 * share) + ["dev"] * (300 - int(300 * share))
    assert S.exact_cut(df.where("id < 0"), "id").count() == S.stratified_split(df.where("id < 0"), "g", "id").count() == 0


def test_lookup_is_exact_then_normal_then_default(spark):
    lexicon = N.best_scores(spark.createDataFrame([("a", 0.2), ("a", 0.5), ("b", -3.0), ("A", 0.9), ("", 1.0), (None, 1.0)], "phrase string, score double"))
    rows = spark.createDataFrame([(1, ["A", "a"]), (2, ["B", "zz", None]), (3, []), (4, None)], "id int, words array<string>")
    found = {r.id: r.score for r in N.lexicon_means(rows, "id", "words", lexicon, F.lower).collect()}
    assert found == pytest.approx({1: 0.7, 2: (0.0 - 1 - 1) / 3, 3: -1.0, 4: -1.0})


def test_scorers_can_be_exchanged(spark):
    rows = spark.createDataFrame([(1, "aa b_cc aa"), (2, ""), (3, None)], "id int, text string")

    def size(marked: pd.Series) -> pd.Series:
        return marked.str.extract(r"\[TGT\](.*)\[/TGT\]")[0].str.len().astype(float)

    found = N.score_sentences(rows, "id", "text", N.batch_scorer(size), k=2).collect()
    assert [(r.id, r.n_words, r.words, r.scores) for r in found] == [(1, 4, ["aa", "b", "cc", "aa"], [2, 1, 2, 2])]
    assert found[0].lowest == pytest.approx(2 / (1 + 1 / 2)) and found[0]["mean"] == pytest.approx(((0.25 * 3 + 1) / 4) ** -0.5, rel=1e-6)
    assert N.score_sentences(rows, "id", "text", N.batch_scorer(size), whole=True).first().scores == [len("aa b cc aa")]
    assert N.score_sentences(rows, "id", "text", N.batch_scorer(size), most=1).first().words == ["aa"]


def test_marked_sentences_against_brute_force(spark):
    texts = {("s1", "X"): "ab cd ef", ("s2", "X"): "cd efg ab", ("s3", "X"): "zcd efz cd", ("s4", "Y"): "ab ab", ("s5", "X"): None}
    rows = [("1", "X", ["no", "cd ef", "ab"]), ("2", "X", ["ab", "cd ef"]), ("3", "X", ["x y", "ab"]), ("4", "Y", [None, "ab"]), ("5", "Y", []), ("6", "X", None), ("7", "X", ["no"])]
    want = {}
    for row, dialect, words in rows:
        mine = {s: t for (s, d), t in texts.items() if d == dialect and t}
        for word in words or []:
            if word is None:
                continue
            hits = [(s, 0) for s, t in mine.items() if word in t.split()]
            if " " in word:
                hits = [(s, k) for s, t in mine.items() if word in t for k in range(1, 1 + sum(p in t.split() for p in word.split()))]
            if hits or " " in word:
                take = 1 + int(md5(42, row)[:8], 16) % 2
                for s, _ in sorted(hits, key=lambda h: md5(42, row, *h))[:take]:
                    want.setdefault(row, []).append((s, mine[s].replace(word, f"[TGT]{word}[/TGT]", 1)))
                break
    sentences = spark.createDataFrame([(s, d, t) for (s, d), t in texts.items()], "sent_id string, dialect string, sentence string")
    frame = spark.createDataFrame(rows, "row_id string, dialect string, words array<string>")
    found = {}
    for r in TR.marked_sentences(frame, sentences).collect():
        found.setdefault(r.row_id, []).append((r.sent_id, r.marked))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()} and set(found) == {"1", "2", "4"}


def test_slots_and_score_maps(spark):
    df = spark.createDataFrame(
        [("ab", "X", 6, {"a": 1}, {}, {6: 0.5}), ("cd", "Y", 26, None, {}, {6: 0.5, 26: 0.25}), ("12", "X", 6, {"a": 1}, {"b": 1}, {6: 1.0})],
        "word string, dialect string, corpus int, p map<string,bigint>, q map<string,bigint>, score map<int,double>",
    )
    assert [r.word for r in TR.slot_filter(df, ["p", "q"], {6: 1, 26: 1}).collect()] == ["ab"]
    assert [(r.word, r.score) for r in TR.flatten_scores(df, ["score"], 26).orderBy("word").collect()] == [("12", 1.0), ("ab", 0.5), ("cd", 0.25)]
    assert [(r.word, r.score) for r in TR.flatten_scores(df, ["score"], 6, ["Y"]).collect()] == [("cd", 0.5)]
    assert [r.score_c26 for r in TR.unpack_scores(df, ["score"]).orderBy("word").collect()] == [None, None, 0.25]


def test_phrase_rows_keep_the_wide_row(spark):
    rows = [(1, "a b c", "x y", "p", {"X": [(0, 1), (1, 1), (0, 0), (1, 0)], "P": [(2, 0)]}), (2, " ", "x", "p", {}), (3, "d", None, None, {})]
    df = spark.createDataFrame(rows, "id int, B string, X string, P string, pairs map<string,array<struct<src:int,tgt:int>>>")
    found = A.phrase_rows(df, ["id"], "B", ["X", "P"])
    assert sorted((r.id, r.segment, r.dialect, r.word, r.X, r.P) for r in found.collect()) == [
        (1, 0, "B", "a b", "x y", None), (1, 0, "X", "x y", "x y", None), (1, 1, "B", "c", None, "p"), (1, 1, "P", "p", None, "p"), (3, 0, "B", "d", None, None),
    ]
    grouped = {(r.word, r.dialect): r for r in A.grouped_phrases(found.unionByName(found), ["B", "X", "P"]).collect()}
    assert grouped["a b", "B"].X == {"x y": 2} and grouped["a b", "B"].P == {} and len(grouped) == 5


def test_letter_evidence(spark):
    merged = spark.createDataFrame(
        [("qb", 0, "q", {"X": "q", "Y": "k"}), ("qb", 1, "b", {"X": "b", "Y": "b"}), ("q", 0, "q", {"X": "k"}), ("z", 0, "z", {"X": "z"})],
        "coda string, position int, letter string, by_dialect map<string,string>",
    )
    defaults = spark.createDataFrame([("q", "q"), ("b", "b")], "letter string, caphi string")
    known = spark.createDataFrame([("X", "q", "q"), ("Y", "q", "k"), ("X", "q", "k"), ("X", "b", "b"), ("X", "z", "z"), ("Y", "z", "z")], "dialect string, letter string, caphi string")
    found = {(r.dialect, r.letter, r.caphi): (r.phon_count, r.etym_count, r.total) for r in C.letter_evidence(merged, defaults, known).collect()}
    assert found == {("X", "q", "q"): (1, 1, 2), ("Y", "q", "k"): (0, 1, 2), ("X", "q", "k"): (0, 0, 0), ("X", "b", "b"): (1, 0, 1), ("X", "z", "z"): (0, 0, 0), ("Y", "z", "z"): (0, 0, 0)}
    assert sorted(map(tuple, C.evidence_examples(merged, defaults).collect())) == [("X", "q", "q", "qb"), ("Y", "q", "k", "qb")]


def test_raw_and_coda(spark, tmp_path):
    for part, rows in (("train", "s1\traw1\tcoda1\n"), ("test", "s2\tra,w2\tcoda2\n")):
        (tmp_path / part).mkdir()
        for city in ("Beirut", "Cairo"):
            (tmp_path / part / f"{part}.{city}.tsv").write_text("sentID.BTEC\traw\tCODA\n" + (rows if city == "Beirut" or part == "train" else ""))
    base = spark.createDataFrame([("s1", "m"), ("s2", "n"), ("s3", "o")], "`sentID.BTEC` string, sent string")
    folder = T.first_folder(spark, [str(tmp_path / "none"), str(tmp_path)], "train", "test")
    found = {r[0]: r for r in T.read_raw_and_coda(spark, folder, {"Beirut": "BEI", "Cairo": "CAI"}, base).collect()}
    assert set(found) == {"s1", "s2"} and found["s2"].BEI_raw == "raw2" and found["s2"].CAI_CODA is None and found["s1"].CAI_raw == "raw1"
    with pytest.raises(FileNotFoundError):
        T.first_folder(spark, [str(tmp_path / "none")], "train")


def test_stages_from_corpus_to_report(spark, tmp_path):
    base = ["house is big", "house is small", "dog runs", "dog is big"]
    lines = ["row_idx\tMSA\tBEI\tCAI"] + [f"{i}\t{t}\t{t.replace('big', 'bigg')}\t{t.replace('house', 'haus')}" for i, t in enumerate(base)]
    (tmp_path / "corpus.tsv").write_text("\n".join(lines) + "\n")
    (tmp_path / "alignment_ids.txt").write_text("".join(f"{i}\t{v}\n" for i in range(4) for v in ("BEI", "CAI")))
    (tmp_path / "alignments.txt").write_text("".join(" ".join(f"{k}-{k}" for k in range(len(t.split()))) + "\n" for t in base for _ in range(2)))
    (tmp_path / "evaluation.csv").write_text("sentence,n_valid,split\nhouse is,11,dev\nunknown,0,test\n")
    settings = jobs.Settings(core=("MSA", "BEI", "CAI"))
    assert jobs.run(spark, str(tmp_path), settings, end="evaluate") == list(jobs.STAGES)
    scored = {(r.word, r.dialect): r for r in spark.read.parquet(str(tmp_path / "scores")).collect()}
    assert scored["is", "MSA"].BEI == {"is": 3} and scored["is", "MSA"].min_t_0_5_k_20_c6 > 0.999 > 0.9 > scored["house", "MSA"].min_t_0_3_k_20_c6
    rows = spark.read.parquet(str(tmp_path / "sentence_rows")).collect()
    assert rows and all(r.sentence.count("[TGT]") == 1 for r in rows)
    report = {r.split: r.rmse for r in spark.read.parquet(str(tmp_path / "report")).collect()}
    assert report["dev"] < 0.5 and report["test"] < 1e-3
    assert spark.read.parquet(str(tmp_path / "aligner_input")).count() == 8
    assert jobs.chosen() == ["table", "pairs", "phrases", "scores"] and jobs.chosen(only="scores") == ["scores"]
    with pytest.raises(ValueError):
        jobs.chosen(start="evaluate", end="table")
    assert jobs.main(["--list"]) == 0 and jobs.main(["x", "--dry-run", "--from", "scores"]) == 0


@pytest.mark.parametrize("slice_phrases", [1, 100])
def test_phrases_of_texts_against_brute_force(spark, slice_phrases):
    texts = [(1, "xa by a"), (1, "a b"), (2, "a\tb a bc"), (3, "xa by"), (4, None), (5, "za　a  b\x1ca b"), (6, "b a\nb a b\n"), (None, "a b")]
    asked = [("a", "b"), ("xa", "by"), ("b", "a"), ("q", "q")]
    want = {}
    for a, b in asked:
        docs = {d for d, t in texts if t and f"{a} {b}" in t and {a, b} & set(re.split(r"[ \t\n　]+", t))}
        if docs:
            want[a, b] = (len(docs), min(docs - {None}))
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    counted = P.phrase_counts(frame, spark.createDataFrame(asked, "a string, b string"), slice_phrases=slice_phrases)
    assert {(r.a, r.b): (r.n_docs, r.first_doc) for r in counted.collect()} == want
    assert P.phrase_counts(frame, spark.createDataFrame([], "a string, b string")).count() == 0


def test_phrases_do_not_spread_texts(spark, tmp_path):
    """One phrase of every text sends one row for each text, not one for each word that two items share."""
    spark.createDataFrame([(i, "a b c d") for i in range(50)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, "a b c d") for i in range(3)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = lexical.phrase_contains(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(found.collect()) == 9 and plan.count("FileScan parquet [doc_id") == 1  # texts are read once
