"""Operators against hand-made goldens and plain-Python oracles."""

import itertools
import math
import time

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from koinea.operators import alignment as A
from koinea.operators import cost as C
from koinea.operators import counting as N
from koinea.operators import generality as G
from koinea.operators import kernels as K
from koinea.operators import sampling as S
from koinea.sources import tables as T


def fold(spark, steps, columns):
    kind = "array<struct<idx:int," + ",".join(f"{c}:array<int>" for c in columns) + ">>"
    df = spark.createDataFrame([(steps,)], f"s {kind}")
    return df.select(A.segment_fold(F.col("s"), columns).alias("m")).first().m


def test_segment_fold_one_column(spark):
    steps = [(i, t) for i, t in enumerate([[1], [1], [2], [], []])]
    assert [m.idx for m in fold(spark, steps, ["a"])] == [[0, 1], [2], [3], [4]]


def test_segment_fold_follows_the_union(spark):
    steps = [(0, [1], [5]), (1, [1], [6]), (2, [2], [6]), (3, [3], [6, 5])]
    merged = fold(spark, steps, ["a", "b"])
    assert [m.idx for m in merged] == [[0, 1], [2], [3]]
    assert merged[0].b == [5, 6]


def test_segment_fold_keeps_every_position(spark):
    steps = [(i, [i % 2], [i // 3]) for i in range(11)]
    assert list(itertools.chain(*(m.idx for m in fold(spark, steps, ["a", "b"])))) == list(range(11))


def test_blank_blocks(spark):
    df = spark.createDataFrame([(1, i, x, x) for i, x in enumerate(["a", "b", "", "", "c"])], "g int, i int, l string, r string")
    assert [(r.l, r.block) for r in A.blank_blocks(df, "g", "i", "l", "r").orderBy("i").collect()] == [("a", 0), ("b", 0), ("c", 1)]


def test_one_to_many(spark):
    df = spark.createDataFrame([("0-1 0-0 2-2",), ("",)], "line string")
    rows = A.parsed(df, "line").select(A.one_to_many(F.col("pairs")).alias("m")).collect()
    assert [r.m for r in rows] == [{0: [0, 1], 2: [2]}, {}]


def test_contingency_sums_to_one_before_rounding(spark):
    df = spark.createDataFrame([("d", "a", "x"), ("d", "a", "y"), ("d", "b", "x"), ("d", None, "x"), ("d", "a", "x")], "g string, a string, b string")
    rows = {(r.a, r.b): r for r in N.contingency(df, "g", "a", "b", places=None).collect()}
    assert rows["a", "x"].p_a_given_b == pytest.approx(2 / 3) and rows["a", "x"].p_b_given_a == pytest.approx(2 / 3)
    assert sum(r.p_b_given_a for (a, _), r in rows.items() if a == "a") == pytest.approx(1)
    assert N.contingency(df, "g", "a", "b", sources=["b"], targets=["y"]).count() == 0


def test_normalized_keeps_zero_mass(spark):
    df = spark.createDataFrame([("g", 0.0), ("g", 0.0), ("h", 1.0), ("h", 3.0)], "g string, p double")
    assert sorted(r.p for r in N.normalized(df, ["g"], "p").collect()) == [0.25, 0.5, 0.5, 0.75]


def test_top_term_prefers_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 0), (1, "a", 1), (1, None, 2)], "g int, t string, o int")
    assert [tuple(r) for r in N.top_term(N.counter(df, ["g"], "t", "o"), ["g"], "t").collect()] == [(1, "b", 1)]


def test_spelling_alignment():
    assert K.spelling_alignment("abc", "axc") == [("a", "a"), ("b", "x"), ("c", "c")]
    assert K.spelling_alignment("ab", "abc") == [("a", "a"), ("b", "b"), (K.GAP, "c")]
    assert K.spelling_alignment("", "") == []


def test_letter_phoneme_alignment_shares_doubled_phonemes():
    mapping = {"b": ["b"], "t": ["t"]}
    assert K.letter_phoneme_alignment("bt", "b a t t", mapping) == [("b", "b"), (K.GAP, "a"), ("t", "t"), ("t", "t")]


@given(st.text("abc ", max_size=8), st.text("abc ", max_size=8))
def test_weighted_distance_properties(a, b):
    distance = K.WeightedDistance({})
    assert distance(a, a, "X", "X")["distance_before"] == 0
    assert 0 <= distance(a, b, "X", "Y")["normalized"] <= 1


@given(st.text("abc", max_size=7), st.text("abc", max_size=7))
def test_alignment_spells_both_sides(a, b):
    pairs = K.spelling_alignment(a, b)
    assert "".join(s for s, _ in pairs if s != K.GAP) == a and "".join(t for _, t in pairs if t != K.GAP) == b


def test_weighted_distance_takes_off_words_and_affixes():
    out = K.WeightedDistance({})("the walk", "walk", "X", "Y")
    assert out["removed_src"] == ["the"] and out["normalized"] == 0
    plain = K.WeightedDistance({})("walks", "walk", "X", "Y")
    freed = K.WeightedDistance({}, suffixes={"X": {("X", "s")}})("walks", "walk", "X", "Y")
    assert plain["normalized"] == 0.2 and freed["normalized"] == 0 and freed["tokenized_src"] == "walk#s"


def test_substitution_costs(spark):
    cond = spark.createDataFrame(
        [("X", "q", "k", 0.5, True, 0, 2), ("X", "k", "k", 0.5, True, 0, 2), ("Y", "k", "k", 1.0, True, 0, 1), ("X", "-1", "k", 0.25, False, 0, 0)],
        "dialect string, coda string, caphi string, p_coda_given_caphi double, default_mapping boolean, etym_count int, total int",
    )
    phon = spark.createDataFrame([("X", "q", "k", 1.0), ("X", "k", "k", 1.0), ("Y", "k", "k", 1.0)], "dialect string, letter string, caphi string, p double")
    raw = spark.createDataFrame([("X", "-1", "q", 0.1)], "dialect string, raw string, coda string, p_raw_given_coda double")
    alphabet = spark.createDataFrame([("q",), ("k",)], "coda string")
    asked = [("q", "X", "k", "Y"), ("q", "X", "q", "X"), ("z", "X", "k", "Y"), ("q", "X", "-1", "X"), ("-1", "CODA", "q", "X"), ("q", "CODA", "-1", "X"), ("q", "CODA", "k", "X"), ("k", "X", "q", "CODA")]
    req = spark.createDataFrame(asked, "l1 string, d1 string, l2 string, d2 string")
    rows = {(r.l1, r.d1, r.l2, r.d2): r.cost for r in C.substitution_costs(req, cond, phon, raw, alphabet).collect()}
    assert [rows[a] for a in asked] == pytest.approx([0.5, 0.0, 1.0, 0.75, 0.75, 0.9, 0.5, 0.5])


def test_splits_are_stable_and_complete(spark):
    df = spark.range(200).withColumn("g", F.col("id") % 3)
    a, b = (S.stratified_split(df, "g", "id").orderBy("id").collect() for _ in range(2))
    assert a == b and 0.85 < sum(r.split == "train" for r in a) / 200 < 0.92
    picked = S.sample_per_group(df, ["g"], "id").groupBy("g").count().collect()
    assert len(picked) == 3 and all(1 <= r["count"] <= 2 for r in picked)


def test_sources(spark, tmp_path):
    (tmp_path / "pairs").write_text("0-0 1-1\n0-1\n2-2\n")
    (tmp_path / "ids").write_text("7\tBEI\n8\tCAI\n7\tBEI\n")
    rows = {(r.row_idx, r.variety): [tuple(p) for p in r.pairs] for r in T.read_alignments(spark, str(tmp_path / "pairs"), str(tmp_path / "ids")).collect()}
    assert rows == {(7, "BEI"): [(2, 2)], (8, "CAI"): [(0, 1)]}
    (tmp_path / "l").write_text("a\nb\n\nc\n")
    found = T.read_paired_blocks(spark, str(tmp_path / "l"), str(tmp_path / "l")).orderBy("sent_no", "pos").collect()
    assert [(r.sent_no, r.pos, r.raw) for r in found] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "c")]
    with pytest.raises(T.MissingColumns):
        T.require(spark.range(1), ["x"])
    df = spark.createDataFrame([('{"a": np.int64(3)}',)], "m string")
    assert T.read_json_map(df, "m").first().m == {"a": 3}


def test_letter_alignments_keep_the_word_and_its_spelling(spark):
    rows = [
        ("bt", "X", 1, [("b", "b"), ("-1", "a"), ("t", "t"), ("t", "t")]),
        ("bt", "Y", 1, [("b", "p"), ("t", "d")]),
        ("bt", "Y", 2, [("b", "v")]),
        ("", "X", 1, [("b", "b")]),
        (None, "X", 1, [("b", "b")]),
        ("q", "X", 1, []),
    ]
    frame = spark.createDataFrame(rows, "coda string, dialect string, ord int, pairs array<struct<src:string,tgt:string>>")
    found = {(r.coda, r.position): (r.letter, r.by_dialect) for r in K.merge_letter_alignments(frame).collect()}
    assert found == {("bt", 0): ("b", {"X": "b", "Y": "v"}), ("bt", 1): ("t", {"X": "t", "Y": "d"})}


def test_score_table_has_both_corpora(spark):
    rows = [("w", "a", "b", 0.0, 0.2), ("w", "a", "z", 1.0, 1.0), ("v", "b", "a", 0.5, 0.5)]
    frame = spark.createDataFrame(rows, "word string, grp string, tgt_grp string, d_min double, d_soft double")
    found = {r.word: r for r in G.score_table(frame, ["a", "b"], ["z"]).collect()}
    gate = lambda d, t: 1 / (1 + math.exp(-20 * (t - d)))
    assert (found["w"].corpus, found["v"].corpus, found["v"].min_t_0_5_k_20_c26) == (26, 6, None) and len(found["w"]) == 15
    assert found["w"].min_t_0_5_k_20_c6 == pytest.approx((gate(0, 0.5) * 2) / 2)
    assert found["w"].softmax_t_0_3_k_20_c26 == pytest.approx((gate(0, 0.3) + gate(0.2, 0.3) + gate(1, 0.3)) / 3)
    assert found["v"].min_t_0_4_k_20_c6 == pytest.approx((gate(0, 0.4) + gate(0.5, 0.4)) / 2)


def test_line_numbers_follow_the_file(spark, tmp_path):
    lines = [f"line {k} " + "x" * (k % 50) for k in range(5000)]
    (tmp_path / "a.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        found = T.numbered_lines(spark, str(tmp_path / "a.txt")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r.value for r in sorted(found)] == lines and [r.line_no for r in sorted(found)] == list(range(5000))


def test_alignment_maps_of_long_texts(spark):
    """Time in proportion to a text's length: a walk that copies what it has gathered at each pair takes minutes here."""
    began, n = time.time(), 40000
    pairs = F.transform(F.sequence(F.lit(n - 1), F.lit(0)), lambda i: F.struct(F.floor(i / 2).alias("src"), (i % 2 * 3).alias("tgt")))
    found = spark.range(1).select(F.map_entries(A.one_to_many(pairs)).alias("m")).first().m
    assert [(e.key, list(e.value)) for e in found] == [(k, [0, 3]) for k in range(n // 2)]
    assert time.time() - began < 30


def test_letter_evidence_walks_the_letters_once(spark):
    rows = [("bt", "X", 1, [("b", "B"), ("t", "T")]), ("bt", "Y", 1, [("b", "b"), ("t", "T")]), ("bb", "X", 1, [("b", "B"), ("b", "b")])]
    frame = spark.createDataFrame(rows, "coda string, dialect string, ord int, pairs array<struct<src:string,tgt:string>>")
    merged = K.merge_letter_alignments(frame)
    usual = lambda letter, caphi: caphi == F.upper(letter)
    own = C.own_letter_evidence(merged, usual)
    heard = merged.select("letter", F.explode("by_dialect").alias("dialect", "caphi"))
    defaults = heard.where(usual(F.col("letter"), F.col("caphi"))).select("letter", "caphi").distinct()
    want = C.letter_evidence(merged, defaults, heard.select("dialect", "letter", "caphi").distinct())
    order = ["dialect", "letter", "caphi", "phon_count", "etym_count", "total"]
    assert sorted(map(tuple, own.select(order).collect())) == sorted(map(tuple, want.select(order).collect()))
    assert ("X", "b", "B", 2, 1, 3) in [tuple(r) for r in own.select(order).collect()]
    assert own._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD") == 1
    assert {(r.coda, r.position): r.by_dialect for r in K.merge_letter_alignments(frame.withColumn("ord", F.lit(None).cast("int"))).collect()}["bb", 0] == {"X": None}
