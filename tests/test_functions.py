"""Expressions against the golden values of FIXTURES.md."""

import math

import pytest
from pyspark.sql import functions as F

from koinea.functions import scoring as S
from koinea.functions import text as X


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def numbers(spark, rows):
    return spark.createDataFrame([tuple(map(float, r)) for r in rows], "d double, f double")


@pytest.mark.parametrize("d,t,want", [(0, 0.5, 0.9999546021312976), (0.25, 0.5, 0.9933071490757153), (0.5, 0.5, 0.5), (1, 0.5, 4.5397868702434395e-05), (0.25, 0.3, 0.7310585786300049), (0.25, 0.4, 0.9525741268224334)])
def test_gate(spark, d, t, want):
    assert one(spark, S.gate(F.lit(float(d)), t)) == pytest.approx(want, rel=1e-12)


def test_freq_softmax(spark):
    df = numbers(spark, [(0.2, 1), (0.5, 3)])
    low = F.lit(0.2)
    assert df.agg(S.freq_softmax(F.col("d"), F.col("f"), low).alias("x")).first().x == pytest.approx(0.3202936919108472, rel=1e-12)
    assert numbers(spark, [(0.2, 0)]).agg(S.freq_softmax(F.col("d"), F.col("f"), low).alias("x")).first().x is None
    assert numbers(spark, []).agg(S.freq_softmax(F.col("d"), F.col("f"), low).alias("x")).first().x is None


def test_gated_mean_counts_missing_slots(spark):
    df = numbers(spark, [(0.0, 0), (0.25, 0)])
    assert df.agg(S.gated_mean(F.col("d"), 0.5, 20, 6).alias("x")).first().x == pytest.approx(0.33224055711363715, rel=1e-12)


def test_means(spark):
    df = numbers(spark, [(0.9, 0), (0.3, 0), (0.6, 0)])
    assert df.where("d < 0.9").agg(S.harmonic_mean(F.col("d")).alias("x")).first().x == pytest.approx(0.4)
    assert df.agg(S.generalized_harmonic_mean(F.col("d")).alias("x")).first().x == pytest.approx(0.44538450604962826)
    assert [one(spark, S.power_scale(F.lit(v))) for v in (0.9, 0.5)] == pytest.approx([0.59049, 0.03125])


def test_mark_first(spark):
    assert one(spark, X.mark_first(F.lit("ab cab"), F.lit("ab"))) == "[TGT]ab[/TGT] cab"
    assert one(spark, X.mark_first(F.lit("cab ab"), F.lit("ab"))) == "c[TGT]ab[/TGT] ab"
    assert one(spark, X.mark_first(F.lit("xyz"), F.lit("ab"))) is None
    assert one(spark, X.mark_first_word(F.lit("cab ab ab"), F.lit("ab"))) == "cab [TGT]ab[/TGT] ab"
    assert one(spark, X.mark_first_word(F.lit("cab"), F.lit("ab"))) == "cab"


def test_word_filter(spark):
    df = spark.createDataFrame([(w,) for w in ("a", "12", "ab", "ab cd", "ab cd ef", None)], "w string")
    assert [r.x for r in df.select(X.is_word(F.col("w")).alias("x")).collect()] == [False, False, True, True, False, False]


def test_normalize(spark):
    assert one(spark, X.normalize_text(F.lit(" «أَهْلاً، إلى مدينـة!» "))) == "اهلا الي مدينه"
    assert one(spark, X.normalize_text(F.lit("إلى"), fold=False)) == "إلى"
    assert one(spark, X.normalize_text(F.lit(None).cast("string"))) is None
    assert one(spark, X.spoken_form(F.lit("a_b."))) == "a b"


def test_edit_share_and_affixes(spark):
    assert one(spark, X.edit_share(F.lit(""), F.lit(""))) == 0
    assert one(spark, X.edit_share(F.lit("ab"), F.lit("abcd"))) == 0.5
    assert one(spark, X.prefix_of(F.lit("walk"), F.lit("alk"))) == "w"
    assert one(spark, X.suffix_of(F.lit("walks"), F.lit("walk"))) == "s"
    assert one(spark, X.suffix_of(F.lit("walking on"), F.lit("walk"))) is None


def test_softmax_mean_is_between(spark):
    df = numbers(spark, [(x / 10, x + 1) for x in range(1, 9)])
    x = df.agg(S.freq_softmax(F.col("d"), F.col("f"), F.lit(0.1)).alias("x")).first().x
    assert 0.1 <= x <= 0.8 and not math.isnan(x)
