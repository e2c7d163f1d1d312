"""The pipeline's stages against brute force, each on its own input and one after another."""

from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm import EDGES, SCHEMA, brute_force_line_dedup, components

import corpus_pipeline
from koinea.llm import mixing, sentencepieces, stages

STEMS = {"aa": ["kala", "mino", "tavu", "selo"], "bb": ["strom", "wicht", "pfau", "junge"]}


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(21)

    def prose(lang, n):
        return " ".join("".join(draw.choice(STEMS[lang], 3)) for _ in range(n))

    shared = {g: "\n".join(prose(g, 15) for _ in range(5)) for g in STEMS}
    out = []
    for i in range(120):
        g = "ab"[i % 2] * 2
        text = "\n".join(prose(g, 14) for _ in range(4))
        if i % 6 == 5:
            text += "\n" + shared[g] + "\n" + prose(g, 8)
        out.append([i, text, g, f"s{i % 3}"])
    for i in range(0, 24, 3):  # near and exact copies
        w = out[i][1].split(" ")
        w[4] = w[4] + "x"
        out += [[200 + i, " ".join(w), out[i][2], "s1"], [300 + i, out[i][1], out[i][2], "s0"]]
    out += [[400, "123 456", "aa", "s0"], [401, None, "aa", None], [402, "", None, "s2"]]
    return [(i, t, g, s, len(t or "")) for i, t, g, s in out]


def test_stages_follow_their_contract():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "mixing sources to target weights", "SentencePiece encoding and decoding"]


def test_every_stage_matches_brute_force(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    first = stages.language(spark, docs, "")
    assert first.columns == docs.columns
    own = {r.doc_id: r for r in first.collect()}
    assert set(own) == {r[0] for r in rows if r[0] < 400} and all(own[r[0]].lang == r[2] and own[r[0]].text == r[1] for r in rows if r[0] < 400)

    second = stages.lines(spark, first, "")
    ids = sorted(own)
    want = {i: x for i, x in zip(ids, brute_force_line_dedup([own[i].text for i in ids])) if not x[1] or x[0].strip(" ")}
    got = {r.doc_id: r for r in second.collect()}
    assert {i: r.text for i, r in got.items()} == {i: x[0] for i, x in want.items()} and len(got) < len(own)
    assert all(r.n_chars == len(r.text) for r in got.values())

    third = stages.near_copies(spark, second, "")
    ids = sorted(got)
    groups = components([got[i].text for i in ids], 5, 80, 100)
    kept = {ids[k] for k, (_, c) in groups.items() if k == c}
    left = {r.doc_id: r for r in third.collect()}
    assert set(left) == kept and len(kept) < len(got) and all(left[i].text == got[i].text for i in kept)

    fourth = stages.mixture(spark, third, "")
    copies = {r.doc_id: r.copies for r in mixing.mix_plan(third).collect()}
    assert Counter(r.doc_id for r in fourth.collect()) == Counter({i: n for i, n in copies.items() if n})

    fifth = stages.tokens(spark, fourth, "").collect()
    engine = sentencepiece.SentencePieceProcessor(model_proto=sentencepieces.model_bytes())
    assert len(fifth) == sum(copies.values())
    assert all(r.ids == engine.encode(left[r.doc_id].text) and r.n_tokens == len(r.ids) and r.round_trip and r.parity for r in fifth)


def test_run_is_all_stages(spark, rows, tmp_path):
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    step = docs
    for _, stage in corpus_pipeline.STAGES:
        step = stage(spark, step, "")
    assert sorted((r.doc_id, r.n_tokens) for r in found) == sorted((r.doc_id, r.n_tokens) for r in step.collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[1:]])
def test_stages_take_odd_rows_and_empty_tables(spark, stage):
    rows = [(i, t, None, None, None) for i, t in enumerate(EDGES)] + [(3, "One", None, None, None), (None, "one two", "en", "s", 7)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("id", "ids", "copies", "_kept", "n_lines", "accepted")})
    out = stage(spark, docs, "").collect()
    assert stage(spark, docs.limit(0), "").count() == 0
    if stage is stages.lines:  # the repeated lines of 8 have too few words
        assert len(out) == len(rows)
    elif stage is stages.near_copies:  # "one two" and "ONE two" are copies
        assert len(out) == len(rows) - 1 and 5 not in {r.doc_id for r in out}
    elif stage is stages.tokens:
        assert {r.doc_id: r.n_tokens for r in out}[1] == 0 and all(r.parity and r.round_trip for r in out)
    assert stages.language(spark, docs.limit(0), "").count() == 0
