"""The corpus operators against brute force, round trips and edge cases."""

import hashlib
import html
import math
import re
import struct
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from koinea.llm import bm25, html_text, iblt, langid, licenses, linededup, lm, minhash, mixing, sentencepieces

LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def documents(spark, texts, schema=SCHEMA):
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def corpus(n=60, seed=3):
    draw = np.random.default_rng(seed)
    base = [" ".join(f"w{x}" for x in draw.integers(0, 400, 80)) for _ in range(n // 3)]
    out = []
    for b in base:
        out.append(b)
        w = b.split()
        for edits in (1, 9):
            own = list(w)
            for p in draw.integers(0, len(w), edits):
                own[p] = f"e{draw.integers(0, 50)}"
            out.append(" ".join(own))
    return out


EDGES = ["", None, "   \n\t ", "One", "one two", "ONE two", "x" * 5000, "äß 漢字 \U0001f600 a", "a\n" * 50, "same line here\n" * 40]


@pytest.fixture(scope="module")
def odd(spark):
    """Edge texts with a repeated row, a null id, and columns with clashing names."""
    rows = [(i, t, None, None, None) for i, t in enumerate(EDGES)] + [(3, "One", None, None, None), (None, "one two", "en", "s", 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in ("id", "component", "copies", "size", "target", "k1", "bucket", "score", "n_lines", "lang_pred", "host")})


def components(texts, n, up, down):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and both * down >= up * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_near_duplicates_match_brute_force(spark):
    texts = corpus() + ["Same Text again", "same text AGAIN", "", None, "one", "one two"]
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts), ngram=3, similarity=(85, 100)).collect()}
    assert found == components(texts, 3, 85, 100)


def test_large_crowds_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL_BUCKET", 2)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    draw = np.random.default_rng(1)
    base = [f"w{x}" for x in range(120)]
    texts = []
    for k in range(45):
        own = list(base)
        for p in draw.integers(0, 120, 1 + k % 12):
            own[p] = f"e{draw.integers(0, 9)}"
        texts.append(" ".join(own))
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(documents(spark, texts), ngram=3, similarity=(85, 100)).collect()}
    assert found == components(texts, 3, 85, 100)


def test_least_matches_keep_the_miss_bound():
    steps = minhash.least_matches(210, 30, 0.85, 1e-6)
    assert steps[-1][0] == 210 and all(m < 0.85 * n for n, m in steps)
    n, m = steps[0]
    missed = sum(math.comb(n, x) * 0.85**x * 0.15 ** (n - x) for x in range(m))
    assert missed < 1e-5


def test_language_id_held_out_accuracy_and_rejection(spark):
    draw = np.random.default_rng(0)
    stems = {"aa": ["kala", "mino", "tavu"], "bb": ["strom", "wicht", "pfau"]}
    rows = [(i, " ".join(draw.choice(stems[g], 20)), g, "s", 0) for i, g in enumerate(["aa", "bb"] * 60)] + [(500, "123 !!", None, "s", 0), (501, None, None, "s", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    held = langid.held_out(F.col("doc_id"), 4)
    out = {r.doc_id: r for r in langid.identify(docs, learn=~held).collect()}
    assert all(out[i].lang_pred == g for i, _, g, _, _ in rows[:120] if zlib.crc32(str(i).encode()) % 4 == 2)
    assert {(out[i].lang_pred, out[i].score, out[i].accepted) for i in (500, 501)} == {("und", 0.0, False)}


def test_sentencepiece_parity_and_round_trip(spark):
    texts = ["Hello  world", " a", "", None, "äß 漢字 \U0001f600", "tab\tnew\nline", "<s> </s>"]
    rows = sentencepieces.encode(documents(spark, texts)).orderBy("doc_id").collect()
    assert all(r.parity and r.round_trip for r in rows)
    back = sentencepieces.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in rows], "doc_id long, ids array<int>"))
    assert [r.text for r in back.orderBy("doc_id").collect()] == [t or "" for t in texts]


def test_decoding_of_spelled_markers_and_any_ids(spark):
    own = sentencepieces.codec(sentencepieces.model_bytes())
    model, tokenizer = own.model, own.tokenizer
    place = {p[0]: i for i, p in enumerate(model.pieces)}
    mark = [place[f"<0x{b:02X}>"] for b in "▁".encode()]
    draw = np.random.default_rng(1)
    lists = [mark, [place["▁"], *mark, place["▁"]], [], [place["▁"]] * 2, mark[1:], *draw.integers(3, 32000, (40, 30)).tolist()]
    frame = spark.createDataFrame(list(enumerate(lists)), "doc_id long, ids array<int>")
    rows = sentencepieces.decode(frame).orderBy("doc_id").collect()
    assert [r.text for r in rows] == tokenizer.decode_batch(lists, skip_special_tokens=False)
    assert rows[0].text == "▁"


def unigram_bytes(pieces, bytes_too=False):
    """A serialised unigram model; no tokenizer is trained."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(number, payload):
        return varint(number << 3 | 2) + varint(len(payload)) + payload

    def flag(number, value):
        return varint(number << 3) + varint(value)

    def piece(text, score, kind):
        return message(1, message(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + flag(3, kind))

    rows = [("<unk>", 0.0, 2), *pieces, *[(f"<0x{b:02X}>", -20.0, 6) for b in range(256) if bytes_too]]
    spec = message(2, flag(3, 1) + (flag(35, 1) if bytes_too else b"")) + message(3, message(1, b"identity") + flag(3, 1) + flag(4, 0) + flag(5, 1))
    return b"".join(piece(*r) for r in rows) + spec


def test_unigram_models_are_rebuilt():
    pieces = [("▁a", -1.0, 1), ("b", -2.0, 1), ("▁ab", -1.5, 1)]
    model = sentencepieces.parse_model(unigram_bytes(pieces))
    assert [p[0] for p in model.pieces] == ["<unk>", *[p[0] for p in pieces]] and model.kind == 1
    assert sentencepieces.build_tokenizer(model).encode("ab a").tokens == ["▁ab", "▁a"]


@pytest.mark.parametrize("across", [False, True])
def test_unigram_models_agree_with_sentencepiece(spark, across):
    draw = np.random.default_rng(4)
    found = {x: float(-draw.uniform(2, 6)) for x in [*"abcdé", "▁"]}
    while len(found) < 120:
        found["".join(draw.choice([*"abcdé", "▁"] if across else [*"abcdé"], draw.integers(2, 5)))] = float(-draw.uniform(2, 9))
        found["▁" + "".join(draw.choice([*"abcdé"], draw.integers(1, 4)))] = float(-draw.uniform(2, 9))
    data = unigram_bytes([(x, s, 1) for x, s in found.items()], bytes_too=True)
    texts = ["".join(draw.choice([*"abcdé  zx"], draw.integers(1, 60))) for _ in range(200)] + ["", " ", "  a", "a  ", None, "▁a ▁"]
    rows = sentencepieces.encode(documents(spark, texts), model=data).orderBy("doc_id").collect()
    engine = sentencepiece.SentencePieceProcessor(model_proto=data)
    assert sentencepieces.codec(data).by_word != across
    assert all(r.parity for r in rows)
    assert [r.ids for r in rows] == engine.encode([t or "" for t in texts])
    assert all(r.round_trip for r, t in zip(rows, texts) if "▁" not in (t or ""))


def test_parity_finds_other_ids(monkeypatch):
    encoder = sentencepieces.Encoder(sentencepieces.model_bytes())
    monkeypatch.setattr(encoder, "WORDS", 3)
    check = encoder.check
    texts = ["one two", "two  three", "", None, "a b one d", "three"]

    class Other:
        def encode(self, texts, num_threads):
            return [[7, *x] if "one" in t or "  " in t else x for t, x in zip(texts, check.encode(texts))]

    for _ in range(2):
        flat, at, same = encoder.encode(pa.array(texts))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == check.encode([t or "" for t in texts]) and same.all()
    encoder._clear()
    encoder.check = Other()
    assert encoder.encode(pa.array(texts))[2].tolist() == [False, False, True, True, False, True]


def page(body, menu="Home"):
    return f'<html><head><title>t</title><script>var x="</p>";</script></head><body><nav><li>{menu}</li></nav><div class="ad">Buy</div>{body}<div class="comments">first!</div><footer>(c)</footer></body></html>'


def test_html_extraction(spark):
    rows = [(i, f"http://h{i % 2}.org/{i}", page(f"<article><h1>T{i}</h1><p>One &amp; <b>tw</b>o\n {i}<p>three<aside>x</aside></article>", f"m{i}")) for i in range(6)]
    rows += [(7, None, None), (8, "http://h1.org/8", ""), (9, "http://h0.org/cut", "<body><article><p>cut off"), (10, "http://x.org", page('<div class="story"><p>Plain text of some length.</p></div>'))]
    out = {r.page_id: r for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(out[i].text == f"T{i} One & two {i} three" for i in range(6))
    assert out[7].text == out[8].text == "" and out[9].text == "cut off" and out[10].text == "Plain text of some length."
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_wrapper_has_slots_optional_and_repeated_groups():
    pages = ["<ul><li>a</li><li>b</li></ul><div>same</div>", "<ul><li>c</li></ul><hr><div>same</div><section>more</section>"]
    for order in (pages, pages[::-1]):
        wrapper = html_text.tree(html_text.skeleton(order[0]))
        wrapper.add(html_text.tree(html_text.skeleton(order[1])))
        assert wrapper.expression() == "<page><ul>(<li>#</>)+</><div>.</>(<section>.</>)?</>"


STORY = "Plain text number {0} of the story, with some more words {0}."


def host_pages(wrap, n=5, host="one.org"):
    return [(i, f"http://{host}/{i}", wrap(i)) for i in range(n)]


def extracted(spark, rows):
    return {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_names_that_only_contain_a_mark_stay(spark):
    parts = "".join(f'<div class="{c}">Part {c} of {{0}}</div>' for c in ("related-work", "search-for-truth", "alert-levels"))
    out = extracted(spark, host_pages(lambda i: f'<body class="no-sidebar"><article class="post comments-open"><p>{STORY.format(i)}</p>{parts.format(i)}</article></body>'))
    assert all(out[i] == f"{STORY.format(i)} Part related-work of {i} Part search-for-truth of {i} Part alert-levels of {i}" for i in range(5))


def test_regions_without_known_names(spark):
    def wrap(i):
        return f"<body><div class=top><a href=/>Home</a> <a href=/b>More of this</a></div><div class=x><div class=y><h2>Head {i}</h2><p>{STORY.format(i)}<p>{STORY.format(i + 50)}<div class=box>Join our list today</div></div><div class=z>Word {i}</div></div><div class=low>All rights</div></body>"

    out = extracted(spark, host_pages(wrap) + [(9, "http://alone.org", wrap(9))])
    assert all(out[i] == f"Head {i} {STORY.format(i)} {STORY.format(i + 50)}" for i in range(5))
    assert STORY.format(9) in out[9] and "Home" not in out[9] and "All rights" not in out[9]


def test_copies_of_one_page_keep_their_text(spark):
    def wrap(i):
        return f"<body><nav>Menu</nav><div class=c><p>{STORY.format(0)}</p><section>{STORY.format(7)}</section></div><p>{'' if i else 'x'}</p></body>"

    out = extracted(spark, host_pages(wrap, 6))
    assert all(STORY.format(0) in t and STORY.format(7) in t and "Menu" not in t for t in out.values())


def test_pages_match_their_articles_cut_by_hand(spark):
    """Precision and recall of words on generated pages, whose article is what stands between its tags."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    out = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)
        want = html.unescape(re.sub(r"<[^>]*>", " ", inner.group(1))).split() if inner else []
        assert out[r.page_id].split() == want


def test_pages_in_any_order_and_odd_rows(spark):
    rows = host_pages(lambda i: page(f"<article><h1>T</h1><p>{STORY.format(i)}</p></article>"), 20, "many.org")
    rows += [(50, None, "<p>no host</p>"), (51, "http://many.org/51", None), (52, "", "<<<>>> <p"), (3, "http://many.org/3", rows[3][2])]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("clash") for c in ("host", "region", "same", "text", "path")})
    first, second = (sorted(map(tuple, html_text.extract_text(f).collect())) if f else None for f in (frame.coalesce(1), frame.orderBy(F.desc("html")).repartition(3)))
    assert len(first) == len(rows) and first == second
    assert dict((r[0], r[2]) for r in first)[51] == "" and dict((r[0], r[2]) for r in first)[50] == "no host"


def paragraphs(text):
    return {p.strip(" ") for p in re.findall(iblt.PARAGRAPH, text) if p.strip(" ")}


def test_fingerprints_match_brute_force(spark):
    draw = np.random.default_rng(2)
    lines = [f"line number {k}" for k in range(3000)]
    prose = " ".join(" ".join(f"w{x}" for x in draw.integers(0, 400, 9)) + "." for _ in range(40))
    texts = ["\n".join(draw.choice(lines, n)) for n in (3, 1, 40, 200, 8, 8, 25)] + [None, "", "ab", "\n".join(lines), "\n".join(lines[5:]), prose, prose.replace(".", "")]
    texts.append(texts[0])
    out = {r.doc_id: r for r in iblt.fingerprints(documents(spark, texts)).collect()}

    def likeness(a, b):
        a, b = paragraphs(a), paragraphs(b)
        return len(a & b) / len(a | b) if a | b else 1.0

    for i, t in enumerate(texts):
        t, follower = t or "", texts[(i + 1) % len(texts)] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + follower[:half]
        assert out[i].near_edited == pytest.approx(likeness(t, edited)) and out[i].near_next == pytest.approx(likeness(t, follower))
        assert (out[i].n_chars, out[i].edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
    assert out[0].fingerprint == out[len(texts) - 1].fingerprint != out[2].fingerprint
    assert out[12].near_edited > 0.2 and out[13].near_edited > 0.2


def test_peeling_recovers_the_digests_that_differ(spark):
    rows = [([1, 2, 3, 4, 5], [4, 5, 6]), ([7], [7]), (list(range(100)), list(range(40)))]
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>").select(*[iblt.checked(F.col(c)).alias(c) for c in "ab"])
    cells = frame.select("a", "b", iblt.table(F.col("a")).alias("x"), iblt.table(F.col("b")).alias("y"))
    found = cells.select(iblt.peel(iblt.subtract(F.col("x"), F.col("y"))).alias("p"), iblt.larger_difference(F.col("a"), F.col("b")).alias("n")).collect()
    assert {(c.k, c.n) for c in found[0].p} == {(1, 1), (2, 1), (3, 1), (6, -1)} and found[1].p == [] and found[2].p is None
    assert [r.n for r in found] == [4, 0, 60]


def test_top_k_matches_brute_force(spark):
    texts = corpus(30) + ["", None]
    docs = documents(spark, texts)
    found = bm25.top_k(docs, docs.where("doc_id % 5 = 0").withColumnRenamed("doc_id", "query_id"), k=4, shard_bytes=2000, slice_terms=100)
    tokens = [Counter(words(t)) for t in texts]
    n, average = len(texts), sum(sum(t.values()) for t in tokens) / len(texts)
    df = Counter(w for t in tokens for w in t)
    want = {}
    for q in range(0, n, 5):
        scores = []
        for d, t in enumerate(tokens):
            s = sum(c * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / average)) for w, c in tokens[q].items() if w in t)
            if s > 0:
                scores.append((-round(s, 9), d))
        want |= {(q, r + 1): d for r, (_, d) in enumerate(sorted(scores)[:4])}
    assert {(r.query_id, r.rank): r.doc_id for r in found.collect()} == want


def test_blocks_are_skipped_and_results_stay_exact():
    draw = np.random.default_rng(8)
    texts = []
    for k in range(900):
        own = [f"{'abc'[k % 3]}{x}" for x in draw.zipf(1.3, 60) if x < 10**6] + [f"own{k // 3}"] * 2
        texts.append(" ".join(own))
    table = pa.table({"doc_id": pa.array(range(900), pa.int64()), "text": texts})

    class Context:
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    bm25.TaskContext, kept = type("T", (), {"get": staticmethod(lambda: Context)}), bm25.TaskContext
    try:
        row = next(iter(bm25._indexer(1 << 30)(iter(table.to_batches())))).to_pylist()[0]
    finally:
        bm25.TaskContext = kept
    tokens = [Counter(words(t)) for t in texts]
    average = sum(sum(t.values()) for t in tokens) / 900
    shard = bm25.Shard(row, average)
    df = Counter(w for t in tokens for w in t)
    idf = {w: math.log(1 + (900 - n + 0.5) / (n + 0.5)) for w, n in df.items()}

    def key(w):
        return bm25.K.words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]))[0][0]

    queries = []
    for q in range(0, 900, 7):
        pairs = sorted((key(w), c * idf[w]) for w, c in tokens[q].items())
        queries.append((np.array([p[0] for p in pairs], np.uint64), np.array([p[1] for p in pairs])))
    floors = np.zeros(len(queries))
    found = shard.search(queries, floors, 3)
    for n, q in enumerate(range(0, 900, 7)):
        scores = []
        for d, t in enumerate(tokens):
            s = sum(c * idf[w] * t[w] * 2.2 / (t[w] + 1.2 * (0.25 + 0.75 * sum(t.values()) / average)) for w, c in tokens[q].items() if w in t)
            scores.append((-round(s, 9), d))
        assert [d for _, d in sorted(scores)[:3]] == found[n][0].tolist()
    assert shard.skipped > 0 and shard.scored < 900 * len(queries) / 4


def languages(n, seed=3):
    """n texts of four invented languages in turn, each with its own words, the commonest first."""
    draw = np.random.default_rng(seed)
    return [" ".join(f"{'abcd'[k % 4]}{x}" for x in draw.zipf(1.25, 80) if x < 10**5) for k in range(n)]


def test_shards_hand_on_only_what_may_enter(spark, monkeypatch):
    frames, written = [], bm25.written
    monkeypatch.setattr(bm25, "written", lambda df: frames.append(written(df)) or frames[-1])
    docs = documents(spark, languages(960)).repartition(12, "doc_id")
    queries = docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")
    whole = {(r.query_id, r.rank): r.doc_id for r in bm25.top_k(docs.coalesce(1), queries, k=5).collect()}
    frames.clear()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):  # each shard in a task of its own
        spark.conf.set(name, "1k")
    try:
        found = {(r.query_id, r.rank): r.doc_id for r in bm25.top_k(docs, queries, k=5).collect()}
    finally:
        for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
            spark.conf.unset(name)
    assert found == whole and len(found) == 48 * 5
    assert sum(f.count() for f in frames if "score" in f.columns) < 48 * 5 * 12 * 0.6  # each shard has five for each query


def test_long_regular_words_have_their_own_hashes():
    a, b = "a", "b"
    for _ in range(12):
        a, b = a + b, b + a
    data = np.frombuffer((a + " " + b + " " + a.upper()).encode(), np.uint8)
    hashes, first = bm25.K.words(data, np.array([0, len(data)]))
    assert hashes[0] == hashes[2] != hashes[1]


def test_a_text_longer_than_a_segment_keeps_its_words():
    text = " ".join(f"word{k % 977}" for k in range(450_000))
    data = np.frombuffer(("x y " + text + " z").encode(), np.uint8)
    hashes, first = bm25.K.words(data, np.array([0, 4, len(data)]))
    assert first.tolist() == [0, 2, 450_003] and len(np.unique(hashes)) == 980


def test_line_dedup_deletes_later_runs_only(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    run = "\n".join(f"short line {k} with some more words in it" for k in range(8))
    texts = [f"intro one\n{passage}\nend one", f"intro two\n{passage}\nend two", f"start\n{run}\nstop", f"other\n{run}\nlast", "clean text\nshort line 3 with some more words in it", "again and again it says\n" * 30]
    out = {r.doc_id: r for r in linededup.dedupe_lines(documents(spark, texts)).collect()}
    assert out[0].text == texts[0] and out[2].text == texts[2] and out[4].text == texts[4]
    assert out[1].text == "intro two\nend two" and out[3].text == "other\nlast"
    assert out[5].text.count("again and again") == 1
    assert out[1].deleted_words == 60 and out[1].n_deleted == 1


def brute_force_line_dedup(texts, least=50):
    """(text, deleted lines) by comparing all passages of all documents."""
    split = [[x.strip(" ") for x in t.split("\n")] if t is not None else [] for t in texts]
    sizes = [[len(WORD.findall(x)) for x in lines] for lines in split]
    out = []
    for d, lines in enumerate(split):
        full = [i for i, n in enumerate(sizes[d]) if n]
        repeated = {i for i in range(len(lines)) if lines[i] in lines[:i] or not sizes[d][i]}
        for other in range(d):
            theirs = [x for x, n in zip(split[other], sizes[other]) if n]
            for a in range(len(full)):
                for b in range(len(theirs)):
                    k = total = 0
                    while a + k < len(full) and b + k < len(theirs) and lines[full[a + k]] == theirs[b + k]:
                        total += sizes[d][full[a + k]]
                        k += 1
                    if total >= least:
                        repeated |= set(range(full[a], full[a + k - 1] + 1))
        gone, at = set(), 0
        while at < len(lines):
            end = at
            while end < len(lines) and end in repeated:
                end += 1
            if sum(sizes[d][at:end]) >= least:
                gone |= set(range(at, end))
            at = max(end, at + 1)
        raw = texts[d].split("\n") if texts[d] is not None else []
        out.append((None if texts[d] is None else "\n".join(x for i, x in enumerate(raw) if i not in gone), len(gone), sum(sizes[d][i] for i in gone)))
    return out


def test_line_dedup_matches_brute_force(spark):
    rng = np.random.default_rng(9)
    pool = [f"line {k} " + " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(1, 25))) for k in range(25)] + ["", "  ", "short"]
    texts = ["\n".join(rng.choice(pool, rng.integers(1, 25))) for _ in range(25)]
    for _ in range(15):
        source = texts[rng.integers(0, len(texts))].split("\n")
        a = rng.integers(0, len(source))
        texts.append("\n".join([*rng.choice(pool, 3), *source[a : a + 9], *rng.choice(pool, 2)]))
    texts += [None, "", texts[0]]
    out = {r.doc_id: r for r in linededup.dedupe_lines(documents(spark, texts)).collect()}
    want = brute_force_line_dedup(texts)
    assert [(out[i].text, out[i].n_deleted, out[i].deleted_words) for i in range(len(texts))] == want
    assert sum(n for _, n, _ in want) > 50


def test_line_dedup_ends_on_a_document_of_many_lines(spark):
    texts = ["\n".join(f"line {k % 90_000}" for k in range(100_000)), "\n".join(f"line {k}" for k in range(50_000, 60_000))]
    out = {r.doc_id: r for r in linededup.dedupe_lines(documents(spark, texts)).collect()}
    assert (out[0].n_deleted, out[1].n_deleted, out[1].text) == (10_000, 10_000, "")


def line_texts(rng, n, size, tag):
    return [" ".join(f"{tag}{x}" for x in rng.integers(0, 10**6, size)) for _ in range(n)]


def test_line_dedup_finds_passages_of_two_or_three_lines(spark):
    rng, texts = np.random.default_rng(5), []
    for k in range(60):
        shared = line_texts(rng, *((2, 30) if k % 2 else (3, 20)), "s")
        for side in "ab":
            texts.append("\n".join(line_texts(rng, 3, 12, side) + shared + line_texts(rng, 3, 12, side)))
    out = {r.doc_id: r for r in linededup.dedupe_lines(documents(spark, texts)).collect()}
    assert all(out[i].n_deleted == 0 for i in range(0, 120, 2))
    assert all(out[i].n_deleted == (2 if i // 2 % 2 else 3) and out[i].deleted_words == 60 for i in range(1, 120, 2))


def test_line_dedup_finds_every_holder_and_lines_between_common_ones(spark):
    rng = np.random.default_rng(6)
    common, texts = [f"common line {k}" for k in range(40)], []
    texts.append("\n".join(common))
    for k in range(40):
        shared = line_texts(rng, 6, 11, "s")
        shared.insert(3, common[k])
        texts += ["\n".join(line_texts(rng, 2, 9, side) + shared + line_texts(rng, 2, 9, side)) for side in "ab"]
    for mark in ("#", "Reply", "Read more"):
        shared = [x for line in line_texts(rng, 6, 15, "s") for x in (line, mark)]
        texts += ["\n".join([mark] + line_texts(rng, 3 if side == "a" else 5, 9, side) + shared + line_texts(rng, 2, 9, side)) for side in "ab"]
    out = {r.doc_id: r for r in linededup.dedupe_lines(documents(spark, texts)).collect()}
    for i in range(1, len(texts), 2):
        assert out[i].text == texts[i]
        deleted = "\n".join(texts[i + 1].split("\n")[-2:])
        assert out[i + 1].text.endswith(deleted) and out[i + 1].n_deleted == (7 if i < 81 else 12)


def test_lm_scores_match_brute_force(spark):
    texts = corpus(60) + ["", None, "unseen Word"]
    out = {r.doc_id: r for r in lm.score_texts(documents(spark, texts), block_bytes=3000).collect()}
    tokens = [[*words(t), None] for t in texts]
    learned = [t for i, t in enumerate(tokens) if zlib.crc32(str(i).encode()) % 7 != 2]
    c = Counter(w for t in learned for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(tokens):
        assert out[i].base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t))
        assert (out[i].n_tokens, out[i].n_known, out[i].train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert out[i].score < 0 and math.isfinite(out[i].score)


def test_em_weights_favour_the_better_estimate():
    cell = (3 * lm._LEVELS + lm._LEVELS - 2) * lm._LEVELS + 1
    weights = lm.fit_weights([(cell, 1000)], 100)
    assert weights[3, 0] > 0.9 and np.allclose(weights.sum(axis=1), 1)


def test_mixing_nears_targets_and_reruns_agree(spark):
    rows = [(i, "w " * (1 + i % 7), "en", f"s{min(i % 5, 3)}" if i % 11 else None, 0) for i in range(600)]
    docs = spark.createDataFrame(rows, SCHEMA)
    plan = mixing.mix_plan(docs).select("doc_id", "source", "size", "source_size", "target", "copies").collect()
    taken, target = Counter(), {}
    for r in plan:
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
        assert r.copies <= 3 and r.target <= 3 * r.source_size + 1e-9
    assert sum(target.values()) == pytest.approx(sum(r.size for r in plan))
    assert all(abs(taken[s] - t) <= 0.25 * t + 5 for s, t in target.items())
    mixed = mixing.mix_sources(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in plan)


def test_license_templates_are_found(spark):
    grant = next(t for k, t in licenses.TEMPLATES if k == "isc")
    texts = ["x\nReleased under the MIT License.\ny", "licensed under CC BY NC 4 0 by us", "MIT\nlicense", "the apache license and the General Public License", "plain under the by"]
    texts += [grant[:60] + "\n" + grant[60:], "x " * 500 + grant + " y" * 500, ("pad " * 40).join(grant.split(" "))]
    out = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts)).collect()}
    assert (out[0].labels, out[0].n_base, out[0].first_word) == ("mit", 1, 4)
    assert (out[1].labels, out[1].base_labels, out[1].n_base, out[1].first_word) == ("cc-by-nc", "", 0, None)
    assert out[2].base_labels == "mit" and out[3].base_labels == "apache,gpl" and out[3].last_word == 5
    assert (out[4].labels, out[4].score) == ("", 0.0)
    assert (out[5].labels, out[6].labels, out[7].labels) == ("isc", "isc", "")


def test_license_blocks_match_brute_force(spark):
    draw = np.random.default_rng(11)
    templates = (("a", "one two three four five six seven"), ("b", "three rare words of five"), ("c", "one one two two three"))
    pool = ["one", "two", "three", "four", "five", "six", "seven", "rare", "words", "of", "x", "y", "z\n"]
    texts = [" ".join(draw.choice(pool, draw.integers(1, 60))) for _ in range(200)] + ["", None]
    out = {r.doc_id: r for r in licenses.scan_licenses(documents(spark, texts), templates=templates, threshold=(7, 10)).collect()}
    for i, t in enumerate(texts):
        w, labels, score = re.findall(r"[a-z]+", t or ""), set(), 0.0
        for label, text in templates:
            own, long = set(text.split()), licenses.longest_block(text)
            best = max((len(own & set(w[k : k + long])) for k in range(len(w))), default=0)
            if best >= licenses.needed(text, (7, 10)):
                labels.add(label)
                score = max(score, best / len(own))
        assert (out[i].labels, out[i].score) == (",".join(sorted(labels)), pytest.approx(score))


OPERATORS = {
    "near_duplicates": minhash.near_duplicates,
    "identify": langid.identify,
    "encode": sentencepieces.encode,
    "fingerprints": iblt.fingerprints,
    "top_k": lambda d: bm25.top_k(d, d.where("doc_id is null or doc_id < 5").withColumnRenamed("doc_id", "query_id")),
    "dedupe_lines": linededup.dedupe_lines,
    "score_texts": lm.score_texts,
    "mix_plan": mixing.mix_plan,
    "mix_sources": mixing.mix_sources,
    "scan_licenses": licenses.scan_licenses,
}
WHOLE = {k for k in OPERATORS if k not in ("top_k", "mix_sources")}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_edge_texts_and_empty_tables(odd, name):
    n = OPERATORS[name](odd).collect()
    assert OPERATORS[name](odd.limit(0)).count() == 0
    if name in WHOLE:
        assert len(n) == len(EDGES) + 2


def test_empty_pages(spark):
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
