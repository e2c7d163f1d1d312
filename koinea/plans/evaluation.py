"""Queries on labels, vectors and samples: baselines, errors, top-p counts and deterministic splits."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from koinea.functions.scoring import rmse, sigmoid
from koinea.functions.text import spoken_form, tokens
from koinea.operators import sampling as S
from koinea.operators import training as TR
from koinea.operators.sentences import best_scores, lexicon_means, score_sentences, table_scorer
from koinea.plans.registry import query, table


def labelled(spark, d):
    """One label for each document with a split by lang."""
    l = table(spark, d, "labels").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    docs = table(spark, d, "documents").select("doc_id", "text", "lang", "n_chars")
    return docs.join(l, "doc_id").withColumn("split", F.when(F.col("lang") == "en", "dev").otherwise("test"))


_LABELLED = """WITH e AS (SELECT d.doc_id, d.text, d.lang, d.n_chars, l.quality, CASE WHEN lang = 'en' THEN 'dev' ELSE 'test' END AS split
FROM documents d JOIN (SELECT doc_id, min(quality) AS quality FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id)"""


@query("derived_label", f"{_LABELLED} SELECT doc_id, round(quality / 11.0, 6)::DOUBLE AS generality, split FROM e")
def derived_label(spark, d):
    return labelled(spark, d).select("doc_id", F.round(F.col("quality") / F.lit(11.0), 6).alias("generality"), "split")


@query("rmse_report", f"{_LABELLED} SELECT split, count(*)::BIGINT AS n, round(sqrt(avg(pow(quality - least(n_chars / 4000.0, 1.0), 2.0))), 6)::DOUBLE AS rmse FROM e GROUP BY 1")
def rmse_report(spark, d):
    pred = F.least(F.col("n_chars") / F.lit(4000.0), F.lit(1.0))
    return labelled(spark, d).groupBy("split").agg(F.count("*").alias("n"), F.round(rmse(F.col("quality"), pred), 6).alias("rmse"))


@query("baseline_constant", f"{_LABELLED} SELECT round(sqrt(avg(pow(quality - (SELECT avg(quality) FROM e WHERE split = 'dev'), 2.0))), 6) AS rmse FROM e WHERE split = 'test'")
def baseline_constant(spark, d):
    e = labelled(spark, d).select("split", "quality")
    mean = e.where("split = 'dev'").agg(F.avg("quality").alias("m"))
    return e.where("split = 'test'").crossJoin(F.broadcast(mean)).agg(F.round(rmse(F.col("quality"), F.col("m")), 6).alias("rmse"))  # one row


@query(
    "baseline_random",
    f"{_LABELLED} SELECT split, round(sqrt(avg(pow(quality - ('0x' || substr(md5('0|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE, 2.0))), 6) AS rmse FROM e GROUP BY 1",
)
def baseline_random(spark, d):
    return labelled(spark, d).groupBy("split").agg(F.round(rmse(F.col("quality"), S.uniform(0, "doc_id")), 6).alias("rmse"))


_TOKENS = r"unnest(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> ''))"


@query(
    "lexicon_score",
    f"""{_LABELLED}, t AS (SELECT doc_id, split, quality, {_TOKENS} AS tok FROM e),
x AS (SELECT tok, greatest(max(quality), 0.0) AS score FROM t WHERE split = 'dev' GROUP BY 1),
m AS (SELECT doc_id, avg(coalesce(score, -1.0)) AS s FROM t LEFT JOIN x USING (tok) WHERE split = 'test' GROUP BY 1)
SELECT e.doc_id, round(coalesce(s, -1.0), 6)::DOUBLE AS score FROM e LEFT JOIN m ON m.doc_id = e.doc_id WHERE split = 'test'""",
)
def lexicon_score(spark, d):
    """Mean lookup in a lexicon of the best score of each token; unknown tokens and empty texts count -1."""
    e = labelled(spark, d)
    t = e.select("doc_id", "split", "quality", F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: x != "")).alias("tok"))
    lexicon = t.where("split = 'dev'").groupBy("tok").agg(F.greatest(F.max("quality").cast("double"), F.lit(0.0)).alias("score"))
    means = t.where("split = 'test'").join(lexicon, "tok", "left").groupBy("doc_id").agg(F.avg(F.coalesce("score", F.lit(-1.0))).alias("s"))
    return e.where("split = 'test'").join(means, "doc_id", "left").select("doc_id", F.round(F.coalesce("s", F.lit(-1.0)), 6).alias("score"))


_VECTORS = "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)"


@query(
    "top_p_count",
    f"""{_VECTORS}, e AS (SELECT vec_id, i, exp(v) AS ex FROM x), k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY ex DESC, i) AS r FROM e),
t AS (SELECT vec_id, r, ex / sum(ex) OVER (PARTITION BY vec_id) AS p FROM k WHERE r <= 18),
c AS (SELECT *, sum(p) OVER (PARTITION BY vec_id ORDER BY r) - p AS before FROM t)
SELECT vec_id, count(*)::BIGINT AS n FROM c WHERE before < 0.9 GROUP BY 1""",
)
def top_p_count(spark, d):
    """How many of the 18 largest softmax shares it takes to reach 0.9; row-local over each vector."""
    ex = F.slice(F.reverse(F.array_sort(F.transform("embedding", lambda v: F.exp(v.cast("double"))))), 1, 18)
    total = F.aggregate(ex, F.lit(0.0), lambda a, x: a + x)
    start = F.struct(F.lit(0.0).alias("cum"), F.lit(0).cast("long").alias("n"))
    fold = F.aggregate(
        ex,
        start,
        lambda a, x: F.struct((a["cum"] + x / F.col("total")).alias("cum"), (a["n"] + F.when(a["cum"] < 0.9, 1).otherwise(0)).cast("long").alias("n")),
    )
    return table(spark, d, "embeddings").withColumn("total", total).select("vec_id", fold["n"].alias("n"))


@query("softmax_sigmoid", f"{_VECTORS} SELECT vec_id, count(CASE WHEN 1.0 / (1.0 + exp(-v)) >= 0.3 THEN 1 END)::BIGINT AS n, round(max(exp(v)) / sum(exp(v)), 6) AS top FROM x GROUP BY 1")
def softmax_sigmoid(spark, d):
    v = F.transform("embedding", lambda x: x.cast("double"))
    ex = F.transform(v, lambda x: F.exp(x))
    high = F.size(F.filter(v, lambda x: sigmoid(x) >= 0.3)).cast("long")
    return table(spark, d, "embeddings").select("vec_id", high.alias("n"), F.round(F.array_max(ex) / F.aggregate(ex, F.lit(0.0), lambda a, x: a + x), 6).alias("top"))


@query(
    "sample_k_per_group",
    """WITH r AS (SELECT lang, source, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY md5('42|' || doc_id)) AS r FROM documents)
SELECT lang, source, doc_id FROM r WHERE r <= 1 + ('0x' || substr(md5('42|' || lang || '|' || source), 1, 8))::BIGINT % 2""",
)
def sample_k_per_group(spark, d):
    return S.sample_per_group(table(spark, d, "documents").select("lang", "source", "doc_id"), ["lang", "source"], "doc_id")


@query(
    "stratified_split",
    """SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY md5('42|' || doc_id)) <= floor(count(*) OVER (PARTITION BY lang) * 0.9) THEN 'train' ELSE 'dev' END AS split FROM documents""",
)
def stratified_split(spark, d):
    return S.stratified_split(table(spark, d, "documents").select("doc_id", "lang"), "lang", "doc_id").select("doc_id", "split")


@query("hash_shuffle_cut", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || doc_id)) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'dev' END AS split FROM documents")
def hash_shuffle_cut(spark, d):
    return S.exact_cut(table(spark, d, "documents").select("doc_id"), "doc_id")


@query("threshold_split", "SELECT doc_id, CASE WHEN ('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT / 4294967296.0::DOUBLE < 0.9 THEN 'train' ELSE 'dev' END AS split FROM documents")
def threshold_split(spark, d):
    return S.threshold_split(table(spark, d, "documents").select("doc_id"), "doc_id")


_PLAIN = "regexp_replace({}, '[^A-Za-z]', '', 'g')"


@query(
    "lexicon_fallback",
    f"""{_LABELLED}, t AS (SELECT doc_id, split, quality, unnest(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS tok FROM e),
x AS (SELECT tok, greatest(max(quality), 0.0) AS score FROM t WHERE split = 'dev' GROUP BY 1),
m AS (SELECT t.doc_id, avg(coalesce(a.score, b.score, -1.0)) AS s FROM t LEFT JOIN x a ON a.tok = t.tok LEFT JOIN x b ON b.tok = {_PLAIN.format('t.tok')} WHERE t.split = 'test' GROUP BY 1)
SELECT e.doc_id, round(coalesce(s, -1.0), 6)::DOUBLE AS score FROM e LEFT JOIN m ON m.doc_id = e.doc_id WHERE split = 'test'""",
)
def lexicon_fallback(spark, d):
    """Mean lookup of each token as it stands, else without its marks, else -1; the lexicon has the best score of each token."""
    e = labelled(spark, d).select("doc_id", "split", "quality", tokens(F.col("text")).alias("toks"))
    entries = e.where("split = 'dev'").select(F.explode("toks").alias("phrase"), F.col("quality").cast("double").alias("score"))
    found = lexicon_means(e.where("split = 'test'"), "doc_id", "toks", best_scores(entries), lambda w: F.regexp_replace(w, "[^A-Za-z]", ""))
    return found.select("doc_id", F.round("score", 6).alias("score"))


_WORDS = r"list_filter(string_split_regex(trim(regexp_replace(replace(text, '_', ' '), '\p{P}', '', 'g')), '\s+'), lambda x: x <> '')"


@query(
    "sentence_scores",
    f"""{_LABELLED}, w AS (SELECT doc_id, split, quality, {_WORDS} AS ws FROM e),
t AS (SELECT doc_id, split, quality, ws[i] AS word, i FROM (SELECT *, unnest(range(1, len(ws) + 1)) AS i FROM w)),
x AS (SELECT word, greatest(max(quality), 0.0) AS score FROM t WHERE split = 'dev' GROUP BY 1),
s AS (SELECT doc_id, i, greatest(coalesce(x.score, -1.0), 0.000001) AS s FROM t LEFT JOIN x USING (word) WHERE split = 'test'),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS r FROM s)
SELECT doc_id, count(*)::BIGINT AS n, round(count(CASE WHEN r <= 2 THEN 1 END) / sum(CASE WHEN r <= 2 THEN 1.0 / s END), 6) AS lowest FROM r GROUP BY 1""",
)
def sentence_scores(spark, d):
    """Sentence generality with the lexicon as the word scorer: harmonic mean of the two lowest word scores."""
    e = labelled(spark, d)
    words = e.where("split = 'dev'").select(F.explode(tokens(spoken_form(F.col("text"), fold=False))).alias("phrase"), F.col("quality").cast("double").alias("score"))
    scored = score_sentences(e.where("split = 'test'").select("doc_id", "text"), "doc_id", "text", table_scorer(best_scores(words)), k=2)
    return scored.select("doc_id", F.col("n_words").alias("n"), F.round("lowest", 6).alias("lowest"))


_MARKED = r"""WITH i AS (SELECT item_id, CASE item_id % 3 WHEN 0 THEN 'de' WHEN 1 THEN 'fr' ELSE 'en' END AS lang, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM benchmark),
v AS (SELECT item_id, lang, k - 1 AS pos, CASE WHEN k % 3 = 0 AND k < len(w) THEN w[k] || ' ' || w[k + 1] ELSE w[k] END AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS k FROM i)),
u AS (SELECT v.* FROM v JOIN (SELECT item_id, coalesce(min(CASE WHEN contains(word, ' ') THEN pos END), max(pos)) AS until FROM v GROUP BY 1) t ON t.item_id = v.item_id AND pos <= until),
p AS (SELECT DISTINCT doc_id, lang, unnest(string_split_regex(text, '\s+')) AS tok FROM documents),
h AS (SELECT item_id, u.lang, pos, word, doc_id, 0 AS copy FROM u JOIN p ON p.lang = u.lang AND p.tok = word WHERE NOT contains(word, ' ') AND tok <> ''
 UNION ALL SELECT item_id, lang, pos, word, doc_id, row_number() OVER (PARTITION BY item_id, pos, doc_id) AS copy FROM
  (SELECT s.item_id, s.lang, pos, word, p.doc_id FROM (SELECT *, unnest(string_split(word, ' ')) AS part FROM u WHERE contains(word, ' ')) s JOIN p ON p.lang = s.lang AND p.tok = part JOIN documents d ON d.doc_id = p.doc_id WHERE contains(d.text, word))),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY pos, md5('42|' || item_id || '|' || doc_id || '|' || copy)) AS r FROM h QUALIFY pos = min(pos) OVER (PARTITION BY item_id)),
m AS (SELECT item_id, r.lang, doc_id, word, substr(text, 1, strpos(text, word) - 1) || '[TGT]' || word || '[/TGT]' || substr(text, strpos(text, word) + length(word)) AS marked
 FROM r JOIN documents d USING (doc_id) WHERE r <= 1 + ('0x' || substr(md5('42|' || item_id), 1, 8))::BIGINT % 2)"""


def marked_items(spark, d):
    """Benchmark items as rows, each third word as a phrase of two, and documents as the sentences of three dialects."""
    item = F.when(F.col("item_id") % 3 == 0, "de").when(F.col("item_id") % 3 == 1, "fr").otherwise("en")
    w = tokens(F.col("text"))
    words = F.transform(w, lambda x, k: F.when((k % 3 == 2) & (k < F.size(w) - 1), F.concat(x, F.lit(" "), F.get(w, k + 1))).otherwise(x))
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("row_id"), item.alias("dialect"), words.alias("words"), (F.length("text") / 1000.0).alias("score"))
    return rows, table(spark, d, "documents").select(F.col("doc_id").alias("sent_id"), F.col("lang").alias("dialect"), F.col("text").alias("sentence"))


@query("marked_sentences", f"{_MARKED} SELECT item_id AS row_id, lang AS dialect, doc_id AS sent_id, word, md5(marked) AS digest FROM m")
def marked_sentences(spark, d):
    found = TR.marked_sentences(*marked_items(spark, d))
    return found.select("row_id", "dialect", "sent_id", "word", F.md5("marked").alias("digest"))


@query(
    "training_rows",
    f"""{_MARKED}, k AS (SELECT m.*, length(b.text) / 1000.0::DOUBLE AS score, md5('42|' || item_id || '|' || doc_id) AS k FROM m JOIN benchmark b USING (item_id))
SELECT md5(marked) AS sentence, round(score, 6) AS score, lang AS dialect, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY k) <= floor(count(*) OVER (PARTITION BY lang) * 0.9) THEN 'train' ELSE 'dev' END AS split FROM k""",
)
def training_rows(spark, d):
    """The training-row builder: one or two marked sentences of each row, split by dialect."""
    rows, sentences = marked_items(spark, d)
    found = TR.sentence_rows(rows, sentences, "score")
    return found.select(F.md5("sentence").alias("sentence"), F.round("score", 6).alias("score"), "dialect", "split")


@query(
    "word_rows",
    """WITH w AS (SELECT event_type || '-' || user_id AS word, avg(value) AS generality FROM events GROUP BY 1)
SELECT word, round(generality, 6) AS generality, CASE WHEN row_number() OVER (ORDER BY md5('42|' || word)) <= floor(count(*) OVER () * 0.9) THEN 'train' ELSE 'dev' END AS split FROM w""",
)
def word_rows(spark, d):
    words = table(spark, d, "events").select(F.concat_ws("-", "event_type", F.col("user_id").cast("string")).alias("word"), "value")
    return TR.word_rows(words, "value").withColumn("generality", F.round("generality", 6))
