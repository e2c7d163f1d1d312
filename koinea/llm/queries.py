"""The registered queries of this subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from koinea.llm import bm25, html_text, iblt, langid, licenses, linededup, lm, minhash, mixing, sentencepieces

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"


def _query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLES[name] = oracle
        return f

    return add


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@_query(
    "op1_minhash_near_dedup",
    f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS t FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.t = e.a),
m AS (SELECT id, min(t) AS c FROM r GROUP BY id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.id = d.doc_id
""",
)
def op1(spark, sf_dir):
    """Near-duplicate classes on 3-word shingles at 85 %."""
    return minhash.near_duplicates(_documents(spark, sf_dir), ngram=3, similarity=(85, 100))


@_query("op2_language_id")
def op2(spark, sf_dir):
    """Predicted languages, learned from the documents that are not held out."""
    docs = _documents(spark, sf_dir)
    held = langid.held_out(F.col("doc_id"), 4)
    return langid.identify(docs, learn=~held).select("doc_id", held.alias("held_out"), "lang_pred", "score", "accepted")


@_query("op3_sentencepiece")
def op3(spark, sf_dir):
    """Token counts and a digest of the ids of every document; decoding and SentencePiece agree."""
    return sentencepieces.encode(_documents(spark, sf_dir)).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "n_byte_tokens",
        F.xxhash64("ids").alias("ids_digest"),
        "round_trip",
        "parity",
    )


@_query("op4_html_extraction")
def op4(spark, sf_dir):
    """The main text of every page."""
    return html_text.extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@_query("op5_fingerprints")
def op5(spark, sf_dir):
    """Sketches of every document and its edited text, with likenesses."""
    return iblt.fingerprints(_documents(spark, sf_dir))


@_query(
    "op6_exact_top_k",
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, len(w) AS dl, unnest(w) AS term FROM w),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT count(*) AS n, avg(len(w)) AS a FROM w),
f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT q.doc_id AS query_id, p.doc_id, sum(q.tf * ln(1 + (n.n - df + 0.5) / (df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / n.a))) AS score
  FROM p q JOIN f USING (term) JOIN p USING (term), n WHERE q.doc_id % 20 = 0 GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, doc_id, round(score, 6) AS score FROM r WHERE rank <= 10
""",
)
def op6(spark, sf_dir):
    """The ten best documents for every document whose id is divisible by 20."""
    docs = _documents(spark, sf_dir)
    asked = docs.where(F.col("doc_id") % 20 == 0).withColumnRenamed("doc_id", "query_id")
    return bm25.top_k(docs, asked).withColumn("score", F.round("score", 6))


@_query("op7_line_dedup")
def op7(spark, sf_dir):
    """Lines deleted from every document, and a digest of what stays."""
    return linededup.dedupe_lines(_documents(spark, sf_dir)).select(
        "doc_id", "n_lines", "n_deleted", "deleted_words", F.length("text").cast("long").alias("n_chars_kept"), F.sha2("text", 256).alias("kept_sha256")
    )


@_query("op8_lm_scoring")
def op8(spark, sf_dir):
    """Log probabilities of every document under a deleted-interpolation bigram model."""
    return lm.score_texts(_documents(spark, sf_dir))


@_query(
    "op9_source_mixing",
    rf"""
WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
o AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM s),
c AS (SELECT *, 3 * source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS all_weight FROM o),
p AS (SELECT *, row_number() OVER (ORDER BY ratio, source NULLS LAST) AS k,
        coalesce(sum(3 * source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
        coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM c),
q AS (SELECT *, (total - size_before)::DOUBLE / (all_weight - weight_before)::DOUBLE AS level FROM p),
f AS (SELECT arg_min(level, k) AS level FROM q WHERE weight * level <= 3 * source_size),
t AS (SELECT source, source_size, CASE WHEN weight * f.level > 3 * source_size THEN (3 * source_size)::DOUBLE ELSE weight * f.level END AS target FROM q, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 3.0::DOUBLE) ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate)::BIGINT + CASE WHEN ('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null')), 1, 12))::BIGINT / 281474976710656.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
""",
)
def op9(spark, sf_dir):
    """The mix of all documents: sizes, targets, and the words taken."""
    plan = mixing.mix_plan(_documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _license_sql() -> str:
    rows = []
    for k, (label, text) in enumerate(licenses.TEMPLATES):
        own = sorted(set(licenses.tokens_of(text)))
        rows.append(f"({k}, '{label}', [{', '.join(repr(w) for w in own)}], {licenses.needed(text)}, {licenses.longest_block(text)})")
    parts = []
    for phrase, label in licenses.PHRASES:
        test = " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
        parts.append(f"SELECT doc_id, i - 1 AS s, '{label}' AS label FROM i WHERE {test}")
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
    return f"""
WITH t(k, label, tokens, need, long) AS (VALUES {', '.join(rows)}),
d AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS x FROM documents),
w AS (SELECT doc_id, regexp_extract_all(x, {word}) AS w FROM d),
i AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
p AS ({' UNION ALL '.join(parts)}),
b AS (SELECT doc_id, count(*)::BIGINT AS n_base, min(s)::BIGINT AS first_word, max(s)::BIGINT AS last_word, list_sort(list(DISTINCT label)) AS labels FROM p GROUP BY 1),
u AS (SELECT k, label, len(tokens) AS size, need, long, unnest(tokens) AS word FROM t),
h AS (SELECT doc_id, k, label, size, need, long, i, word FROM (SELECT doc_id, i, w[i] AS word FROM i) JOIN u USING (word)),
g AS (SELECT doc_id, k FROM h GROUP BY ALL HAVING count(DISTINCT word) >= min(need)),
c AS (SELECT h.doc_id, h.label, count(DISTINCT o.word) / h.size::DOUBLE AS c FROM h JOIN g USING (doc_id, k) JOIN h o ON o.doc_id = h.doc_id AND o.k = h.k AND o.i BETWEEN h.i AND h.i + h.long - 1
  GROUP BY h.doc_id, h.k, h.label, h.size, h.need, h.i HAVING count(DISTINCT o.word) >= h.need),
n AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM c GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word, coalesce(array_to_string(b.labels, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(n.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0.0) END::DOUBLE AS score
FROM w LEFT JOIN b ON b.doc_id = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""


@_query("op10_license_scan", _license_sql())
def op10(spark, sf_dir):
    """License labels of every document."""
    return licenses.scan_licenses(_documents(spark, sf_dir))
