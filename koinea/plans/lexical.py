"""Queries over texts: normalisation, tokens, alignments, edit distances and generality scores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from koinea.functions import text as X
from koinea.functions.scoring import freq_softmax, gate
from koinea.operators import alignment as A
from koinea.operators import cost
from koinea.operators import generality as G
from koinea.operators import kernels
from koinea.operators.counting import counter_maps
from koinea.operators.phrases import phrase_counts
from koinea.plans.registry import query, table


def docs(spark, d):
    return table(spark, d, "documents")


def _norm(c: str) -> str:
    return rf"regexp_replace(translate(regexp_replace({c}, '\p{{P}}|ـ|[ً-ْٰ]', '', 'g'), 'ىأإآٱة', 'يااااه'), '^[\s\x0b\x1c-\x1f\x{{85}}\x{{A0}}]+|[\s\x0b\x1c-\x1f\x{{85}}\x{{A0}}]+$', '', 'g')"


def _split(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda x: x <> '')"


@query("normalize_text", f"SELECT doc_id, md5({_norm('text')}) AS digest FROM documents")
def normalize_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.normalize_text(F.col("text"))).alias("digest"))


@query("tokenize", f"SELECT doc_id, len({_split('text')})::BIGINT AS n, {_split('text')}[1] AS first FROM documents")
def tokenize(spark, d):
    t = X.tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.get(t, F.lit(0)).alias("first"))


@query("token_limit", f"SELECT doc_id, md5(array_to_string({_split('text')}[1:64], ' ')) AS digest FROM documents")
def token_limit(spark, d):
    return docs(spark, d).select("doc_id", F.md5(F.array_join(X.first_tokens(F.col("text")), " ")).alias("digest"))


@query("word_filter", rf"SELECT p_partkey, p_name FROM part WHERE len({_split('p_name')}) <= 2 AND length(p_name) > 1 AND NOT regexp_matches(p_name, '^\d+$')")
def word_filter(spark, d):
    return table(spark, d, "part").where(X.is_word(F.col("p_name"))).select("p_partkey", "p_name")


@query(
    "inverted_index",
    f"""WITH b AS (SELECT DISTINCT item_id, unnest({_split('text')}) AS tok FROM benchmark),
t AS (SELECT DISTINCT doc_id, unnest({_split('text')}) AS tok FROM documents)
SELECT item_id, tok, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc FROM b JOIN t USING (tok) GROUP BY 1, 2""",
)
def inverted_index(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("tok"))
    posts = docs(spark, d).select("doc_id", F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("tok"))
    found = posts.groupBy("tok").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("first_doc"))
    return items.join(found, "tok").select("item_id", "tok", "n_docs", "first_doc")


@query(
    "mark_first",
    """WITH t AS (SELECT doc_id, text, substr(source, 1, 0) || CASE lang WHEN 'en' THEN 'the' WHEN 'de' THEN 'der' WHEN 'fr' THEN 'de' ELSE 'la' END AS w FROM documents)
SELECT doc_id, md5(substr(text, 1, strpos(text, w) - 1) || '[TGT]' || w || '[/TGT]' || substr(text, strpos(text, w) + length(w))) AS digest FROM t WHERE strpos(text, w) > 0""",
)
def mark_first(spark, d):
    word = F.when(F.col("lang") == "en", "the").when(F.col("lang") == "de", "der").when(F.col("lang") == "fr", "de").otherwise("la")
    return docs(spark, d).select("doc_id", F.md5(X.mark_first(F.col("text"), word)).alias("digest")).where("digest is not null")


@query(
    "phrase_contains",
    f"""WITH b AS (SELECT item_id, {_split('text')} AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, w[k] AS a, w[k + 1] AS b FROM (SELECT *, unnest(range(1, len(w))) AS k FROM b)),
s AS (SELECT item_id, a || ' ' || b AS phrase, unnest([a, b]) AS tok FROM p),
t AS (SELECT DISTINCT doc_id, text, unnest({_split('text')}) AS tok FROM documents),
f AS (SELECT DISTINCT item_id, phrase, doc_id FROM s JOIN t USING (tok) WHERE contains(text, phrase))
SELECT item_id, phrase, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc FROM f GROUP BY 1, 2""",
)
def phrase_contains(spark, d):
    """For each two neighbouring words of an item the documents that hold one of them as a token and contain both in a row."""
    w = X.tokens(F.col("text"))
    two = F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda k: F.struct(F.get(w, k - 1).alias("a"), F.get(w, k).alias("b")))
    asked = table(spark, d, "benchmark").where(F.size(w) > 1).select("item_id", F.explode(F.array_distinct(two)).alias("p")).select("item_id", "p.a", "p.b").distinct()
    found = phrase_counts(docs(spark, d), asked)
    return asked.join(found, ["a", "b"]).select("item_id", F.concat("a", F.lit(" "), "b").alias("phrase"), "n_docs", "first_doc")


_ALIGNED = """WITH j AS (SELECT a.conv_id, a.turn, min(a.text) AS text, min(b.text) AS reply FROM conversations a
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY 1, 2),
w AS (SELECT 'g' || turn % 8 AS g, 'g' || (turn + 1) % 8 AS h, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '') AS a, list_filter(string_split_regex(lower(reply), '[^a-z]+'), lambda x: x <> '') AS b FROM j),
z AS (SELECT g, h, a[i] AS a, b[i] AS b FROM (SELECT *, unnest(range(1, least(len(a), len(b)) + 1)) AS i FROM w)),
p AS (SELECT *, levenshtein(word, tgt_word)::DOUBLE / greatest(length(word), length(tgt_word)) AS distance FROM
  (SELECT word, grp, tgt_grp, tgt_word, count(*)::BIGINT AS freq FROM (SELECT a AS word, g AS grp, h AS tgt_grp, b AS tgt_word FROM z UNION ALL SELECT b, h, g, a FROM z) GROUP BY ALL))"""
CORE, OTHERS = [f"g{i}" for i in range(6)], ["g6", "g7"]


def aligned_turns(spark, d):
    """All words of all turns against the words at the same place of the next turn; a turn's number modulo 8 is its group."""
    words = lambda c: F.filter(F.split(F.lower(c), "[^a-z]+"), lambda x: x != "")
    group = lambda k: F.concat(F.lit("g"), ((F.col("turn") + k) % 8).cast("string"))
    rows = turns(spark, d).select(group(0).alias("g"), words("text").alias("a"), group(1).alias("h"), words("reply").alias("b"))
    return G.distances(G.aligned_words(rows, "g", "a", "h", "b"))


@query("edit_distance_pairs", f"{_ALIGNED} SELECT word, grp, tgt_grp, tgt_word, round(distance, 6) AS distance FROM p WHERE distance <= 0.5")
def edit_distance_pairs(spark, d):
    return aligned_turns(spark, d).where("distance <= 0.5").select("word", "grp", "tgt_grp", "tgt_word", F.round("distance", 6).alias("distance"))


_AFFIX = f"""{_ALIGNED}, a AS (SELECT grp, word, tgt_word, CASE WHEN length(word) - length(tgt_word) BETWEEN 1 AND 3 AND suffix(word, tgt_word) THEN substr(word, 1, length(word) - length(tgt_word)) END AS prefix,
CASE WHEN length(word) - length(tgt_word) BETWEEN 1 AND 3 AND prefix(word, tgt_word) THEN substr(word, length(tgt_word) + 1) END AS suffix FROM p WHERE distance > 0 AND distance <= 0.5 AND freq >= 1)"""


def affixes(spark, d):
    near = aligned_turns(spark, d).where("distance > 0 and distance <= 0.5 and freq >= 1")
    return near.select("grp", "word", "tgt_word", X.prefix_of(F.col("word"), F.col("tgt_word")).alias("prefix"), X.suffix_of(F.col("word"), F.col("tgt_word")).alias("suffix"))


@query("affix_candidates", f"{_AFFIX} SELECT grp, word, tgt_word, prefix, suffix FROM a WHERE prefix IS NOT NULL OR suffix IS NOT NULL")
def affix_candidates(spark, d):
    return affixes(spark, d).where("prefix is not null or suffix is not null")


@query(
    "affix_counts",
    f"""{_AFFIX} SELECT grp, 'prefix' AS kind, prefix AS affix, count(*)::BIGINT AS n FROM a WHERE prefix IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT grp, 'suffix', suffix, count(*)::BIGINT FROM a WHERE suffix IS NOT NULL GROUP BY 1, 3""",
)
def affix_counts(spark, d):
    long = A.phrases(affixes(spark, d), ["grp"], ["prefix", "suffix"])
    return long.groupBy("grp", F.col("variety").alias("kind"), F.col("phrase").alias("affix")).agg(F.count("*").alias("n"))


_SOFT = "SELECT word, grp, tgt_grp, {} FROM (SELECT *, min(distance) OVER (PARTITION BY word, grp, tgt_grp) AS low FROM p) GROUP BY 1, 2, 3"


@query(
    "cross_group_distance",
    f"""{_ALIGNED}, m AS (SELECT word, grp, tgt_grp, min(distance) AS dist FROM p GROUP BY 1, 2, 3),
g AS (SELECT count(DISTINCT grp) AS n FROM p)
SELECT word, grp, round((sum(1.0 / (1.0 + exp(-20.0 * (0.5 - dist)))) + 1.0 / (1.0 + exp(-10.0)) + (max(g.n) - 1 - count(*)) * (1.0 / (1.0 + exp(10.0)))) / max(g.n), 6) AS score
FROM m, g GROUP BY word, grp""",
)
def cross_group_distance(spark, d):
    """The flagship: how close each word of a group is to the words that all other groups have in its place."""
    pairs = aligned_turns(spark, d)
    groups = pairs.select("grp").distinct().count()
    found = G.scores(G.group_distances(pairs), groups)
    return found.select("word", "grp", F.round("min_t_0_5_k_20", 6).alias("score"))


@query(
    "gated_score",
    f"""{_ALIGNED}, m AS (SELECT word, grp, tgt_grp, min(distance) AS dist FROM p GROUP BY 1, 2, 3)
SELECT word, grp, """
    + ", ".join(f"round(avg(1.0 / (1.0 + exp(-20.0 * ({t} - dist)))), 6) AS t_{str(t).replace('.', '_')}" for t in (0.3, 0.4, 0.5))
    + " FROM m GROUP BY 1, 2",
)
def gated_score(spark, d):
    found = G.group_distances(aligned_turns(spark, d))
    return found.groupBy("word", "grp").agg(*[F.round(F.avg(gate(F.col("d_min"), t)), 6).alias(f"t_{str(t).replace('.', '_')}") for t in (0.3, 0.4, 0.5)])


@query("freq_softmax", f"{_ALIGNED} " + _SOFT.format("round(sum(freq * exp(-5.0 * (distance - low)) * distance) / sum(freq * exp(-5.0 * (distance - low))), 6) AS distance"))
def freq_softmax_query(spark, d):
    return G.group_distances(aligned_turns(spark, d)).select("word", "grp", "tgt_grp", F.round("d_soft", 6).alias("distance"))


@query(
    "corpus_tag",
    f"""{_ALIGNED}, s AS (SELECT word, grp, tgt_grp FROM p UNION SELECT word, grp, grp FROM p)
SELECT word, grp, (CASE WHEN max(CASE WHEN tgt_grp IN ('g6', 'g7') THEN 1 ELSE 0 END) = 1 THEN 26 ELSE 6 END)::INTEGER AS corpus, count(*)::BIGINT AS present FROM s GROUP BY 1, 2""",
)
def corpus_tag(spark, d):
    """26 for a word with any slot beyond the six core groups, else 6."""
    pairs = aligned_turns(spark, d)
    slots = pairs.select("word", "grp", "tgt_grp").unionByName(pairs.select("word", "grp", F.col("grp").alias("tgt_grp"))).distinct()
    beyond = F.max(F.when(F.col("tgt_grp").isin(CORE), 0).otherwise(1)) == 1
    return slots.groupBy("word", "grp").agg(F.when(beyond, 26).otherwise(6).alias("corpus"), F.count("*").alias("present"))


def _score_sql() -> str:
    rest = "1.0 / (1.0 + exp(20.0 * (1.0 - {t})))"
    columns = []
    for label, c in (("min", "d_min"), ("softmax", "d_soft")):
        for t in (0.3, 0.4, 0.5):
            gate_ = f"1.0 / (1.0 + exp(-20.0 * ({t} - {c})))"
            name = f"{label}_t_{str(t).replace('.', '_')}_k_20"
            six = f"(coalesce(sum(CASE WHEN core THEN {gate_} END), 0) + (6 - count(CASE WHEN core THEN 1 END)) * {rest.format(t=t)}) / 6"
            every = f"(sum({gate_}) + (8 - count(*)) * {rest.format(t=t)}) / 8"
            columns += [f"round({six}, 6) AS {name}_c6", f"round(CASE WHEN bool_or(NOT core) THEN {every} END, 6) AS {name}_c26"]
    return f"""{_ALIGNED},
l AS (SELECT *, min(distance) OVER (PARTITION BY word, grp, tgt_grp) AS low FROM p),
d AS (SELECT word, grp, tgt_grp, min(distance) AS d_min, sum(freq * exp(-5.0 * (distance - low)) * distance) / sum(freq * exp(-5.0 * (distance - low))) AS d_soft FROM l GROUP BY 1, 2, 3
  UNION ALL SELECT DISTINCT word, grp, grp, 0.0, 0.0 FROM p),
e AS (SELECT *, tgt_grp IN ('g0', 'g1', 'g2', 'g3', 'g4', 'g5') AS core FROM d)
SELECT word, grp, (CASE WHEN bool_or(NOT core) THEN 26 ELSE 6 END)::INTEGER AS corpus, {', '.join(columns)} FROM e GROUP BY 1, 2"""


@query("score_table", _score_sql())
def score_table(spark, d):
    """The wide score table with twelve gated scores of every word, over the core groups and over all."""
    found = G.score_table(G.group_distances(aligned_turns(spark, d)), CORE, OTHERS)
    return found.select(*[F.round(c, 6).alias(c) if "_t_" in c else F.col(c) for c in found.columns])


@query("score_maps", f"""{_ALIGNED}, c AS (SELECT word, grp, tgt_grp, string_agg(tgt_word || '=' || freq, ';' ORDER BY tgt_word) AS counts FROM p GROUP BY 1, 2, 3)
SELECT word, grp, tgt_grp, md5(counts) AS counts FROM c""")
def score_maps(spark, d):
    """Grouped alignments: for each word and other group the count map of the words aligned with it."""
    maps = counter_maps(aligned_turns(spark, d).withColumnRenamed("freq", "n"), ["word", "grp", "tgt_grp"], "tgt_word")
    entries = F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return maps.select("word", "grp", "tgt_grp", F.md5(F.array_join(entries, ";")).alias("counts"))


def turns(spark, d):
    """Conversations as a parallel table: turn n and turn n + 1."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "text")
    following = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("reply"))
    return c.join(following, ["conv_id", "turn"]).groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("reply").alias("reply"))


_TURNS = """WITH r AS (SELECT a.conv_id, a.turn, min(a.text) AS text, min(b.text) AS reply FROM conversations a
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY 1, 2)"""


@query("unpivot_pairs", f"{_TURNS} SELECT conv_id, turn, 'reply' AS variety, md5(trim(text) || ' ||| ' || trim(reply)) AS digest FROM r WHERE trim(text) <> '' AND trim(reply) <> ''")
def unpivot_pairs(spark, d):
    keyed = turns(spark, d).withColumn("key", F.struct("conv_id", "turn"))
    return A.pair_lines(keyed, "key", "text", ["reply"]).select("key.conv_id", "key.turn", "variety", F.md5("line").alias("digest"))


@query("unpivot_phrases", "SELECT doc_id, 'lang' AS variety, lang AS phrase FROM documents WHERE lang IS NOT NULL UNION ALL SELECT doc_id, 'source', source FROM documents WHERE source IS NOT NULL")
def unpivot_phrases(spark, d):
    return A.phrases(docs(spark, d), ["doc_id"], ["lang", "source"])


_PAIRS = """x AS (SELECT conv_id, turn, {s} AS w FROM conversations WHERE text IS NOT NULL),
l AS (SELECT conv_id, turn, w, i - 1 AS i FROM (SELECT conv_id, turn, w, unnest(range(1, len(w) + 1)) AS i FROM x))""".format(s=_split("text"))


def index_pairs(spark, d):
    """Alignment lines `i-j` made from turns: each word with the position its length points at."""
    w = X.tokens(F.col("text"))
    made = F.array_join(F.transform(w, lambda x, i: F.concat(i.cast("string"), F.lit("-"), (F.char_length(x) % 5).cast("string"))), " ")
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", "text", made.alias("line"))


@query("parse_pairs", f"WITH {_PAIRS} SELECT conv_id, turn, i::INTEGER AS src, (length(w[i + 1]) % 5)::INTEGER AS tgt FROM l")
def parse_pairs(spark, d):
    return A.parsed(index_pairs(spark, d), "line").select("conv_id", "turn", F.explode("pairs").alias("p")).select("conv_id", "turn", "p.src", "p.tgt")


@query("posexplode_align", f"WITH {_PAIRS} SELECT conv_id, turn, i::INTEGER AS idx, w[i + 1] AS word, (length(w[i + 1]) % 5)::VARCHAR AS targets FROM l")
def posexplode_align(spark, d):
    rows = A.alignment_table(A.parsed(index_pairs(spark, d), "line"), ["conv_id", "turn"], "text", "pairs")
    return rows.select("conv_id", "turn", "idx", "word", F.array_join("targets", ",").alias("targets"))


@query("one_to_many", f"WITH {_PAIRS} SELECT conv_id, turn, (i % 7)::INTEGER AS src, string_agg(DISTINCT (length(w[i + 1]) % 5)::VARCHAR, ',' ORDER BY (length(w[i + 1]) % 5)::VARCHAR) AS targets FROM l GROUP BY 1, 2, 3")
def one_to_many(spark, d):
    pairs = A.parsed(index_pairs(spark, d), "line").withColumn("pairs", F.transform("pairs", lambda x: F.struct((x["src"] % 7).alias("src"), x["tgt"].alias("tgt"))))
    spread = pairs.select("conv_id", "turn", F.explode(A.one_to_many(F.col("pairs"))).alias("src", "t"))
    return spread.select("conv_id", "turn", "src", F.array_join("t", ",").alias("targets"))


@query(
    "positional_zip",
    """WITH a AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS pos FROM documents),
b AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY doc_id DESC) AS pos FROM documents)
SELECT lang, pos::INTEGER AS pos, a.doc_id, b.n_chars FROM a JOIN b USING (lang, pos)""",
)
def positional_zip(spark, d):
    left, right = docs(spark, d).select("lang", "doc_id"), docs(spark, d).select("lang", (-F.col("doc_id")).alias("back"), "n_chars")
    return A.positional_zip(left, right, "doc_id", "back", "lang").select("lang", "pos", "doc_id", "n_chars")


@query(
    "segment_fold",
    """WITH RECURSIVE s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k,
  [coalesce(length(text), 0) % 3] AS a, [coalesce(length(text), 0) % 2] AS b FROM conversations),
f AS (SELECT conv_id, k, 0 AS seg, a, b FROM s WHERE k = 1
 UNION ALL
 SELECT s.conv_id, s.k, CASE WHEN s.a = f.a OR s.b = f.b THEN f.seg ELSE f.seg + 1 END,
   CASE WHEN s.a = f.a OR s.b = f.b THEN list_sort(list_distinct(f.a || s.a)) ELSE s.a END,
   CASE WHEN s.a = f.a OR s.b = f.b THEN list_sort(list_distinct(f.b || s.b)) ELSE s.b END
 FROM f JOIN s ON s.conv_id = f.conv_id AND s.k = f.k + 1)
SELECT conv_id, seg::BIGINT AS segment, count(*)::BIGINT AS positions, arg_max(array_to_string(a, ','), k) AS a, arg_max(array_to_string(b, ','), k) AS b FROM f GROUP BY 1, 2""",
)
def segment_fold(spark, d):
    """Two varieties' target sets by turn, merged along each conversation by the running union."""
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    n = F.coalesce(F.char_length("text"), F.lit(0))
    steps = table(spark, d, "conversations").select("conv_id", F.struct(rank.alias("idx"), F.array(n % 3).alias("a"), F.array(n % 2).alias("b")).alias("s"))
    whole = steps.groupBy("conv_id").agg(F.array_sort(F.collect_list("s")).alias("steps"))
    merged = whole.select("conv_id", F.posexplode(A.segment_fold(F.col("steps"), ["a", "b"])).alias("segment", "m"))
    return merged.select("conv_id", F.col("segment").cast("long"), F.size("m.idx").cast("long").alias("positions"), F.array_join("m.a", ",").alias("a"), F.array_join("m.b", ",").alias("b"))


_PHRASES = f"""WITH RECURSIVE r AS (SELECT a.conv_id, a.turn, min(a.text) AS text, min(b.text) AS reply FROM conversations a
JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY 1, 2),
x AS (SELECT conv_id, turn, {_split('text')} AS w, {_split("translate(text, 'aeiou', 'AEIOU')")} AS u, {_split('reply')} AS q FROM r WHERE text IS NOT NULL),
s AS (SELECT conv_id, turn, i, CASE WHEN i // 2 < len(q) THEN [i // 2] ELSE [] END AS a, [i // 3] AS b FROM (SELECT *, unnest(range(0, len(w))) AS i FROM x)),
f AS (SELECT conv_id, turn, i, 0 AS seg, a, b FROM s WHERE i = 0
 UNION ALL
 SELECT s.conv_id, s.turn, s.i, CASE WHEN (len(s.a) > 0 AND s.a = f.a) OR s.b = f.b THEN f.seg ELSE f.seg + 1 END,
   CASE WHEN (len(s.a) > 0 AND s.a = f.a) OR s.b = f.b THEN list_sort(list_distinct(f.a || s.a)) ELSE s.a END,
   CASE WHEN (len(s.a) > 0 AND s.a = f.a) OR s.b = f.b THEN list_sort(list_distinct(f.b || s.b)) ELSE s.b END
 FROM f JOIN s ON s.conv_id = f.conv_id AND s.turn = f.turn AND s.i = f.i + 1),
g AS (SELECT conv_id, turn, seg, min(i) AS lo, max(i) AS hi, arg_max(a, i) AS a, arg_max(b, i) AS b FROM f GROUP BY 1, 2, 3),
p AS (SELECT conv_id, turn, seg, array_to_string(w[lo + 1:hi + 1], ' ') AS text, CASE WHEN len(a) > 0 THEN array_to_string(list_transform(a, lambda k: q[k + 1]), ' ') END AS reply,
  array_to_string(list_transform(b, lambda k: u[k + 1]), ' ') AS loud FROM g JOIN x USING (conv_id, turn)),
l AS (SELECT text AS word, 'text' AS dialect, * FROM p UNION ALL SELECT reply, 'reply', * FROM p WHERE reply IS NOT NULL UNION ALL SELECT loud, 'loud', * FROM p)"""


def _phrases(spark, d):
    """Turns with made alignments: each pair of words with one word of the reply, each three with one word of the text with loud vowels."""
    rows = turns(spark, d).where("text is not null").withColumn("loud", F.translate("text", "aeiou", "AEIOU"))
    at = F.when(F.size(X.tokens(F.col("text"))) > 0, F.sequence(F.lit(0), F.size(X.tokens(F.col("text"))) - 1))
    pair = lambda k: lambda i: F.struct(i.alias("src"), F.floor(i / k).cast("int").alias("tgt"))
    reply = F.filter(F.transform(at, pair(2)), lambda x: x["tgt"] < F.coalesce(F.size(X.tokens(F.col("reply"))), F.lit(0)))
    made = F.create_map(F.lit("reply"), reply, F.lit("loud"), F.transform(at, pair(3)))
    return A.phrase_rows(rows.withColumn("pairs", made), ["conv_id", "turn"], "text", ["reply", "loud"])


@query("phrase_rows", f"{_PHRASES} SELECT conv_id, turn, seg::INTEGER AS segment, word, dialect, text, reply, loud FROM l")
def phrase_rows(spark, d):
    return _phrases(spark, d)


_COUNTS = "string_agg(CASE WHEN variety = '{0}' THEN phrase || '=' || n END, ';' ORDER BY phrase) AS {0}"


@query(
    "grouped_phrases",
    f"""{_PHRASES}, n AS (SELECT {_norm('word')} AS word, dialect, variety, phrase, count(*) AS n FROM
  (SELECT word, dialect, unnest(['text', 'reply', 'loud']) AS variety, unnest([text, reply, loud]) AS phrase FROM l) GROUP BY 1, 2, 3, 4)
SELECT word, dialect, {', '.join(f"coalesce({c.split(' AS ')[0]}, '') AS {c.split(' AS ')[1]}" for c in (_COUNTS.format(v) for v in ('text', 'reply', 'loud')))} FROM n GROUP BY 1, 2""",
)
def grouped_phrases(spark, d):
    """The grouped alignment table: for each normalised word and dialect the count map of every variety."""
    names = ["text", "reply", "loud"]
    shown = lambda v: F.array_join(F.transform(F.map_entries(v), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";").alias(v)
    return A.grouped_phrases(_phrases(spark, d), names).select("word", "dialect", *[shown(v) for v in names])


@query(
    "blank_block_segment",
    """WITH l AS (SELECT doc_id, unnest(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, '. ', chr(10) || chr(10)), chr(10)), 1) AS i FROM documents),
f AS (SELECT *, trim(line) = '' AS blank, lag(trim(line) = '') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM l),
s AS (SELECT *, sum(CASE WHEN NOT blank AND coalesce(before, true) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS block FROM f)
SELECT doc_id, block::BIGINT AS block, count(*)::BIGINT AS lines FROM s WHERE NOT blank GROUP BY 1, 2""",
)
def blank_block_segment(spark, d):
    lines = docs(spark, d).select("doc_id", F.posexplode(F.split(F.replace("text", F.lit(". "), F.lit("\n\n")), "\n", -1)).alias("i", "line"))
    return A.blank_blocks(lines, "doc_id", "i", "line").groupBy("doc_id", "block").agg(F.count("*").alias("lines"))


def _word_pairs(spark, d):
    """Each distinct word of all texts, once, with its reversal; dealt out by number, as words are few bytes but much work."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 2)
    return docs(spark, d).select(F.explode(words).alias("src")).distinct().repartition(parts, "src").select("src", F.reverse("src").alias("tgt"))


_LETTERS = """WITH RECURSIVE w AS (SELECT DISTINCT lang AS dialect, unnest(string_split_regex(lower(text), '[^a-z]+')) AS coda FROM documents WHERE lang IS NOT NULL),
s AS (SELECT coda, dialect, len(coda) AS n, list_concat(list_concat([{'src': coda[1], 'tgt': upper(coda[1])}, {'src': '-1', 'tgt': 'x'}],
  list_transform(range(2, len(coda) + 1), lambda k: {'src': coda[k], 'tgt': dialect || coda[k]})), [{'src': coda[-1], 'tgt': 'y'}]) AS own FROM w WHERE len(coda) > 2),
r AS (SELECT coda, dialect, n, 0 AS k, own FROM s UNION ALL
  SELECT coda, dialect, n, k + 1, CASE WHEN own[k + 1].src = coda[k + 1] THEN own ELSE list_concat(own[:k], own[k + 2:]) END FROM r WHERE k < n),
e AS (SELECT coda, dialect, unnest(range(1, n + 1)) AS i, own FROM r WHERE k = n)
SELECT coda, (i - 1)::INTEGER AS position, coda[i] AS letter, string_agg(dialect || ':' || own[i].tgt, ' ' ORDER BY dialect) AS by_dialect FROM e GROUP BY coda, i"""


@query("letter_merge", _LETTERS)
def letter_merge(spark, d):
    """Letter alignments of each word, with an insertion and a doubled last letter, merged over the languages that have it."""
    shown = F.array_join(F.transform(F.map_entries("by_dialect"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), " ")
    return merged_letters(spark, d).select("coda", "position", "letter", shown.alias("by_dialect"))


def merged_letters(spark, d):
    """The words of each language as merged letter alignments."""
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) > 2)
    seen = docs(spark, d).where("lang is not null").select(F.col("lang").alias("dialect"), F.explode(words).alias("coda")).distinct()
    pair = lambda src, tgt: F.struct(src.alias("src"), tgt.alias("tgt"))
    letters, last = F.split("coda", ""), F.substring("coda", -1, 1)
    first = F.substring("coda", 1, 1)
    middle = F.transform(F.slice(letters, F.lit(2), F.length("coda") - 1), lambda x: pair(x, F.concat("dialect", x)))
    made = F.concat(F.array(pair(first, F.upper(first)), pair(F.lit(kernels.GAP), F.lit("x"))), middle, F.array(pair(last, F.lit("y"))))
    return kernels.merge_letter_alignments(seen.select("coda", "dialect", F.lit(1).alias("ord"), made.alias("pairs")))


@query(
    "letter_evidence",
    f"""{_LETTERS.replace("SELECT coda, (i - 1)::INTEGER", ", z AS (SELECT coda, (i - 1)::INTEGER").replace("string_agg(dialect || ':' || own[i].tgt, ' ' ORDER BY dialect) AS by_dialect", "list(DISTINCT own[i].tgt) AS heard")}),
u AS (SELECT DISTINCT coda[i] AS letter, own[i].tgt AS caphi FROM e WHERE own[i].tgt = upper(coda[i]) OR own[i].tgt = 'en' || coda[i]),
g AS (SELECT letter, list(caphi) AS usual FROM u GROUP BY 1),
o AS (SELECT dialect, e.coda[i] AS letter, own[i].tgt AS caphi, heard, coalesce(usual, []) AS usual FROM e JOIN z ON z.coda = e.coda AND z.position = e.i - 1 LEFT JOIN g ON g.letter = e.coda[i]),
k AS (SELECT *, len(list_filter(heard, lambda x: NOT list_contains(usual, x))) = 0 AS plain FROM o)
SELECT dialect, letter, caphi, count(CASE WHEN plain OR (len(heard) > 1 AND list_contains(usual, caphi)) THEN 1 END)::BIGINT AS phon_count,
count(CASE WHEN NOT plain AND len(heard) > 1 THEN 1 END)::BIGINT AS etym_count, sum(CASE WHEN plain THEN 1 WHEN len(heard) > 1 THEN 2 ELSE 0 END)::BIGINT AS total FROM k GROUP BY 1, 2, 3""",
)
def letter_evidence(spark, d):
    """Evidence for sound and origin of each letter's phonemes; a letter's defaults are its capital and its English one."""
    usual = lambda letter, caphi: (caphi == F.upper(letter)) | (caphi == F.concat(F.lit("en"), letter))
    return cost.own_letter_evidence(merged_letters(spark, d), usual)


@query("spelling_alignment")
def spelling_alignment(spark, d):
    """Character alignment of words with their reversals; checked against goldens in the tests."""
    pairs = _word_pairs(spark, d)
    return pairs.select("src", "tgt", F.transform(kernels.spelling_alignments(F.col("src"), F.col("tgt")), lambda x: F.concat(x["src"], F.lit(">"), x["tgt"])).alias("p")).select(
        "src", "tgt", F.array_join("p", " ").alias("alignment")
    )


@query("letter_phoneme_alignment")
def letter_phoneme_alignment(spark, d):
    """Letters against phonemes, with a mapping that hears each letter as itself."""
    mapping = {chr(c): (chr(c),) for c in range(97, 123)}
    words = _word_pairs(spark, d).select("src")
    phones = words.select("src", F.array_join(F.split("src", ""), " ").alias("phonemes"))
    aligned = kernels.letter_phoneme_alignments(F.col("src"), F.col("phonemes"), mapping)
    return phones.select("src", F.size(aligned).cast("long").alias("n"), F.size(F.filter(aligned, lambda x: x["src"] == x["tgt"])).cast("long").alias("hits"))


@query("augmented_distance")
def augmented_distance(spark, d):
    """Weighted distance of words and their reversals with cheap vowels; checked against goldens in the tests."""
    costs = {(a, "X", b, "Y"): 0.2 for a in "aeiou" for b in "aeiou" if a != b}
    pairs = _word_pairs(spark, d).withColumns({"d_src": F.lit("X"), "d_tgt": F.lit("Y")})
    found = kernels.weighted_distances(pairs, costs)
    return found.select("src", "tgt", "result.distance_before", "result.distance_after", "result.normalized")
