"""Queries over the star tables: scans, joins, counts and probability tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from koinea.functions.scoring import generalized_harmonic_mean, harmonic_mean, power_scale, ratio
from koinea.operators.counting import contingency, counter, counter_maps, evidence, last_write, normalized, sum_product, top_term
from koinea.operators.training import empty_slots, flatten_scores, slot_filter, unpack_scores
from koinea.plans.registry import query, table
from koinea.sources.tables import require

long = lambda c: F.col(c).cast("long")


@query("scan_project", "SELECT n_nationkey AS id, n_name AS variety, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey")
def scan_project(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("variety"), F.col("r_name").alias("region"))


@query("schema_check", "SELECT count(*)::BIGINT AS n, count(c_name)::BIGINT AS named FROM customer")
def schema_check(spark, d):
    return require(table(spark, d, "customer"), ["c_custkey", "c_name"]).agg(F.count("*").alias("n"), F.count("c_name").alias("named"))


@query("isin_filter", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def isin_filter(spark, d):
    return table(spark, d, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey", "c_mktsegment")


@query("union_all", "SELECT c_name AS name, c_nationkey AS nation FROM customer UNION ALL SELECT s_name, s_nationkey FROM supplier")
def union_all(spark, d):
    c = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")))


@query("except_domain", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def except_domain(spark, d):
    used = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(used.distinct()).distinct()


_STATUS = ("F", "O", "P")


@query(
    "left_join_chain",
    "SELECT c_custkey, "
    + ", ".join(f"n_{s.lower()}" for s in _STATUS)
    + " FROM customer "
    + " ".join(f"LEFT JOIN (SELECT o_custkey k{s}, count(*)::BIGINT AS n_{s.lower()} FROM orders WHERE o_orderstatus = '{s}' GROUP BY 1) ON k{s} = c_custkey" for s in _STATUS),
)
def left_join_chain(spark, d):
    out, orders = table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders")
    for s in _STATUS:
        own = orders.where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias(f"n_{s.lower()}"))
        out = out.join(own, "c_custkey", "left")
    return out


@query(
    "pivot_wide",
    "SELECT o_custkey, " + ", ".join(f"count(CASE WHEN o_orderstatus = '{s}' THEN 1 END)::BIGINT AS n_{s.lower()}" for s in _STATUS) + " FROM orders GROUP BY o_custkey",
)
def pivot_wide(spark, d):
    wide = table(spark, d, "orders").groupBy("o_custkey").pivot("o_orderstatus", list(_STATUS)).agg(F.count("o_orderkey"))
    return wide.select("o_custkey", *[F.coalesce(F.col(s), F.lit(0)).cast("long").alias(f"n_{s.lower()}") for s in _STATUS])


@query(
    "full_outer_chain",
    """
WITH a AS (SELECT o_custkey AS k, count(*)::BIGINT AS n_open FROM orders WHERE o_orderstatus = 'O' GROUP BY 1),
b AS (SELECT o_custkey AS k, count(*)::BIGINT AS n_partial FROM orders WHERE o_orderstatus = 'P' GROUP BY 1),
c AS (SELECT o_custkey AS k, count(*)::BIGINT AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT k, n_open, n_partial, n_urgent, c_mktsegment FROM a FULL JOIN b USING (k) FULL JOIN c USING (k) JOIN customer ON c_custkey = k
""",
)
def full_outer_chain(spark, d):
    o = table(spark, d, "orders").withColumnRenamed("o_custkey", "k")
    parts = [("n_open", F.col("o_orderstatus") == "O"), ("n_partial", F.col("o_orderstatus") == "P"), ("n_urgent", F.col("o_orderpriority") == "1-URGENT")]
    a, b, c = (o.where(w).groupBy("k").agg(F.count("*").alias(n)) for n, w in parts)
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_mktsegment")
    return a.join(b, "k", "full").join(c, "k", "full").join(customers, "k")


_FLAGS = """f AS (SELECT s_nationkey AS dialect, l_returnflag AS a, l_linestatus AS b, count(*)::BIGINT AS n
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY dialect, b) AS pab, n / sum(n) OVER (PARTITION BY dialect, a) AS pba FROM f)"""


def flags(spark, d, places=4):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dialect"))
    rows = table(spark, d, "lineitem").select("l_suppkey", F.col("l_returnflag").alias("a"), F.col("l_linestatus").alias("b")).join(s, "l_suppkey")
    return contingency(rows, "dialect", "a", "b", places=places)


@query("contingency_probs", f"WITH {_FLAGS} SELECT dialect, a, b, n, round(pab, 4) AS p_a_given_b, round(pba, 4) AS p_b_given_a FROM p")
def contingency_probs(spark, d):
    return flags(spark, d)


_TWO_STEP = f"""WITH {_FLAGS},
q AS (SELECT s_nationkey AS dialect, l_linestatus AS b, o_orderpriority AS c, count(*)::BIGINT AS n FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3),
r AS (SELECT *, n / sum(n) OVER (PARTITION BY dialect, b) AS pcb FROM q),
m AS (SELECT p.dialect, a, c, sum(pba * pcb) AS p FROM p JOIN r ON p.dialect = r.dialect AND p.b = r.b GROUP BY 1, 2, 3)"""


def two_step(spark, d):
    left = flags(spark, d, None).select("dialect", "a", "b", "p_b_given_a")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("dialect"))
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("c"))
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", F.col("l_linestatus").alias("b")).join(s, "l_suppkey").join(o, "l_orderkey")
    right = contingency(rows, "dialect", "c", "b", places=None).select("dialect", "b", "c", "p_a_given_b")
    return sum_product(left, right, ["dialect", "b"], ["dialect", "a", "c"], "p_b_given_a", "p_a_given_b")


@query("sum_product", f"{_TWO_STEP} SELECT dialect, a, c, round(p, 6) AS p FROM m")
def sum_product_query(spark, d):
    return two_step(spark, d).withColumn("p", F.round("p", 6))


@query(
    "normalize_dist",
    f"""{_TWO_STEP}, z AS (SELECT dialect, a, c, CASE WHEN a = 'N' THEN 0.0 ELSE p END AS p FROM m)
SELECT dialect, a, c, round(CASE WHEN sum(p) OVER w = 0 THEN 1.0 / count(*) OVER w ELSE p / sum(p) OVER w END, 6) AS p FROM z WINDOW w AS (PARTITION BY dialect, a)""",
)
def normalize_dist(spark, d):
    """Members of a group without mass share it evenly."""
    some = two_step(spark, d).withColumn("p", F.when(F.col("a") == "N", 0.0).otherwise(F.col("p")))
    return normalized(some, ["dialect", "a"], "p").withColumn("p", F.round("p", 6))


_COST = f"""WITH {_FLAGS}, x AS (SELECT dialect, a, b, pba AS v FROM p)
SELECT x.dialect AS d1, x.a AS l1, y.dialect AS d2, y.a AS l2, {{}} AS cost FROM x JOIN x y ON x.b = y.b GROUP BY 1, 2, 3, 4"""


def costs(spark, d):
    v = flags(spark, d, None).select("dialect", "a", "b", F.col("p_b_given_a").alias("v"))
    left = v.select(F.col("dialect").alias("d1"), F.col("a").alias("l1"), "b", F.col("v").alias("v1"))
    right = v.select(F.col("dialect").alias("d2"), F.col("a").alias("l2"), "b", F.col("v").alias("v2"))
    return left.join(right, "b").groupBy("d1", "l1", "d2", "l2").agg((1.0 - F.sum(F.col("v1") * F.col("v2"))).alias("cost"))


@query("subst_cost", _COST.format("round(1.0 - sum(x.v * y.v), 6)"))
def subst_cost(spark, d):
    """One minus the dot product of two letters' vectors."""
    return costs(spark, d).withColumn("cost", F.round("cost", 6))


@query("power_scale", _COST.format("round(pow(1.0 - sum(x.v * y.v), 5), 6)"))
def power_scale_query(spark, d):
    return costs(spark, d).withColumn("cost", F.round(power_scale(F.col("cost")), 6))


@query(
    "evidence_counts",
    """SELECT p_brand, string_agg(DISTINCT p_type, '|' ORDER BY p_type) AS members, sum(CASE WHEN p_size > 25 THEN 1 ELSE 0 END)::BIGINT AS n_large,
sum(CASE WHEN p_retailprice < 1200 THEN 1 ELSE 0 END)::BIGINT AS n_cheap FROM part GROUP BY p_brand""",
)
def evidence_counts(spark, d):
    return evidence(table(spark, d, "part"), ["p_brand"], "p_type", {"n_large": F.col("p_size") > 25, "n_cheap": F.col("p_retailprice") < 1200})


@query("semi_flag", "SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49) AS has_default FROM part")
def semi_flag(spark, d):
    keys = table(spark, d, "lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey")).distinct().withColumn("_hit", F.lit(True))
    return table(spark, d, "part").join(keys, "p_partkey", "left").select("p_partkey", F.col("_hit").isNotNull().alias("has_default"))


@query("list_agg", "SELECT p_type, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands, count(DISTINCT p_brand)::BIGINT AS n FROM part GROUP BY p_type")
def list_agg(spark, d):
    return table(spark, d, "part").groupBy("p_type").agg(F.array_sort(F.collect_set("p_brand")).alias("s")).select("p_type", F.concat_ws(",", "s").alias("brands"), F.size("s").cast("long").alias("n"))


def _counted(spark, d):
    return counter(table(spark, d, "events"), ["user_id"], "event_type", "ts")


@query("counter_map", "SELECT user_id, event_type, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def counter_map(spark, d):
    return counter_maps(_counted(spark, d), ["user_id"], "event_type").select("user_id", F.explode("counts").alias("event_type", "n"))


@query(
    "argmax_map",
    """WITH c AS (SELECT user_id, event_type, count(*)::BIGINT AS n, min(ts) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f, event_type) AS r FROM c) WHERE r = 1""",
)
def argmax_map(spark, d):
    c = _counted(spark, d).withColumn("first_pos", F.unix_micros(F.col("first_pos").cast("timestamp")))
    return top_term(c, ["user_id"], "event_type")


@query("last_write_wins", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def last_write_wins(spark, d):
    return last_write(table(spark, d, "events"), ["user_id", "event_type"], "value", "event_id")


@query("json_map_roundtrip", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k FROM events")
def json_map_roundtrip(spark, d):
    parsed = table(spark, d, "events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    return parsed.withColumn("m", F.from_json(F.to_json("m"), "map<string,bigint>")).select("event_id", F.element_at("m", "k").alias("k"))


@query(
    "hmean_k_lowest",
    """SELECT user_id, round(count(*) / sum(1.0 / greatest(value, 0.000001)), 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS r FROM events) WHERE r <= 2 GROUP BY 1""",
)
def hmean_k_lowest(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("user_id").orderBy("value", "event_id"))
    low = table(spark, d, "events").select("user_id", "value", rank.alias("r")).where("r <= 2")
    return low.groupBy("user_id").agg(F.round(harmonic_mean(F.col("value")), 6).alias("score"))


@query("ghm", "SELECT user_id, round(pow(avg(pow(value + 0.00000001, -2.0)), -0.5), 6) AS score FROM events GROUP BY 1")
def ghm(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(generalized_harmonic_mean(F.col("value")), 6).alias("score"))


@query("word_mean", "SELECT user_id, round(avg(value), 6) AS generality FROM events GROUP BY 1")
def word_mean(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("generality"))


_SLOTS = """WITH m AS (SELECT c_custkey, c_mktsegment, c_acctbal, (SELECT count(DISTINCT o_orderpriority) FROM orders WHERE o_custkey = c_custkey) AS held FROM customer),
w AS (SELECT c_custkey AS id, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 6 ELSE 26 END AS corpus, 5 - held AS missing, c_acctbal FROM m)"""
SLOTS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def slot_table(spark, d):
    """Customers with a count map of order states for each priority, a corpus by market segment, and score maps."""
    clerks = counter(table(spark, d, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus", "o_orderkey")
    entry = lambda v: F.when(F.col("o_orderpriority") == v, F.struct("o_orderstatus", "n"))
    maps = clerks.groupBy(F.col("o_custkey").alias("c_custkey")).agg(*[F.map_from_entries(F.array_sort(F.collect_list(entry(v)))).alias(f"s{k}") for k, v in enumerate(SLOTS)])
    corpus = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), 6).otherwise(26)
    scores = F.when(corpus == 26, F.create_map(F.lit(6), "c_acctbal", F.lit(26), -F.col("c_acctbal"))).otherwise(F.create_map(F.lit(6), "c_acctbal"))
    base = table(spark, d, "customer").select("c_custkey", F.lit("word").alias("word"), F.col("c_mktsegment").alias("dialect"), corpus.alias("corpus"), scores.alias("score"))
    return base.join(maps, "c_custkey", "left")


@query("null_slot_filter", f"{_SLOTS} SELECT id AS c_custkey, corpus::INTEGER AS corpus, missing::BIGINT AS missing FROM w WHERE missing <= CASE corpus WHEN 6 THEN 0 ELSE 1 END")
def null_slot_filter(spark, d):
    """Rows with no empty slot in corpus 6, at most one in corpus 26."""
    slots = [f"s{k}" for k in range(len(SLOTS))]
    kept = slot_filter(slot_table(spark, d), slots, {6: 0, 26: 1})
    return kept.select("c_custkey", "corpus", empty_slots(slots).cast("long").alias("missing"))


@query("unpack_scores", f"{_SLOTS} SELECT id AS c_custkey, c_acctbal::DOUBLE AS score_c6, CASE WHEN corpus = 26 THEN -c_acctbal::DOUBLE END AS score_c26 FROM w")
def unpack_scores_query(spark, d):
    found = unpack_scores(slot_table(spark, d), ["score"])
    return found.select("c_custkey", *[F.col(c).cast("double").alias(c) for c in ("score_c6", "score_c26")])


@query(
    "flatten_scores",
    f"""{_SLOTS} SELECT 26 AS level, id AS c_custkey, CASE WHEN corpus = 26 THEN -c_acctbal ELSE c_acctbal END::DOUBLE AS score FROM w
UNION ALL SELECT 6, id, w.c_acctbal::DOUBLE FROM w JOIN customer c ON c.c_custkey = id WHERE c_mktsegment = 'BUILDING'""",
)
def flatten_scores_query(spark, d):
    """Each row's score of its own corpus, and the core dialect's rows with the score of 6."""
    whole = slot_table(spark, d)
    parts = [flatten_scores(whole, ["score"], n, ["BUILDING"]).select(F.lit(n).alias("level"), "c_custkey", F.col("score").cast("double").alias("score")) for n in (26, 6)]
    return parts[0].unionByName(parts[1])


@query(
    "nullif_guard",
    """SELECT c_custkey, round(count(CASE WHEN o_orderstatus = 'F' THEN 1 END)::DOUBLE / coalesce(nullif(count(o_orderkey), 0), 1), 6) AS share
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
)
def nullif_guard(spark, d):
    c, o = table(spark, d, "customer"), table(spark, d, "orders")
    n = c.join(o, c.c_custkey == o.o_custkey, "left").groupBy("c_custkey").agg(F.count(F.when(F.col("o_orderstatus") == "F", 1)).alias("f"), F.count("o_orderkey").alias("t"))
    return n.select("c_custkey", F.round(ratio(F.col("f").cast("double"), F.col("t")), 6).alias("share"))
