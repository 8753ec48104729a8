"""Operators that are windows, orders and limits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import parse as P
from ..operators import etl
from ..plans import retrieval as R
from ..plans import review as V
from .base import query

HITS = """h AS (SELECT o_custkey % 50 AS query_id, o_orderkey AS doc_id, o_totalprice AS score FROM orders)"""


def hits(t):
    return t.orders.select((F.col("o_custkey") % 50).alias("query_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score"))


@query("w1_rank", f"WITH {HITS} SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM h")
def w1(t):
    return R.ranked(hits(t)).select("query_id", "doc_id", "rank")


@query("w2_keep_first", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def w2(t):
    """By digest: texts do not move."""
    return etl.keep_first(t.documents.select("doc_id", "source", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"]).select("doc_id", "source")


@query(
    "w3_position_decay",
    f"""WITH {HITS}, n AS (SELECT query_id, doc_id, score / 1000000 AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM h),
       d AS (SELECT query_id, doc_id, n, round(0.5 * score + 0.5 * CASE WHEN n <= 1 THEN 1 ELSE 1 - pos / (n - 1) END, 9) AS decayed FROM n),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY decayed DESC, doc_id) AS rank FROM d)
       SELECT query_id, doc_id, round(decayed, 6) AS decayed, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= greatest(1, n // 2)""",
)
def w3(t):
    h = hits(t).withColumn("score", F.col("score") / 1000000)
    return R.position_decay(h).select("query_id", "doc_id", F.round("decayed", 6).alias("decayed"), "rank")


@query(
    "w4_floor_median",
    f"WITH {HITS}, s AS (SELECT query_id, list_reverse_sort(list(score)) AS s FROM h GROUP BY 1) SELECT query_id, s[greatest(1, len(s) // 3)] AS floor_score, s[len(s) // 2 + 1] AS median_score FROM s",
)
def w4(t):
    w = Window.partitionBy("query_id")
    x = R.ranked(hits(t)).withColumn("n", F.count("*").over(w))
    at = lambda place: F.max(F.when(F.col("rank") == place, F.col("score")))
    return x.groupBy("query_id").agg(at(F.greatest(F.lit(1), F.floor(F.col("n") / 3))).alias("floor_score"), at(F.floor(F.col("n") / 2) + 1).alias("median_score"))


NORM = "WITH " + HITS + ", s AS (SELECT *, min(score) OVER w AS lo, max(score) OVER w AS hi, avg(score) OVER w AS mean, stddev_pop(score) OVER w AS dev FROM h WINDOW w AS (PARTITION BY query_id))"


@query("w5_min_max", NORM + " SELECT query_id, doc_id, round(CASE WHEN hi - lo < 1e-10 THEN 50 ELSE (score - lo) / (hi - lo) * 100 END, 6) AS norm FROM s")
def w5a(t):
    return R.normalized(hits(t), "min-max").select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


@query("w5_z_score", NORM + " SELECT query_id, doc_id, round(CASE WHEN dev < 1e-10 THEN 0 ELSE (score - mean) / dev END, 6) AS norm FROM s")
def w5b(t):
    return R.normalized(hits(t), "z-score").select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


@query("w5_centered", NORM + " SELECT query_id, doc_id, round(greatest(0, least(100, 10 + (score / 1e7 - 0.012) * 100 / greatest(0.023, hi / 1e7 - lo / 1e7))), 6) AS norm FROM s")
def w5c(t):
    h = hits(t).withColumn("score", F.col("score") / 1e7)
    return R.normalized(h, "centered").select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


@query("w5_percentile")
def w5d(t):
    """The error function is in neither engine: tests hold it against Python's."""
    return R.normalized(hits(t), "percentile").select("query_id", "doc_id", F.round("norm", 6).alias("norm"))


@query("w6_chunks")
def w6(t):
    """Overlapping chunks of whole sentences; sequential, so tests hold it against a plain version."""
    return t.documents.select("doc_id", F.explode(P.chunks("text")).alias("c")).select("doc_id", "c.*")


@query(
    "w7_between_matches",
    """SELECT doc_id, generate_subscripts(p, 1) - 1 AS place, length(unnest(p)) AS size FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)""",
)
def w7(t):
    return t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "x")).select("doc_id", F.col("place").cast("long").alias("place"), F.length("x").cast("long").alias("size"))


@query(
    "w8_sandwich",
    f"""WITH {HITS}, n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS i, count(*) OVER (PARTITION BY query_id) AS n FROM h)
       SELECT query_id, doc_id, CAST(CASE WHEN n <= 2 THEN i WHEN i % 2 = 0 THEN i // 2 ELSE n - 1 - (i - 1) // 2 END AS INTEGER) AS place FROM n""",
)
def w8(t):
    return R.sandwich(hits(t)).select("query_id", "doc_id", "place")


@query("w9_ranked_resolution", "SELECT l_orderkey, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, l_partkey) AS r FROM lineitem) WHERE r = 1")
def w9(t):
    order = F.when(F.col("l_returnflag") == "R", 0).when(F.col("l_returnflag") == "A", 1).otherwise(2)
    return etl.keep_first(t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag"), ["l_orderkey"], [order, F.col("l_partkey")]).select("l_orderkey", "l_partkey")


@query("t1_top_n", f"WITH {HITS} SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM h) WHERE r <= 20")
def t1(t):
    return R.ranked(hits(t), 20).select("query_id", "doc_id")


@query("t4_global_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def t4(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("t5_sort_coalesce", "SELECT p_partkey FROM part ORDER BY coalesce(CASE WHEN p_size > 25 THEN p_retailprice * 2 END, p_retailprice) DESC, p_partkey LIMIT 50")
def t5(t):
    agg = F.when(F.col("p_size") > 25, F.col("p_retailprice") * 2)
    return t.part.orderBy(F.desc(F.coalesce(agg, F.col("p_retailprice"))), "p_partkey").limit(50).select("p_partkey")


@query("t8_limit_per_parent", "SELECT n_nationkey, c_custkey FROM (SELECT n_nationkey, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_acctbal DESC, c_custkey) AS r FROM nation JOIN customer ON c_nationkey = n_nationkey) WHERE r <= 3")
def t8(t):
    x = t.nation.join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"))
    w = Window.partitionBy("n_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return x.withColumn("r", F.row_number().over(w)).where("r <= 3").select("n_nationkey", "c_custkey")


@query("t9_by_severity", "SELECT o_orderkey AS query_id FROM orders ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 2 ELSE 3 END, o_orderkey LIMIT 10")
def t9(t):
    p = F.substring("o_orderpriority", 1, 1)
    risk = F.when(p == "1", "high").when(p == "2", "medium").when(p == "3", "low").otherwise("none")
    return V.by_severity(t.orders.select(F.col("o_orderkey").alias("query_id"), risk.alias("risk"))).select("query_id")


@query("t10_latest_tasks", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 20")
def t10(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(20)


@query("t11_limit_after_join", "SELECT doc_id, quality FROM documents JOIN labels USING (doc_id) ORDER BY doc_id LIMIT 25")
def t11(t):
    return t.documents.select("doc_id").join(t.labels, "doc_id").select("doc_id", "quality").orderBy("doc_id").limit(25)
