"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import etl
from ..plans import retrieval as R
from ..plans import review as V
from .base import query
from .joins import EXPECT, expectations


@query("a1_count_by_type", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def a1(t):
    return etl.counted(t.events, "event_type").orderBy(F.desc("n"), "event_type")


@query("a2_distinct_coverage", "SELECT count(DISTINCT l_orderkey) AS sources, count(DISTINCT l_partkey) AS targets, count(*) AS edges FROM lineitem")
def a2(t):
    # two distinct counts expand the rows twice; each on its own partly aggregates before it shuffles
    a = t.lineitem.select("l_orderkey").distinct().agg(F.count("*").alias("sources"))
    b = t.lineitem.select("l_partkey").distinct().agg(F.count("*").alias("targets"))
    return a.crossJoin(b).crossJoin(t.lineitem.agg(F.count("*").alias("edges")))  # three rows of one


@query("a3_duplicates_having", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def a3(t):
    return etl.duplicate_keys(t.lineitem, "l_orderkey", "l_linenumber")


@query("a4_count_of_counts", "SELECT n AS size, count(*) AS keys FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY 1")
def a4(t):
    return etl.count_of_counts(t.lineitem, "l_orderkey")


@query(
    "a5_distribution",
    """SELECT min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 4) AS mean, s[CAST(floor(len(s) * 0.25) AS BIGINT) + 1] AS q25, s[CAST(floor(len(s) * 0.5) AS BIGINT) + 1] AS q50,
       s[CAST(floor(len(s) * 0.75) AS BIGINT) + 1] AS q75 FROM documents, (SELECT list(n_chars ORDER BY n_chars) AS s FROM documents) GROUP BY s""",
)
def a5(t):
    x = etl.index_percentile(t.documents, "n_chars", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return x.select(*(F.col(c).cast("long").alias(c) for c in ("least", "most", "q25", "q50", "q75")), F.round("mean", 4).alias("mean"))


@query("a6_length_stats", "SELECT lang, round(avg(length(text)), 4) AS mean, min(length(text)) AS least, max(length(text)) AS most FROM documents GROUP BY 1")
def a6(t):
    n = F.length("text").cast("long")
    return t.documents.groupBy("lang").agg(F.round(F.avg(n), 4).alias("mean"), F.min(n).alias("least"), F.max(n).alias("most"))


@query("a7_conditional_counts", "SELECT count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_quantity > 40) AS large, count(*) AS total FROM lineitem")
def a7(t):
    return t.lineitem.agg(F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_quantity") > 40).alias("large"), F.count("*").alias("total"))


@query(
    "a8_relationship_counts",
    """SELECT id, count(*) AS n, string_agg(DISTINCT rel, ',' ORDER BY rel) AS rels FROM (
         SELECT 'o' || l_orderkey AS id, l_returnflag AS rel FROM lineitem UNION ALL SELECT 'p' || l_partkey, l_returnflag FROM lineitem) GROUP BY 1""",
)
def a8(t):
    e = t.lineitem.select(F.explode(F.array(F.concat(F.lit("o"), "l_orderkey"), F.concat(F.lit("p"), "l_partkey"))).alias("id"), F.col("l_returnflag").alias("rel"))
    return e.groupBy("id").agg(F.count("*").alias("n"), F.concat_ws(",", F.array_sort(F.collect_set("rel"))).alias("rels"))


@query(
    "a9_latency_percentiles",
    """SELECT event_type, len(s) AS n, round(list_avg(s), 6) AS mean, s[1] AS least, s[len(s)] AS most, s[CAST(floor(len(s) * 0.5) AS BIGINT) + 1] AS p50, s[CAST(floor(len(s) * 0.95) AS BIGINT) + 1] AS p95,
       s[CAST(floor(len(s) * 0.99) AS BIGINT) + 1] AS p99 FROM (SELECT event_type, list(value ORDER BY value) AS s FROM events WHERE value IS NOT NULL GROUP BY 1)""",
)
def a9(t):
    return etl.index_percentile(t.events, "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, by=["event_type"]).withColumn("mean", F.round("mean", 6))


@query("a11_chunk_max_pooling", "SELECT lang, max(n_chars) AS score FROM documents GROUP BY 1")
def a11(t):
    h = t.documents.select(F.lit(1).alias("query_id"), F.concat(F.col("lang"), F.lit("_chunk_"), F.col("doc_id")).alias("doc_id"), F.col("n_chars").alias("score"))
    return R.pool_chunks(h, X.root_id(F.col("doc_id"))).select(F.col("doc_id").alias("lang"), "score")


@query("a12_root_consolidation", "SELECT l_orderkey AS root, max(l_extendedprice) AS score FROM lineitem GROUP BY 1")
def a12(t):
    return t.lineitem.groupBy(F.col("l_orderkey").alias("root")).agg(F.max("l_extendedprice").alias("score"))


@query(
    "a13_law_aggregation",
    """WITH h AS (SELECT l_orderkey // 100 AS query_id, l_orderkey * 10 + l_linenumber AS doc_id, CAST(l_suppkey % 7 AS VARCHAR) AS law_id, l_linenumber > 1 AS is_article, l_linenumber AS article_no,
                       max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2, 3, 4, 5),
       a AS (SELECT *, list(score) OVER (PARTITION BY query_id) AS l0 FROM h),
       b AS (SELECT *, list_reverse_sort(l0) AS l FROM a),
       c AS (SELECT *, l[greatest(1, len(l) // 3)] AS fl, l[len(l) // 2 + 1] AS med, sum(CASE WHEN is_article THEN score END) OVER g AS s, count(CASE WHEN is_article THEN 1 END) OVER g AS n_articles,
              max(CASE WHEN is_article THEN score END) OVER g AS best, max(CASE WHEN NOT is_article THEN doc_id END) OVER g AS root_id,
              list_sort(list_distinct(list(CASE WHEN is_article THEN article_no END) OVER g)) AS nums FROM b WINDOW g AS (PARTITION BY query_id, law_id)),
       d AS (SELECT *, max(CASE WHEN doc_id = root_id AND NOT is_article THEN score END) OVER g AS root_score, min(CASE WHEN is_article AND score = best THEN doc_id END) OVER g AS best_id FROM c WINDOW g AS (PARTITION BY query_id, law_id)),
       e AS (SELECT *, (root_id IS NULL OR s > root_score OR best >= fl) AS wins FROM d),
       f AS (SELECT * FROM e WHERE CASE WHEN n_articles = 0 THEN doc_id = root_id WHEN wins THEN is_article AND doc_id = best_id ELSE (NOT is_article AND doc_id = root_id) OR (is_article AND score >= med) END)
       SELECT query_id, doc_id, law_id, is_article, score, round(CASE WHEN n_articles > 0 AND wins AND doc_id = best_id AND is_article THEN s END, 2) AS agg_score, n_articles, array_to_string(nums[1:5], ',') AS article_numbers FROM f""",
)
def a13(t):
    h = t.lineitem.groupBy(
        F.expr("l_orderkey div 100").alias("query_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("doc_id"), (F.col("l_suppkey") % 7).cast("string").alias("law_id"),
        (F.col("l_linenumber") > 1).alias("is_article"), F.col("l_linenumber").alias("article_no"),
    ).agg(F.max("l_extendedprice").alias("score"))
    return R.aggregate_laws(h).drop("rank").withColumn("agg_score", F.round("agg_score", 2))


@query(
    "a14_grouped_context",
    """WITH h AS (SELECT o_custkey % 20 AS query_id, o_orderstatus || substr(o_orderpriority, 1, 1) AS law_id, o_orderkey AS doc_id, o_totalprice AS score FROM orders),
       b AS (SELECT *, max(score) OVER (PARTITION BY query_id, law_id) AS best FROM h),
       r AS (SELECT *, dense_rank() OVER (PARTITION BY query_id ORDER BY best DESC, law_id) AS lr, row_number() OVER (PARTITION BY query_id, law_id ORDER BY score DESC, doc_id) AS hr FROM b)
       SELECT query_id, string_agg(law_id || ':' || doc_id, ' ' ORDER BY lr, hr) AS context FROM r WHERE lr <= 5 AND hr <= 3 GROUP BY 1""",
)
def a14(t):
    law = F.concat("o_orderstatus", F.substring("o_orderpriority", 1, 1))
    return V.grouped_context(t.orders.select((F.col("o_custkey") % 20).alias("query_id"), law.alias("law_id"), F.col("o_orderkey").alias("doc_id"), F.col("o_totalprice").alias("score")))


@query("a15_risk_summary", "SELECT risk, count(k) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('none')) d(risk) LEFT JOIN (SELECT 1 AS k, CASE WHEN n_chars > 9000 THEN 'high' WHEN n_chars > 2000 THEN 'low' ELSE 'none' END AS r FROM documents) ON r = risk GROUP BY 1")
def a15(t):
    return V.risk_summary(t.documents.select(F.when(F.col("n_chars") > 9000, "high").when(F.col("n_chars") > 2000, "low").otherwise("none").alias("risk")))


@query("a17_collect_distinct_maps", "SELECT o_custkey, string_agg(DISTINCT o_orderstatus || '/' || o_orderpriority, ';' ORDER BY o_orderstatus || '/' || o_orderpriority) AS kinds FROM orders GROUP BY 1")
def a17(t):
    s = F.array_sort(F.collect_set(F.struct("o_orderstatus", "o_orderpriority")))
    return t.orders.groupBy("o_custkey").agg(F.concat_ws(";", F.array_sort(F.transform(s, lambda x: F.concat_ws("/", x["o_orderstatus"], x["o_orderpriority"])))).alias("kinds"))


@query("a18_score_stats", "SELECT l_returnflag AS list, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS dev FROM lineitem GROUP BY 1")
def a18(t):
    q = "l_quantity"
    return t.lineitem.groupBy(F.col("l_returnflag").alias("list")).agg(F.min(q).alias("lo"), F.max(q).alias("hi"), F.round(F.avg(q), 6).alias("mean"), F.round(F.stddev_pop(q), 6).alias("dev"))


@query(
    "a19_recall",
    EXPECT
    + """ SELECT query_id, must, matched, round(matched / must, 6) AS recall, CASE WHEN round(matched / must, 6) >= 0.67 THEN 'pass' WHEN round(matched / must, 6) >= 0.33 THEN 'partial' ELSE 'fail' END AS status
       FROM (SELECT e.query_id, count(*) AS must, count(r.doc_id) AS matched FROM e LEFT JOIN r ON e.query_id = r.query_id AND e.doc_id = r.doc_id GROUP BY 1)""",
)
def a19(t):
    return V.recall(*expectations(t))


@query("a20_weighted_score", "SELECT p_partkey, round(0.3 * p_size + 0.3 * p_retailprice / 100 + 0.4 * length(p_name), 6) AS score FROM part")
def a20(t):
    return t.part.select("p_partkey", F.round(0.3 * F.col("p_size") + 0.3 * F.col("p_retailprice") / 100 + 0.4 * F.length("p_name"), 6).alias("score"))


@query(
    "a21_unique_references",
    """WITH c AS (SELECT l_orderkey AS query_id, l_linenumber AS place, l_suppkey AS ref_id FROM lineitem),
       f AS (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY query_id, place) AS r FROM c)
       SELECT ref_id, query_id, place, CAST(row_number() OVER (ORDER BY query_id, place, ref_id) AS INTEGER) AS n FROM f WHERE r = 1""",
)
def a21(t):
    return V.unique_references(t.lineitem.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("place"), F.col("l_suppkey").alias("ref_id")))


@query("a25_match_rate", "SELECT count(*) AS total, count(l.doc_id) AS matched, round(100.0 * count(l.doc_id) / count(*), 4) AS pct FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def a25(t):
    return etl.coverage(t.labels, t.documents, "doc_id")


@query("a24_throughput", "SELECT event_type, count(*) AS n, round(count(*) / (date_diff('second', min(ts), max(ts)) / 3600.0), 4) AS per_hour FROM events GROUP BY 1")
def a24(t):
    secs = F.unix_seconds(F.max("ts").cast("timestamp")) - F.unix_seconds(F.min("ts").cast("timestamp"))
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.count("*") / (secs / 3600.0), 4).alias("per_hour"))


@query("a26_unique_estimate", "SELECT count(DISTINCT l_suppkey) AS suppliers FROM lineitem")
def a26(t):
    """Exact distinct count; an approximate one within 1 % stands beside it for large tables (see tests)."""
    return t.lineitem.agg(F.countDistinct("l_suppkey").alias("suppliers"))


@query(
    "a27_keyword_hits",
    """SELECT lang, count(*) AS n, round(100.0 * count(*) FILTER (contains(lower(substr(text, 1, 200)), 'the') OR contains(lower(substr(text, 1, 200)), 'und') OR contains(lower(source), '1')) / count(*), 4) AS pct,
       CAST(list_sort(list(n_chars))[CAST(floor(count(*) * 0.5) AS INTEGER) + 1] AS DOUBLE) AS p50, CAST(list_sort(list(n_chars))[CAST(floor(count(*) * 0.95) AS INTEGER) + 1] AS DOUBLE) AS p95 FROM documents GROUP BY 1""",
)
def a27(t):
    head = F.lower(F.substring("text", 1, 200))
    hit = F.exists(F.array(F.lit("the"), F.lit("und")), lambda k: head.contains(k)) | F.lower("source").contains("1")
    hits = t.documents.groupBy("lang").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(hit) / F.count("*"), 4).alias("pct"))
    places = etl.index_percentile(t.documents, "n_chars", {"p50": 0.5, "p95": 0.95}, by=["lang"]).select("lang", "p50", "p95")
    return hits.join(places, "lang")


@query(
    "a28_severity_checks",
    """SELECT 'lines_per_order' AS name, round(v, 6) AS value, CASE WHEN v < 5 THEN 'warning' ELSE 'ok' END AS severity FROM (SELECT count(*) / count(DISTINCT l_orderkey) AS v FROM lineitem)
       UNION ALL SELECT 'unlabelled_pct', round(v, 6), CASE WHEN v > 20 THEN 'critical' ELSE 'ok' END FROM (SELECT 100.0 * count(*) FILTER (l.doc_id IS NULL) / count(*) AS v FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
       UNION ALL SELECT 'short_pct', round(v, 6), CASE WHEN v > 10 THEN 'warning' ELSE 'ok' END FROM (SELECT 100.0 * count(*) FILTER (n_chars < 50) / count(*) AS v FROM documents)""",
)
def a28(t):
    lab = t.labels.select("doc_id").distinct().withColumn("l_", F.lit(1))
    checks = [
        ("lines_per_order", t.lineitem.agg((F.count("*") / F.countDistinct("l_orderkey")).alias("value")), "value < 5", "warning"),
        ("unlabelled_pct", t.documents.join(lab, "doc_id", "left").agg((100.0 * F.count_if(F.col("l_").isNull()) / F.count("*")).alias("value")), "value > 20", "critical"),
        ("short_pct", t.documents.agg((100.0 * F.count_if(F.col("n_chars") < 50) / F.count("*")).alias("value")), "value > 10", "warning"),
    ]
    return etl.graded(checks).withColumn("value", F.round("value", 6))


@query("a29_composite_duplicates", "SELECT l_orderkey, l_partkey, l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2, 3, 4 HAVING count(*) > 1")
def a29(t):
    return etl.duplicate_keys(t.lineitem, "l_orderkey", "l_partkey", "l_suppkey", "l_returnflag")


@query("a30_triple_dedupe_count", "SELECT count(*) AS edges, count(DISTINCT (l_orderkey, l_suppkey, l_returnflag)) AS kept, count(*) - count(DISTINCT (l_orderkey, l_suppkey, l_returnflag)) AS removed FROM lineitem")
def a30(t):
    g = t.lineitem.groupBy("l_orderkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("c"))
    return g.agg(F.sum("c").alias("edges"), F.count("*").alias("kept")).withColumn("removed", F.col("edges") - F.col("kept"))


@query(
    "a31_gain_loss",
    """WITH b AS (SELECT l_orderkey % 20 AS q, l_suppkey AS d FROM lineitem WHERE l_linenumber = 1), a AS (SELECT l_orderkey % 20 AS q, l_suppkey AS d FROM lineitem WHERE l_linenumber = 2)
       SELECT coalesce(x.q, y.q) AS query_id, count(*) FILTER (y.d IS NULL) AS lost, count(*) FILTER (x.d IS NULL) AS gained
       FROM (SELECT DISTINCT * FROM b) x FULL JOIN (SELECT DISTINCT * FROM a) y ON x.q = y.q AND x.d = y.d GROUP BY 1""",
)
def a31(t):
    pick = lambda n: t.lineitem.where(F.col("l_linenumber") == n).select((F.col("l_orderkey") % 20).alias("query_id"), F.col("l_suppkey").alias("d")).distinct()
    both = pick(1).withColumn("b", F.lit(1)).join(pick(2).withColumn("a", F.lit(1)), ["query_id", "d"], "full_outer")
    return both.groupBy("query_id").agg(F.count_if(F.col("a").isNull()).alias("lost"), F.count_if(F.col("b").isNull()).alias("gained"))


@query("a32_stage_targets", "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS worst, CASE WHEN avg(value) <= 50 THEN 'met' ELSE 'missed' END AS target FROM events GROUP BY 1")
def a32(t):
    return t.events.groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("worst"), F.when(F.avg("value") <= 50, "met").otherwise("missed").alias("target"))
