"""Joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import etl
from ..operators import graph as G
from ..plans import retrieval as R
from ..plans import review as V
from ..plans import vectors as N
from .base import query
from .scans import keeping


def order_edges(t):
    """Order to part, typed by the return flag."""
    return t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel")).distinct()


@query(
    "j1_prepared_inner",
    """SELECT d.doc_id, quality, toxic, d.lang FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) d
       JOIN labels l ON d.doc_id = l.doc_id WHERE r = 1""",
)
def j1(t):
    first = etl.keep_first(t.documents, ["text"], ["doc_id"]).select("doc_id", "lang")
    return first.join(t.labels, "doc_id").select("doc_id", "quality", "toxic", "lang")


@query("j2_lookup_merge", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def j2(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).select("o_orderkey", "c_name", "n_name")


@query(
    "j3_edges_left_documents",
    """SELECT src AS doc_id, dst AS related, source AS title, 'outgoing' AS direction FROM (SELECT doc_id AS src, doc_id * 3 % 1500 AS dst FROM documents) LEFT JOIN documents ON dst = doc_id
       UNION ALL SELECT dst, src, source, 'incoming' FROM (SELECT doc_id AS src, doc_id * 3 % 1500 AS dst FROM documents) LEFT JOIN documents ON src = doc_id""",
)
def j3(t):
    e = t.documents.select(F.col("doc_id").alias("src"), (F.col("doc_id") * 3 % 1500).alias("dst"))
    d = t.documents.select("doc_id", F.col("source").alias("title"))
    out = e.join(d, F.col("dst") == F.col("doc_id"), "left").select(F.col("src").alias("doc_id"), F.col("dst").alias("related"), "title", F.lit("outgoing").alias("direction"))
    back = e.join(d, F.col("src") == F.col("doc_id"), "left").select(F.col("dst").alias("doc_id"), F.col("src").alias("related"), "title", F.lit("incoming").alias("direction"))
    return out.unionByName(back)


@query(
    "j4_second_degree",
    """WITH e AS (SELECT doc_id AS src, doc_id * 3 % 1000 AS dst FROM documents), s AS (SELECT item_id AS seed FROM benchmark)
       SELECT DISTINCT seed, id, direction FROM (
         SELECT seed, e2.dst AS id, 'outgoing' AS direction FROM s JOIN e e1 ON seed = e1.src JOIN e e2 ON e1.dst = e2.src
         UNION ALL SELECT seed, e2.src, 'incoming' FROM s JOIN e e1 ON seed = e1.dst JOIN e e2 ON e1.src = e2.dst) WHERE seed <> id""",
)
def j4(t):
    e = t.documents.select(F.col("doc_id").alias("src"), (F.col("doc_id") * 3 % 1000).alias("dst"))
    return G.second_degree(t.benchmark.select(F.col("item_id").alias("id")), e)


@query("j5_orphan_edges", "SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey NOT IN (SELECT s_suppkey FROM supplier) OR o_custkey NOT IN (SELECT s_suppkey FROM supplier)")
def j5(t):
    return etl.orphan_edges(t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), t.supplier, "s_suppkey")


@query(
    "j7_score_fallback",
    """WITH s AS (SELECT label AS root, round(avg(vec_id), 6) AS score FROM embeddings GROUP BY 1)
       SELECT vec_id, coalesce(a.score, b.score) AS score FROM embeddings LEFT JOIN s a ON a.root = vec_id LEFT JOIN s b ON b.root = label""",
)
def j7(t):
    s = t.embeddings.groupBy(F.col("label").alias("root")).agg(F.round(F.avg("vec_id"), 6).alias("score"))
    a, b = s.select(F.col("root").alias("ra"), F.col("score").alias("sa")), s.select(F.col("root").alias("rb"), F.col("score").alias("sb"))
    return t.embeddings.join(a, F.col("vec_id") == F.col("ra"), "left").join(b, F.col("label") == F.col("rb"), "left").select("vec_id", F.coalesce("sa", "sb").alias("score"))


@query("j8_pattern", "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def j8(t):
    return (
        t.region.join(t.nation, F.col("r_regionkey") == F.col("n_regionkey"))
        .join(t.customer, F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "n_name")
        .agg(F.count("*").alias("n"))
    )


@query(
    "j9_optional_match",
    """SELECT n_name, coalesce(string_agg(s_name, ',' ORDER BY s_name), '') AS suppliers FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1""",
)
def j9(t):
    x = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey"), "left")
    return x.groupBy("n_name").agg(F.concat_ws(",", F.array_sort(F.collect_set("s_name"))).alias("suppliers"))


COSINE = """
    WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id % 50 = 0),
    v AS (SELECT vec_id AS doc_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    s AS (SELECT query_id, doc_id, round(list_dot_product(q, v) / (sqrt(list_dot_product(q, q)) * sqrt(list_dot_product(v, v))), 6) AS score FROM q, v),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)"""


def lists(t):
    """The vectors in lists, kept."""
    return N.kept(t.embeddings.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v")), keeping(t.spark), "vectors")


def dense_hits(t, top=10):
    q = t.embeddings.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return N.search(lists(t), q, top)


@query("j10_dense_top_k", COSINE + " SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10")
def j10(t):
    return dense_hits(t).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"))


@query(
    "j11_terms_postings",
    """WITH q AS (SELECT DISTINCT item_id AS query_id, term FROM (SELECT item_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM benchmark) WHERE term <> ''),
       p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z0-9]+')) AS term FROM documents) WHERE term <> '' GROUP BY 1, 2)
       SELECT query_id, doc_id, count(*) AS terms, CAST(sum(tf) AS BIGINT) AS tf FROM q JOIN p USING (term) GROUP BY 1, 2""",
)
def j11(t):
    q = R.query_terms(t.benchmark, X.tokens(F.col("text")), "item_id")
    words = t.documents.select("doc_id", F.explode(X.tokens(F.col("text"))).alias("term")).join(R.sent(q.select("term").distinct()), "term", "left_semi")
    p = words.repartition("doc_id").groupBy("doc_id", "term").agg(F.count("*").alias("tf"))  # both groupings are within a document: its words move once
    return p.join(R.sent(q), "term").groupBy("query_id", "doc_id").agg(F.count("*").alias("terms"), F.sum("tf").alias("tf"))


@query(
    "j12_reference_resolution",
    """WITH r AS (SELECT p_partkey AS ref_id, p_brand AS kind, p_size AS year, substr(p_name, 1, 3) AS needle FROM part),
       d AS (SELECT p_partkey AS doc_id, p_brand AS kind, p_size AS year, p_type AS number, p_name AS title FROM part),
       c AS (SELECT ref_id, doc_id, CASE WHEN number = needle THEN 0 WHEN contains(lower(title), lower(needle)) THEN 1 END AS g FROM r JOIN d USING (kind, year))
       SELECT ref_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY ref_id ORDER BY g, doc_id) AS n FROM c WHERE g IS NOT NULL) WHERE n = 1""",
)
def j12(t):
    refs = t.part.select(F.col("p_partkey").alias("ref_id"), F.col("p_brand").alias("kind"), F.col("p_size").alias("year"), F.substring("p_name", 1, 3).alias("needle"))
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("kind"), F.col("p_size").alias("year"), F.col("p_type").alias("number"), F.col("p_name").alias("title"))
    return G.resolve(refs, docs)


def expectations(t):
    """Every document is expected of the query of its id; what has a label counts as retrieved."""
    exp = t.documents.select((F.col("doc_id") % 20).alias("query_id"), "doc_id")
    got = t.labels.select((F.col("doc_id") % 20).alias("query_id"), "doc_id").distinct()
    return exp, got


EXPECT = """WITH e AS (SELECT doc_id % 20 AS query_id, doc_id FROM documents), r AS (SELECT DISTINCT doc_id % 20 AS query_id, doc_id FROM labels)"""


@query("j13_expected_missing", EXPECT + " SELECT e.query_id, e.doc_id, r.doc_id IS NOT NULL AS found FROM e LEFT JOIN r ON e.query_id = r.query_id AND e.doc_id = r.doc_id")
def j13(t):
    e, r = expectations(t)
    return e.join(r.withColumn("found", F.lit(True)), ["query_id", "doc_id"], "left").select("query_id", "doc_id", F.coalesce("found", F.lit(False)).alias("found"))


@query(
    "j14_store_consistency",
    """SELECT coalesce(a.doc_id, b.vec_id) AS id, CASE WHEN b.vec_id IS NULL THEN 'left' WHEN a.doc_id IS NULL THEN 'right' ELSE 'both' END AS side
       FROM (SELECT DISTINCT doc_id FROM labels) a FULL JOIN (SELECT DISTINCT vec_id FROM embeddings) b ON a.doc_id = b.vec_id""",
)
def j14(t):
    return etl.compare_keys(t.labels.select(F.col("doc_id").alias("id")), t.embeddings.select(F.col("vec_id").alias("id")), "id")


@query("u1_union_distinct", "SELECT l_suppkey AS id FROM lineitem UNION SELECT s_suppkey FROM supplier")
def u1(t):
    return t.lineitem.select(F.col("l_suppkey").alias("id")).distinct().union(t.supplier.select("s_suppkey")).distinct()


@query("u3_context_first_wins", """WITH a AS (SELECT item_id AS query_id, item_id % 13 AS id, 0 AS p FROM benchmark UNION ALL SELECT item_id, item_id % 7, 1 FROM benchmark UNION ALL SELECT item_id, item_id % 13, 2 FROM benchmark)
       SELECT query_id, id, CASE min(p) WHEN 0 THEN 'parent' WHEN 1 THEN 'sibling' ELSE 'related' END AS source FROM a GROUP BY 1, 2""")
def u3(t):
    b = t.benchmark.select(F.col("item_id").alias("query_id"))
    src = lambda m: b.select("query_id", (F.col("query_id") % m).alias("id"))
    return G.injected([("parent", src(13)), ("sibling", src(7)), ("related", src(13))]).select("query_id", "id", "source")


@query("u4_set_operations", """SELECT 'both' AS op, count(*) AS n FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels)
       UNION ALL SELECT 'left', count(*) FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'any', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)""")
def u4(t):
    a, b = t.documents.select("doc_id"), t.labels.select("doc_id")
    n = lambda name, df: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return n("both", a.intersect(b)).unionByName(n("left", a.subtract(b))).unionByName(n("any", a.union(b).distinct()))


@query("u5_concat", "SELECT vec_id AS id, 'chunk' AS kind FROM embeddings UNION ALL SELECT doc_id, 'root' FROM documents")
def u5(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.lit("chunk").alias("kind")).unionByName(t.documents.select(F.col("doc_id").alias("id"), F.lit("root").alias("kind")))


@query("qc_related_for_hits", """WITH h AS (SELECT item_id AS query_id, item_id % 10 AS doc_id FROM benchmark), e AS (SELECT doc_id AS src, doc_id * 3 % 1000 AS dst, lang AS rel FROM documents),
       r AS (SELECT query_id, h.doc_id, dst AS related, rel, 'outgoing' AS direction FROM h JOIN e ON src = h.doc_id UNION SELECT query_id, h.doc_id, src, rel, 'incoming' FROM h JOIN e ON dst = h.doc_id)
       SELECT query_id, doc_id, related, rel, direction FROM (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY direction DESC, related, rel) AS n FROM r) WHERE n <= 3""")
def qc(t):
    e = t.documents.select(F.col("doc_id").alias("src"), (F.col("doc_id") * 3 % 1000).alias("dst"), F.col("lang").alias("rel"))
    h = t.benchmark.select(F.col("item_id").alias("query_id"), (F.col("item_id") % 10).alias("doc_id"))
    return V.related_for_hits(h, e, 3).drop("n")
