"""Graph operators: customers, nations, regions and orders as nodes; document chains as edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import graph as G
from ..sources.versions import Versioned
from .base import query
from .scans import scratch

# documents point to others by arithmetic, and are typed by language
EDGES = "e AS (SELECT doc_id AS src, doc_id * 3 % 1000 AS dst, lang AS rel, doc_id AS eid FROM documents), s AS (SELECT item_id AS seed FROM benchmark)"
BOTH = "u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"
BFS = f"""{EDGES}, {BOTH}, d1 AS (SELECT DISTINCT seed, dst AS id FROM s JOIN u ON seed = src), d2 AS (SELECT DISTINCT seed, dst AS id FROM d1 JOIN u ON id = src),
    r AS (SELECT seed, id, min(distance) AS distance FROM (SELECT seed, id, 1 AS distance FROM d1 UNION ALL SELECT seed, id, 2 FROM d2) WHERE seed <> id GROUP BY 1, 2)"""


def edges(t):
    return t.documents.select(F.col("doc_id").alias("src"), (F.col("doc_id") * 3 % 1000).alias("dst"), F.col("lang").alias("rel"), F.col("doc_id").alias("eid"))


def seeds(t):
    return t.benchmark.select(F.col("item_id").alias("id"))


@query("g1_neighbours", f"WITH {EDGES} SELECT seed, dst AS id, rel, 'outgoing' AS direction FROM s JOIN e ON seed = src WHERE rel IN ('en', 'de') UNION ALL SELECT seed, src, rel, 'incoming' FROM s JOIN e ON seed = dst WHERE rel IN ('en', 'de')")
def g1(t):
    return G.neighbours(seeds(t), edges(t), ["en", "de"])


@query("u2_related_ids", f"WITH {EDGES} SELECT DISTINCT id FROM (SELECT dst AS id FROM s JOIN e ON seed = src UNION ALL SELECT src FROM s JOIN e ON seed = dst) WHERE id NOT IN (SELECT seed FROM s)")
def u2(t):
    return G.related_ids(seeds(t), edges(t))


@query(
    "g2_directed_paths",
    f"""WITH {EDGES}, p1 AS (SELECT seed, dst AS id, 1 AS depth, rel, CAST(eid AS VARCHAR) AS trail, eid AS e1 FROM s JOIN e ON seed = src),
       p2 AS (SELECT p1.seed, e.dst AS id, 2 AS depth, e.rel, p1.trail || '>' || e.eid AS trail FROM p1 JOIN e ON p1.id = e.src WHERE e.eid <> e1)
       SELECT seed, id, depth, rel, trail FROM p1 WHERE rel = 'en' UNION ALL SELECT * FROM p2 WHERE rel = 'en'""",
)
def g2(t):
    return G.paths(seeds(t), edges(t), 2, F.col("rel") == "en")


@query("g3_nearest", f"WITH {BFS} SELECT seed, id, distance, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY distance, id) AS rank FROM r) WHERE rank <= 10")
def g3(t):
    return G.nearest(seeds(t), edges(t), 2, 10)


@query("g4_seed_expansion", f"WITH {BFS} SELECT id, count(DISTINCT seed) AS seed_count, min(distance) AS distance FROM r GROUP BY 1 ORDER BY seed_count DESC, distance, id LIMIT 10")
def g4(t):
    return G.seed_expansion(seeds(t), edges(t), 2, 10)


@query("g5_parents", "SELECT 'c' || c_custkey AS id, 'n' || c_nationkey AS parent FROM customer")
def g5(t):
    e = t.customer.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("c"), "c_custkey").alias("dst"), F.lit("CONTAINS").alias("rel"))
    return G.parents(t.customer.select(F.concat(F.lit("c"), "c_custkey").alias("id")), e)


@query("g6_citing", f"WITH {EDGES} SELECT id, citing, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY citing) AS rank FROM (SELECT DISTINCT dst AS id, src AS citing FROM e JOIN s ON dst = seed WHERE rel IN ('en', 'fr'))) WHERE rank <= 10")
def g6(t):
    return G.citing(seeds(t), edges(t), ("en", "fr"))


@query(
    "g7_hierarchy",
    """WITH a AS (SELECT n_regionkey AS doc_id, n_nationkey AS article FROM nation),
       b AS (SELECT doc_id, article, coalesce((SELECT string_agg(s_suppkey, '+' ORDER BY s_suppkey) FROM supplier WHERE s_nationkey = article), '') AS subs FROM a)
       SELECT r_regionkey AS doc_id, string_agg(article || ':' || subs, ' ' ORDER BY article) AS tree FROM region LEFT JOIN b ON doc_id = r_regionkey GROUP BY 1""",
)
def g7(t):
    h = G.hierarchy(
        t.region.select(F.col("r_regionkey").alias("doc_id")),
        t.nation.select(F.col("n_regionkey").alias("doc_id"), F.col("n_nationkey").alias("article")),
        t.supplier.select(F.col("s_nationkey").alias("article"), F.col("s_suppkey").alias("subsection")),
    )
    return h.select("doc_id", F.concat_ws(" ", F.transform("articles", lambda a: F.concat(a["article"].cast("string"), F.lit(":"), F.concat_ws("+", a["subsections"].cast("array<string>"))))).alias("tree"))


@query(
    "g8_relationship_graph",
    f"""WITH {EDGES}, one AS (SELECT seed, dst AS id FROM s JOIN e ON seed = src UNION SELECT seed, src FROM s JOIN e ON seed = dst),
       two AS (SELECT seed, b.dst AS id FROM s JOIN e a ON seed = a.src JOIN e b ON a.dst = b.src UNION SELECT seed, b.src FROM s JOIN e a ON seed = a.dst JOIN e b ON a.src = b.dst)
       SELECT seed, id, min(d) AS depth FROM (SELECT *, 1 AS d FROM one UNION ALL SELECT *, 2 FROM two) WHERE seed <> id GROUP BY 1, 2""",
)
def g8(t):
    return G.relationship_graph(seeds(t), edges(t), 2)


@query("a22_isolated", f"WITH {EDGES} SELECT p_partkey AS id FROM part WHERE p_partkey NOT IN (SELECT src FROM e) AND p_partkey NOT IN (SELECT dst FROM e)")
def a22(t):
    return G.isolated(t.part.select(F.col("p_partkey").alias("id")), edges(t))


@query("a23_duplicate_edges", "SELECT count(*) AS triples, CAST(sum(n - 1) AS BIGINT) AS surplus FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag HAVING count(*) > 1)")
def a23(t):
    g = t.lineitem.groupBy("l_orderkey", "l_suppkey", "l_returnflag").agg(F.count("*").alias("n")).where("n > 1")
    return g.agg(F.count("*").alias("triples"), F.sum(F.col("n") - 1).alias("surplus"))


@query("k7_edge_upsert", f"WITH {EDGES} SELECT src, dst, rel FROM e UNION SELECT o_orderkey, o_custkey, 'new' FROM orders WHERE o_orderkey IN (SELECT doc_id FROM documents) AND o_custkey IN (SELECT doc_id FROM documents)")
def k7(t):
    new = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), F.lit("new").alias("rel"))
    return G.upsert_edges(edges(t), new, t.documents.select(F.col("doc_id").alias("id")))


@query("k8_typed_edges", f"WITH {EDGES} SELECT src, dst, rel FROM e UNION SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN 'RELATES_TO' ELSE o_orderpriority END FROM orders WHERE o_orderkey IN (SELECT doc_id FROM documents) AND o_custkey IN (SELECT doc_id FROM documents)")
def k8(t):
    """Edges whose type is a value of the row, and RELATES_TO where that is empty."""
    kind = F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.col("o_orderpriority"))
    new = t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst"), X.or_default(kind, "RELATES_TO").alias("rel"))
    return G.upsert_edges(edges(t), new, t.documents.select(F.col("doc_id").alias("id")))


@query("t7_depth_order", f"WITH {BFS} SELECT seed, id, distance FROM r ORDER BY distance, seed, id LIMIT 10")
def t7(t):
    return G.distances(seeds(t), edges(t), 2).orderBy("distance", "seed", "id").limit(10).select("seed", "id", "distance")


@query("a16_shortest_by_node", f"WITH {BFS} SELECT id, min(distance) AS distance, count(DISTINCT seed) AS seeds FROM r GROUP BY 1")
def a16(t):
    return G.distances(seeds(t), edges(t), 2).groupBy("id").agg(F.min("distance").alias("distance"), F.countDistinct("seed").alias("seeds"))


@query("g11_graph_counts", f"WITH {EDGES} SELECT rel, count(*) AS edges, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM e GROUP BY 1")
def g11(t):
    return edges(t).groupBy("rel").agg(F.count("*").alias("edges"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


@query(
    "g12_citation_bundle",
    f"""WITH {BFS} SELECT seed, id, 'related' AS part FROM r UNION ALL SELECT seed, dst, 'cited' FROM s JOIN e ON seed = src UNION ALL SELECT seed, src, 'citing' FROM s JOIN e ON seed = dst""",
)
def g12(t):
    e, s = edges(t), seeds(t)
    near = G.distances(s, e, 2).select("seed", "id", F.lit("related").alias("part"))
    one = G.neighbours(s, e).select("seed", "id", F.when(F.col("direction") == "outgoing", "cited").otherwise("citing").alias("part"))
    return near.unionByName(one)


@query(
    "k6_node_upsert",
    """WITH c AS (SELECT l_partkey AS id, l_returnflag AS state, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey DESC, l_linenumber DESC) AS rank FROM lineitem)
       SELECT 'Article' AS label, p_partkey AS id, coalesce(state, p_brand) AS state FROM part LEFT JOIN c ON id = p_partkey AND rank = 1
       UNION ALL SELECT 'Article', id, state FROM c WHERE rank = 1 AND id NOT IN (SELECT p_partkey FROM part)
       UNION ALL SELECT 'Document', s_suppkey, s_name FROM supplier""",
)
def k6(t):
    """Nodes of two labels by (label, id): the latest change of each is set, new ones are added."""
    nodes = t.part.select(F.lit("Article").alias("label"), F.col("p_partkey").alias("id"), F.col("p_brand").alias("state"))
    nodes = nodes.unionByName(t.supplier.select(F.lit("Document").alias("label"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("state")))
    changes = t.lineitem.select(F.lit("Article").alias("label"), F.col("l_partkey").alias("id"), F.col("l_returnflag").alias("state"), F.struct("l_orderkey", "l_linenumber").alias("version"))
    table = Versioned.create(nodes, scratch(t.spark), ["label", "id"], 16)
    table.merge(changes, "version")
    return table.read()
