"""Property graphs as tables: nodes(id, label, ...) and edges(src, dst, rel).

Depths are small and bounded, so traversals are unrolled joins; the frontier
is made distinct before each step, and edges are read by their key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

MOST_DEPTH = 10


def depth_of(depth: int, default: int = 2) -> int:
    """A depth within bounds, else the default."""
    return depth if 1 <= depth <= MOST_DEPTH else default


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in both directions, with ``direction``."""
    out = edges.select("src", "dst", "rel", F.lit("outgoing").alias("direction"))
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel", F.lit("incoming").alias("direction"))
    return out.unionByName(back)


def neighbours(seeds: DataFrame, edges: DataFrame, rels: Sequence[str] | None = None) -> DataFrame:
    """(seed, id, rel, direction): one step in either direction."""
    e = edges if rels is None else edges.where(F.col("rel").isin(*rels))
    return both_ways(e).join(seeds.select(F.col("id").alias("src")).distinct(), "src").select(F.col("src").alias("seed"), F.col("dst").alias("id"), "rel", "direction")


def related_ids(seeds: DataFrame, edges: DataFrame, rels: Sequence[str] | None = None) -> DataFrame:
    """Distinct ids next to a seed, seeds left out."""
    return neighbours(seeds, edges, rels).select("id").distinct().join(seeds.select("id").distinct(), "id", "left_anti")


HUB = 100_000  # edges from which a node is a hub, at least
MOST_HUBS = 10_000  # hubs there can be: a hub has more than this share of all edges


def dealt(step: DataFrame, hub: int = HUB) -> tuple[DataFrame, DataFrame]:
    """``step`` (src, dst) with ``part``, and the hubs (src, parts): the edges of a hub are dealt over as many parts as they need."""
    degrees = step.groupBy("src").agg(F.count("*").alias("n"))
    total = degrees.agg(F.sum("n")).first()[0] or 0
    often = max(hub, total // MOST_HUBS)
    hubs = degrees.where(F.col("n") > often).select("src", F.ceil(F.col("n") / often).cast("int").alias("parts"))
    part = F.coalesce(F.pmod(F.xxhash64("dst"), F.col("parts")), F.lit(0)).cast("int")
    return step.join(F.broadcast(hubs), "src", "left").select("src", "dst", part.alias("part")), hubs  # MOST_HUBS rows at most


def along(front: DataFrame, step: DataFrame, hubs: DataFrame) -> DataFrame:
    """``front`` (id, ...) with the edges that leave each id; one that is at a hub goes to all parts of its edges."""
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
    at = front.join(F.broadcast(hubs), F.col("id") == F.col("src"), "left").select(*front.columns, every)  # MOST_HUBS rows at most
    return at.withColumnRenamed("id", "src").join(step, ["src", "part"]).drop("part")


def distances(seeds: DataFrame, edges: DataFrame, depth: int = 2, directed: bool = False) -> DataFrame:
    """(seed, id, distance): nodes within ``depth`` steps of each seed, itself left out, at their least distance."""
    step, hubs = dealt((edges if directed else both_ways(edges)).select("src", "dst").distinct())
    seen = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("distance")).distinct()
    front = seen
    for d in range(1, depth_of(depth) + 1):
        reached = along(front.select("seed", "id"), step, hubs).select("seed", F.col("dst").alias("id")).distinct()
        front = reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("distance", F.lit(d))
        seen = seen.unionByName(front)
    return seen.where("distance > 0")


def nearest(seeds: DataFrame, edges: DataFrame, depth: int = 2, top: int = 10) -> DataFrame:
    """The ``top`` nearest nodes of each seed, ties by id."""
    w = Window.partitionBy("seed").orderBy("distance", "id")
    return distances(seeds, edges, depth).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def seed_expansion(seeds: DataFrame, edges: DataFrame, depth: int = 2, top: int = 10) -> DataFrame:
    """(id, seed_count, distance): what several seeds reach, by how many and how near."""
    found = distances(seeds, edges, depth).groupBy("id").agg(F.countDistinct("seed").alias("seed_count"), F.min("distance").alias("distance"))
    return found.orderBy(F.desc("seed_count"), "distance", "id").limit(top)


def paths(seeds: DataFrame, edges: DataFrame, depth: int = 2, last: Column | None = None) -> DataFrame:
    """(seed, id, depth, rel, trail): directed paths of up to ``depth`` edges, none used twice; each path is a row.

    edges need a key ``eid``. ``last``: a predicate on the last edge's rel.
    """
    front = seeds.select(F.col("id").alias("seed"), "id", F.array().cast("array<string>").alias("trail"), F.lit(None).cast("string").alias("rel"))
    out = None
    e = edges.select("src", "dst", F.col("rel").alias("r_"), F.col("eid").cast("string").alias("e_"))
    for d in range(1, depth_of(depth) + 1):
        front = (
            front.join(e, F.col("id") == F.col("src"))
            .where(~F.array_contains("trail", F.col("e_")))
            .select("seed", F.col("dst").alias("id"), F.concat("trail", F.array("e_")).alias("trail"), F.col("r_").alias("rel"))
        )
        level = front.withColumn("depth", F.lit(d))
        out = level if out is None else out.unionByName(level)
    out = out if last is None else out.where(last)
    return out.select("seed", "id", "depth", "rel", F.array_join("trail", ">").alias("trail"))


def parents(nodes: DataFrame, edges: DataFrame, rel: str = "CONTAINS") -> DataFrame:
    """(id, parent)."""
    return nodes.select("id").join(edges.where(F.col("rel") == rel).select(F.col("dst").alias("id"), F.col("src").alias("parent")), "id")


def citing(ids: DataFrame, edges: DataFrame, rels: Sequence[str] = ("CITES", "REFERENCES"), top: int = 10) -> DataFrame:
    """The first ``top`` nodes that cite each id."""
    found = edges.where(F.col("rel").isin(*rels)).join(ids.select(F.col("id").alias("dst")).distinct(), "dst").select(F.col("dst").alias("id"), F.col("src").alias("citing")).distinct()
    w = Window.partitionBy("id").orderBy("citing")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def hierarchy(docs: DataFrame, articles: DataFrame, subsections: DataFrame) -> DataFrame:
    """(doc_id, articles): each document's articles, each with its subsections; both optional.

    docs(doc_id), articles(doc_id, article), subsections(article, subsection).
    """
    sub = subsections.groupBy("article").agg(F.array_sort(F.collect_set("subsection")).alias("subsections"))
    art = articles.join(sub, "article", "left").select("doc_id", F.struct("article", F.coalesce("subsections", F.array()).alias("subsections")).alias("a"))
    tree = art.groupBy("doc_id").agg(F.array_sort(F.collect_set("a")).alias("articles"))
    return docs.select("doc_id").join(tree, "doc_id", "left")


def second_degree(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """(seed, id, direction): distinct nodes two edges off, all outgoing or all incoming, the seed left out."""
    e1, e2 = edges.select("src", "dst"), edges.select(F.col("src").alias("s2"), F.col("dst").alias("d2"))
    s = seeds.select(F.col("id").alias("seed")).distinct()
    out = s.join(e1, F.col("seed") == F.col("src")).join(e2, F.col("dst") == F.col("s2")).select("seed", F.col("d2").alias("id"), F.lit("outgoing").alias("direction"))
    back = s.join(e1, F.col("seed") == F.col("dst")).join(e2, F.col("src") == F.col("d2")).select("seed", F.col("s2").alias("id"), F.lit("incoming").alias("direction"))
    return out.unionByName(back).where("seed <> id").distinct()


def relationship_graph(seeds: DataFrame, edges: DataFrame, depth: int = 1) -> DataFrame:
    """(seed, id, depth): the least depth, 1 or 2, at which each node appears."""
    one = neighbours(seeds, edges).where("seed <> id").select("seed", "id", F.lit(1).alias("depth"))
    every = one if depth < 2 else one.unionByName(second_degree(seeds, edges).select("seed", "id", F.lit(2).alias("depth")))
    return every.groupBy("seed", "id").agg(F.min("depth").alias("depth"))


def isolated(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    return nodes.select("id").join(edges.select(F.col("src").alias("id")), "id", "left_anti").join(edges.select(F.col("dst").alias("id")), "id", "left_anti")


def injected(sources: Sequence[tuple[str, DataFrame]], top: int | None = None) -> DataFrame:
    """(query_id, id, source): context from several sources in their order; of repeats, the first stays."""
    parts = [df.select("query_id", "id", F.lit(n).alias("source"), F.lit(i).alias("p_")) for i, (n, df) in enumerate(sources)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("p_", "source")).alias("f")).select("query_id", "id", "f.source", "f.p_")
    w = Window.partitionBy("query_id").orderBy("p_", "id")
    out = first.withColumn("place", F.row_number().over(w)).drop("p_")
    return out if top is None else out.where(F.col("place") <= top)


SOURCES = ("parent", "sibling", "amendment", "related", "stored")


def context(hits: DataFrame, edges: DataFrame, stored: DataFrame, contains: str = "CONTAINS", amended: Sequence[str] = ("AMENDED_BY",), related: Sequence[str] = ("CITES", "REFERENCES", "RELATES_TO"), top_k: int = 5) -> DataFrame:
    """(query_id, id, source, place): what stands around the first ``top_k`` hits of each query.

    hits (query_id, id, rank), edges (src, dst, rel), stored (src, dst): hit by
    hit its parent, the other children of that, amendments, related nodes in
    either direction, and what the stored relationships say; each node once,
    where it comes first.
    """
    h = hits.where(F.col("rank") <= top_k).select("query_id", "id", "rank")
    typed = lambda rels: edges.where(F.col("rel").isin(*rels)).select("src", "dst").distinct()
    children = typed([contains])
    up = h.join(children, F.col("id") == F.col("dst")).select("query_id", "rank", "id", F.col("src").alias("parent"))
    beside = up.join(children, F.col("parent") == F.col("src")).where(F.col("dst") != F.col("id")).select("query_id", "rank", F.col("dst").alias("id"))
    out = lambda e: h.join(e, F.col("id") == F.col("src")).select("query_id", "rank", F.col("dst").alias("id"))
    either = lambda e: e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    parts = [up.select("query_id", "rank", F.col("parent").alias("id")), beside, out(typed(amended)), out(either(typed(related))), out(either(stored.select("src", "dst").distinct()))]
    every = None
    for i, p in enumerate(parts):
        p = p.withColumn("p_", F.lit(i))
        every = p if every is None else every.unionByName(p)
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("rank", "p_")).alias("f"))
    w = Window.partitionBy("query_id").orderBy("f.rank", "f.p_", "id")
    return first.select("query_id", "id", F.get(F.array(*map(F.lit, SOURCES)), F.col("f.p_")).alias("source"), F.row_number().over(w).alias("place"))


def upsert_edges(edges: DataFrame, new: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges and new ones whose ends exist, each (src, dst, rel) once."""
    n = nodes.select(F.col("id").alias("n_")).distinct()
    ok = new.join(n, F.col("src") == F.col("n_"), "left_semi").join(n, F.col("dst") == F.col("n_"), "left_semi")
    return edges.select("src", "dst", "rel").unionByName(ok.select("src", "dst", "rel")).dropDuplicates(["src", "dst", "rel"])


def dedup_edges(edges: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first edge of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return edges.withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")


GRAM = 3  # characters of the pieces by which titles are found


def _grams(text: Column, sizes: Sequence[int]) -> Column:
    """The distinct pieces of ``text`` of each of the sizes."""
    one = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    return F.array_distinct(F.filter(F.concat(*map(one, sizes)), lambda g: F.length(g).isin(*sizes)))


def titled(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(ref_id, doc_id): the smallest document of a reference's kind and year whose title contains its needle, whatever the case.

    A title that contains a needle has all pieces of it; so titles are looked up
    by the needle's piece that the fewest have, and only these compared. Needles
    shorter than a piece are looked up as they are; an empty one is in any title.
    """
    needle = refs.select("kind", "year", F.lower("needle").alias("needle")).where("kind is not null and year is not null and needle is not null").distinct()
    sizes = list(range(1, GRAM + 1))
    parts = needle.where("needle <> ''").select("kind", "year", "needle", F.explode(_grams(F.col("needle"), sizes)).alias("gram"))
    parts = parts.where(F.length("gram") == F.least(F.length("needle"), F.lit(GRAM)))
    titles = docs.select("doc_id", "kind", "year", F.lower("title").alias("title")).where("title is not null")
    wanted = parts.select("kind", "year", "gram").distinct()
    posted = titles.select("doc_id", "kind", "year", F.explode(_grams(F.col("title"), sizes)).alias("gram")).join(wanted, ["kind", "year", "gram"], "left_semi")
    often = posted.groupBy("kind", "year", "gram").agg(F.count("*").alias("df"))
    rarest = parts.join(often, ["kind", "year", "gram"]).groupBy("kind", "year", "needle").agg(F.min(F.struct("df", "gram")).alias("r")).select("kind", "year", "needle", F.col("r.gram").alias("gram"))
    near = posted.join(rarest, ["kind", "year", "gram"]).select("doc_id", "kind", "year", "needle")
    sure = near.where(F.length("needle") <= GRAM)
    compared = near.where(F.length("needle") > GRAM).join(titles.select("doc_id", "title"), "doc_id").where(F.col("title").contains(F.col("needle"))).drop("title")
    any_title = titles.groupBy("kind", "year").agg(F.min("doc_id").alias("doc_id")).join(needle.where("needle = ''"), ["kind", "year"]).select("doc_id", "kind", "year", "needle")
    first = sure.unionByName(compared).unionByName(any_title).groupBy("kind", "year", "needle").agg(F.min("doc_id").alias("doc_id"))
    return refs.withColumn("needle", F.lower("needle")).join(first, ["kind", "year", "needle"]).select("ref_id", "doc_id")


def resolve(refs: DataFrame, docs: DataFrame) -> DataFrame:
    """(ref_id, doc_id): the document each reference means, best first.

    refs(ref_id, kind, year, needle), docs(doc_id, kind, year, number, title).
    Among documents of equal kind and year, an equal number beats a title that
    contains the needle, then the smaller id. Numbers are an equal join; only
    references without one look at titles.
    """
    numbers = docs.select("kind", "year", F.col("number").alias("needle"), "doc_id").groupBy("kind", "year", "needle").agg(F.min("doc_id").alias("doc_id"))
    by_number = refs.join(numbers, ["kind", "year", "needle"]).select("ref_id", "doc_id")
    rest = refs.join(by_number.select("ref_id"), "ref_id", "left_anti")
    return by_number.unionByName(titled(rest, docs)).groupBy("ref_id").agg(F.min("doc_id").alias("doc_id"))
