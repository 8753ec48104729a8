"""Queries that chain operators: review, chat, ingestion, quality, evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as X
from ..operators import etl
from ..operators import graph as G
from ..plans import postings as K
from ..plans import retrieval as R
from ..plans import review as V
from ..sources import tables as T
from .base import query
from .graphs import BOTH, EDGES, edges
from .ranking import BM25, WORDS, fielded, fused, fused_list, lexical, with_documents
from .scans import keeping

ONLY_EDGES = EDGES.split(", s AS")[0]
NEG = "(' ' || lower({c}) || ' ') LIKE '% not %'"
TOK = "list_distinct(list_filter(string_split_regex(lower({c}), '\\s+'), lambda x: x <> ''))"


def plain_negation(c):
    return F.concat(F.lit(" "), F.lower(c), F.lit(" ")).contains(" not ")


PAIRS = BM25 + ", p AS (SELECT query_id, r.doc_id, b.text AS clause, d.text AS passage FROM r JOIN benchmark b ON b.item_id = query_id JOIN documents d ON d.doc_id = r.doc_id WHERE rank <= 3)"
LEVEL = f"""
    x AS (SELECT *, {TOK.format(c="clause")} AS a, {TOK.format(c="passage")} AS b, list_distinct(regexp_extract_all(clause, '[0-9]+')) AS na, list_distinct(regexp_extract_all(passage, '[0-9]+')) AS nb FROM p),
    y AS (SELECT *, coalesce(len(list_intersect(a, b)) / nullif(len(list_distinct(list_concat(a, b))), 0), 0) AS j FROM x),
    z AS (SELECT query_id, doc_id, CASE
        WHEN len(list_filter(string_split_regex(lower(clause), '[;.\\n]'), lambda f: length(trim(f, ' ')) > 20 AND contains(lower(passage), trim(f, ' ')))) > 0 THEN 'entailed'
        WHEN ({NEG.format(c="clause")}) <> ({NEG.format(c="passage")}) AND j > 0.6 THEN 'contradicted'
        WHEN len(na) > 0 AND len(nb) > 0 AND len(list_intersect(na, nb)) = 0 AND j > 0.5 THEN 'contradicted' ELSE 'no_reference' END AS level FROM y)"""


def pairs(t):
    h = with_documents(t, lexical(t, 3), F.col("text").alias("passage"))
    return h.join(t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("clause")), "query_id").select("query_id", "doc_id", "clause", "passage")


@query("m13_rule_verifier", PAIRS + "," + LEVEL + " SELECT query_id, doc_id, level FROM z")
def m13(t):
    return V.verified(pairs(t), negated=plain_negation, numbers=V.ascii_numbers).select("query_id", "doc_id", "level")


def supported(rest):
    """A stand-in for a model that sees the pairs no rule decides."""
    return rest.withColumns({"level": F.when(F.col("doc_id") % 2 == 0, "partially_supported").otherwise("no_reference"), "confidence": F.lit(0.5)})


@query(
    "qe_verify",
    PAIRS + "," + LEVEL + " SELECT query_id, doc_id, CASE WHEN level = 'no_reference' AND doc_id % 2 = 0 THEN 'partially_supported' ELSE level END AS level, CASE WHEN level = 'no_reference' THEN 'model' ELSE 'rule' END AS decided_by FROM z",
)
def qe(t):
    """Rules first; a model for the rest."""
    return V.verified(pairs(t), supported, plain_negation, V.ascii_numbers).select("query_id", "doc_id", "level", "decided_by")


CLAUSE = "list_filter(list_transform(string_split_regex(text, '\\n'), lambda c: trim(regexp_replace(c, '\\s+', ' ', 'g'), ' ')), lambda c: length(c) >= 20)"
CLAUSES = f"SELECT item_id * 1000 + i AS item_id, c[i + 1] AS text FROM (SELECT item_id, {CLAUSE} AS c FROM benchmark), unnest(range(len(c))) x(i)"
# of ten hits the better half by score and place, as retrieval.position_decay keeps it
REVIEW = fused_list(10, CLAUSES, 1000) + """, h10 AS (SELECT query_id, doc_id, score, rank - 1 AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM fr WHERE rank <= 10),
    h5 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(0.5 * score + 0.5 * CASE WHEN n <= 1 THEN 1 ELSE 1 - pos / (n - 1) END, 9) DESC, doc_id) AS place FROM h10) WHERE place <= greatest(1, n // 2)),
    p AS (SELECT query_id, h5.doc_id, place, b.text AS clause, d.text AS passage FROM h5 JOIN asked b ON b.item_id = query_id JOIN documents d ON d.doc_id = h5.doc_id),""" + LEVEL


@query(
    "qf_review",
    REVIEW
    + """, o AS (SELECT query_id, min(CASE level WHEN 'contradicted' THEN 0 WHEN 'no_reference' THEN 2 ELSE 3 END) AS s FROM z GROUP BY 1),
       gl AS (SELECT query_id, source, h5.doc_id, score, max(score) OVER (PARTITION BY query_id, source) AS b FROM h5 JOIN documents USING (doc_id)),
       gr AS (SELECT query_id, dense_rank() OVER (PARTITION BY query_id ORDER BY b DESC, source) AS lr, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, doc_id) AS hr FROM gl)
       SELECT 'risk' AS part, d.risk AS name, count(o.s) AS n FROM (VALUES ('high', 0), ('medium', 1), ('low', 2), ('none', 3)) d(risk, s) LEFT JOIN o USING (s) GROUP BY 1, 2
       UNION ALL SELECT 'references', 'unique', count(DISTINCT doc_id) FROM z UNION ALL SELECT 'prompt', 'passages', count(*) FROM gr WHERE lr <= 5 AND hr <= 3
       UNION ALL SELECT 'context', source, count(*) FROM (
         SELECT query_id, id, CASE min(p) WHEN 0 THEN 'amendment' ELSE 'related' END AS source FROM (
           SELECT query_id, CASE WHEN e.src = doc_id THEN e.dst ELSE e.src END AS id, place * 10 + 1 AS k, 1 AS p FROM h5 JOIN (SELECT doc_id AS src, doc_id * 3 % 1000 AS dst, lang AS rel FROM documents) e ON (e.src = doc_id OR e.dst = doc_id) WHERE rel <> 'de' AND place <= 3
         ) GROUP BY 1, 2) GROUP BY 2""",
)
def qf(t):
    """Contracts cut into clauses; each planned, searched, reranked, put in context and in a prompt's groups, verified by rules; the worst finding of each clause, the references, passages and context counted."""
    lines = t.benchmark.select("item_id", F.regexp_replace("text", "\n", "\n\n").alias("text"))
    clauses = T.cut(P.clauses(lines, "item_id").select((F.col("doc_id") * 1000 + F.col("clause_index")).alias("item_id"), F.col("clause").alias("text")), keeping(t.spark), "clauses")
    half = T.cut(R.position_decay(fused(t, 10, clauses, 1000).drop("rank")).select("query_id", "doc_id", "score", "rank"), keeping(t.spark), "half")
    found = V.verified(
        with_documents(t, half, F.col("text").alias("passage")).join(clauses.select(F.col("item_id").alias("query_id"), F.col("text").alias("clause")), "query_id").select("query_id", "doc_id", "clause", "passage"),
        negated=plain_negation, numbers=V.ascii_numbers,
    )
    found = T.cut(V.findings(found), keeping(t.spark), "findings")
    worst = found.groupBy("query_id").agg(F.min(F.when(F.col("risk") == "high", 0).when(F.col("risk") == "medium", 1).when(F.col("risk") == "low", 2).otherwise(3)).alias("s"))
    risks = V.risk_summary(worst.select(F.get(F.array(*map(F.lit, V.RISK_LEVELS)), F.col("s")).alias("risk"))).select(F.lit("risk").alias("part"), F.col("risk").alias("name"), "n")
    refs = V.unique_references(found.select("query_id", F.lit(1).alias("place"), F.col("doc_id").alias("ref_id"))).agg(F.lit("references").alias("part"), F.lit("unique").alias("name"), F.count("*").alias("n"))
    groups = V.grouped_context(with_documents(t, half, F.col("source").alias("law_id")).select("query_id", "law_id", "doc_id", "score"))
    prompt = groups.agg(F.lit("prompt").alias("part"), F.lit("passages").alias("name"), F.coalesce(F.sum(F.size(F.split("context", " "))), F.lit(0)).cast("long").alias("n"))
    e = edges(t).where("rel <> 'de'").select("src", "dst", F.lit("REFERENCES").alias("rel"))
    around = G.context(half.select("query_id", F.col("doc_id").alias("id"), "rank"), e, e.limit(0), top_k=3)
    return risks.unionByName(refs).unionByName(prompt).unionByName(around.groupBy(F.lit("context").alias("part"), F.col("source").alias("name")).agg(F.count("*").alias("n")))


TREE = "CASE WHEN doc_id % 2 = 0 THEN 'AMENDED_BY' ELSE 'CITES' END"
AROUND = f"""tree AS (SELECT doc_id // 4 AS src, doc_id AS dst FROM documents WHERE doc_id // 4 <> doc_id), refs AS (SELECT doc_id AS src, doc_id * 3 % 1000 AS dst, {TREE} AS rel FROM documents),
    st AS (SELECT src_ AS src, dst_ AS dst FROM (SELECT doc_id AS src_, doc_id * 7 % 1000 AS dst_ FROM documents)),
    near AS (SELECT query_id, rank, src AS id, 0 AS p FROM k0 JOIN tree ON tree.dst = k0.id UNION ALL SELECT query_id, rank, b.dst, 1 FROM k0 JOIN tree ON tree.dst = k0.id JOIN tree b ON b.src = tree.src WHERE b.dst <> k0.id
          UNION ALL SELECT query_id, rank, dst, 2 FROM k0 JOIN refs ON src = id WHERE rel = 'AMENDED_BY' UNION ALL SELECT query_id, rank, dst, 3 FROM k0 JOIN refs ON src = id WHERE rel = 'CITES' UNION ALL SELECT query_id, rank, src, 3 FROM k0 JOIN refs ON dst = id WHERE rel = 'CITES'
          UNION ALL SELECT query_id, rank, dst, 4 FROM k0 JOIN st ON src = id UNION ALL SELECT query_id, rank, src, 4 FROM k0 JOIN st ON dst = id),
    k1 AS (SELECT query_id, id, min(rank * 10 + p) AS f FROM near GROUP BY 1, 2),
    around AS (SELECT query_id, id, ['parent', 'sibling', 'amendment', 'related', 'stored'][f % 10 + 1] AS source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, id) AS INTEGER) AS place FROM k1)"""


def around(t, hits, top_k=5):
    """The context of hits in a tree of documents, with amendments, citations and stored relationships."""
    d, i = t.documents, F.col("doc_id")
    tree = d.select(F.expr("doc_id div 4").alias("src"), i.alias("dst"), F.lit("CONTAINS").alias("rel")).where("src <> dst")
    cites = d.select(i.alias("src"), (i * 3 % 1000).alias("dst"), F.expr(TREE).alias("rel"))
    return G.context(hits, tree.unionByName(cites), d.select(i.alias("src"), (i * 7 % 1000).alias("dst")), top_k=top_k)


@query("g9_context_injection", f"WITH k0 AS (SELECT item_id AS query_id, item_id AS id, 1 AS rank FROM benchmark UNION ALL SELECT item_id, item_id + 5, 2 FROM benchmark), {AROUND} SELECT * FROM around")
def g9(t):
    """What stands around two hits of each query in the graph."""
    b, i = t.benchmark, F.col("item_id")
    return around(t, b.select(i.alias("query_id"), i.alias("id"), F.lit(1).alias("rank")).unionByName(b.select(i.alias("query_id"), (i + 5).alias("id"), F.lit(2).alias("rank"))))


@query("qg_chat_context", fused_list(5) + f", k0 AS (SELECT query_id, doc_id AS id, rank FROM fr WHERE rank <= 5), {AROUND} SELECT query_id, id, 'retrieved' AS source, CAST(rank AS INTEGER) AS place FROM k0 UNION ALL SELECT query_id, id, source, 5 + place FROM around WHERE (query_id, id) NOT IN (SELECT (query_id, id) FROM k0)")
def qg(t):
    """A chat's context: the hits of its text without a plan, then what stands around them."""
    h = T.cut(fused(t, 5).select("query_id", F.col("doc_id").alias("id"), "rank"), keeping(t.spark), "hits")
    more = around(t, h).join(h.select("query_id", "id"), ["query_id", "id"], "left_anti")
    return h.select("query_id", "id", F.lit("retrieved").alias("source"), F.col("rank").cast("int").alias("place")).unionByName(more.select("query_id", "id", "source", (F.col("place") + 5).cast("int").alias("place")))


@query(
    "qh_chat_citations",
    BM25
    + f""", {ONLY_EDGES}, k AS (SELECT query_id, doc_id, rank FROM r WHERE rank <= 3),
       l AS (SELECT DISTINCT query_id, doc_id, rank, dst AS related, rel, 'outgoing' AS d FROM k JOIN e ON src = doc_id UNION SELECT query_id, doc_id, rank, src, rel, 'incoming' FROM k JOIN e ON dst = doc_id),
       m AS (SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY d DESC, related, rel) AS n FROM l),
       u AS (SELECT query_id, doc_id, rank * 10 AS f, NULL AS via FROM k UNION ALL SELECT query_id, related, rank * 10 + n, doc_id FROM m WHERE n <= 2),
       v AS (SELECT query_id, doc_id, min(f) AS f, arg_min(coalesce(via, -1), f) AS via FROM u GROUP BY 1, 2)
       SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY f, doc_id) AS INTEGER) AS n, doc_id, nullif(via, -1) AS via FROM v""",
)
def qh(t):
    """Citations of a chat: the hits, each with up to two related documents, none twice."""
    h = lexical(t, 3)
    return V.cited_with_related(h, V.related_for_hits(h.select("query_id", "doc_id"), edges(t), 2))


@query(
    "qb_search_with_relationships",
    fused_list(10)
    + f""", {ONLY_EDGES}, {BOTH.replace("FROM e", "FROM e WHERE rel IN ('en', 'fr')")}, g AS (SELECT DISTINCT item_id AS query_id, dst AS doc_id, TRUE AS related FROM benchmark JOIN u ON item_id = src),
       o AS (SELECT query_id, doc_id, round(score * CASE WHEN related THEN 1.2 ELSE 1 END, 6) AS score FROM fr LEFT JOIN g USING (query_id, doc_id) WHERE rank <= 10),
       p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS i FROM o QUALIFY i < 5), w AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS m FROM p)
       SELECT query_id, doc_id, score, CAST(CASE WHEN m <= 2 THEN i WHEN i % 2 = 0 THEN i // 2 ELSE m - 1 - i // 2 END AS INTEGER) AS place FROM w""",
)
def qb(t):
    """Twice as many hits as asked for, those raised that a typed edge joins with the query's own document, cut, in reading order."""
    near = G.neighbours(t.benchmark.select(F.col("item_id").alias("id")), edges(t), ["en", "fr"]).select(F.col("seed").alias("query_id"), F.col("id").alias("doc_id"))
    b = R.boost_related(fused(t, 10), near).withColumn("score", F.round("score", 6)).drop("rank", "original")
    return R.sandwich(R.ranked(b, 5).drop("rank")).select("query_id", "doc_id", "score", "place")


@query(
    "qi_ingest_batch",
    f"""WITH d AS (SELECT doc_id, text, length(trim(text, ' ')) >= 50 AS ok FROM documents), w AS (SELECT doc_id, {WORDS.format(c="text")} AS w FROM d WHERE ok)
       SELECT 'rejected' AS store, count(*) AS n FROM d WHERE NOT ok UNION ALL SELECT 'documents', count(DISTINCT doc_id) FROM d WHERE ok UNION ALL SELECT 'articles', 2 * count(*) FROM d WHERE ok
       UNION ALL SELECT 'edges', count(*) FROM d a JOIN d b ON b.doc_id = a.doc_id + 1 WHERE a.ok AND b.ok UNION ALL SELECT 'chunked', count(*) FROM d WHERE ok AND len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) * 1.3 >= 100
       UNION ALL SELECT 'postings', CAST(sum(len(list_distinct(w))) AS BIGINT) FROM w""",
)
def qi(t):
    """A batch: normalised, validated, parsed, stored by id over an earlier edition; of what is stored, references are resolved to edges, articles cut into chunks, and chunks indexed; what each store gets.

    Each text is the body of a law with a number, a citation and two headings; headings and citations of its own count as well.
    """
    batch = T.cut(t.documents.select("doc_id", X.nfc("text").alias("text")), keeping(t.spark), "batch")
    good, bad = etl.validated(batch, {"length": etl.long_enough(F.col("text"))})
    i = F.col("doc_id")
    law = F.concat(F.lit("Luật số "), i, F.lit("/2020/QH14. Căn cứ "), i + 1, F.lit("/2020/QH14.\nĐiều 1.\n"), F.col("text"), F.lit("\nĐiều 2.\n"))
    parsed = P.documents(good.select("doc_id", law.alias("text"))).select("doc_id", "document_number", "content")
    before = good.select("doc_id", F.concat(i, F.lit("/2019/QH14")).alias("document_number"), F.lit("").alias("content"))
    # of rows with one id, a hash of the text decides
    stored = etl.upsert(before, parsed.withColumn("v", F.xxhash64("content")), ["doc_id"], "v")
    found = stored.select("doc_id", "document_number", P.reference_numbers(F.col("content")).alias("refs"), P.articles("content").alias("a"))
    body = F.array_join(F.transform("a", lambda x: F.concat_ws("\n", x["title"], x["content"])), "\n")
    cut = found.select("doc_id", "document_number", "refs", F.size("a").alias("articles"), body.alias("body")).withColumn("c", P.chunks("body"))
    # a text too short for chunks is indexed whole
    pieces = F.when(F.size("c") > 0, F.col("c.content")).otherwise(F.array("body"))
    made = T.cut(cut.select("doc_id", "document_number", "refs", "articles", F.size("c").alias("chunks"), pieces.alias("pieces")), keeping(t.spark), "ingested")
    numbers = made.select(i.alias("dst"), F.col("document_number").alias("needle"))
    refs = made.select(i.alias("src"), F.inline("refs")).where("rel = 'CITES'").join(numbers, "needle").select("src", "dst", "rel")
    # pieces move once, by document: both groupings of their words are then in place
    parts = made.select("doc_id", "pieces").repartition("doc_id").select("doc_id", F.posexplode("pieces").alias("piece", "content"))
    index = R.postings(parts, X.analyze(F.col("content")), within=["piece"])
    n = lambda name, df: df.agg(F.lit(name).alias("store"), F.count("*").alias("n"))
    articles = made.agg(F.lit("articles").alias("store"), F.coalesce(F.sum("articles"), F.lit(0)).cast("long").alias("n"))
    out = n("rejected", bad).unionByName(n("documents", made)).unionByName(articles).unionByName(n("edges", G.dedup_edges(refs, ["src", "dst", "rel"], ["src"])))
    return out.unionByName(n("chunked", made.where("chunks > 0"))).unionByName(n("postings", index.select("doc_id", "term").distinct()))


@query(
    "qj_dataset_prepare",
    """SELECT d.doc_id, quality, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE 'other' END AS kind FROM
       (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) d JOIN labels l ON l.doc_id = d.doc_id WHERE r = 1 AND length(trim(text, ' ')) >= 50""",
)
def qj(t):
    # the first row of each text, by digest: whole texts move only for these
    first = etl.keep_first(t.documents.select("doc_id", F.sha2("text", 256).alias("h")), ["h"], ["doc_id"]).select("doc_id")
    p = etl.prepare(t.labels, t.documents.join(first, "doc_id", "left_semi"), "doc_id", "text", ["doc_id"])
    return p.select("doc_id", "quality", X.map_type(F.col("lang"), {"en": "english", "de": "german"}).alias("kind"))


@query(
    "qk_quality_report",
    f"""WITH {EDGES}, g AS (SELECT count(*) AS c FROM documents GROUP BY text HAVING count(*) > 1)
       SELECT 'documents' AS name, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'empty', CAST(count(*) AS DOUBLE) FROM documents WHERE trim(coalesce(text, '')) = ''
       UNION ALL SELECT 'short', CAST(count(*) AS DOUBLE) FROM documents WHERE n_chars < 50 UNION ALL SELECT 'long', CAST(count(*) AS DOUBLE) FROM documents WHERE n_chars >= 10000
       UNION ALL SELECT 'mean_length', round(avg(length(text)), 4) FROM documents UNION ALL SELECT 'longest', CAST(max(length(text)) AS DOUBLE) FROM documents
       UNION ALL SELECT 'duplicate_texts', CAST(count(*) AS DOUBLE) FROM g UNION ALL SELECT 'copies', CAST(coalesce(sum(c - 1), 0) AS DOUBLE) FROM g UNION ALL SELECT 'largest_group', CAST(coalesce(max(c), 0) AS DOUBLE) FROM g
       UNION ALL SELECT 'edges', CAST(count(*) AS DOUBLE) FROM e UNION ALL SELECT 'orphan_edges', CAST(count(*) AS DOUBLE) FROM e WHERE dst NOT IN (SELECT doc_id FROM documents)
       UNION ALL SELECT 'isolated', CAST(count(*) AS DOUBLE) FROM documents WHERE doc_id NOT IN (SELECT src FROM e WHERE src <> dst UNION SELECT dst FROM e WHERE src <> dst)
       UNION ALL SELECT 'unlabelled', CAST(count(*) AS DOUBLE) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'labels_without_text', CAST(count(*) AS DOUBLE) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
       UNION ALL SELECT 'length_mismatch', CAST(count(*) AS DOUBLE) FROM documents WHERE n_chars <> length(text)""",
)
def qk(t):
    """Content, duplicates, relationships, and metadata against content."""
    d, e = t.documents, edges(t)
    n = lambda name, df: df.agg(F.lit(name).alias("name"), F.count("*").cast("double").alias("value"))
    # one pass for what rows tell by themselves; duplicates by digest: whole texts do not move
    length = F.length("text")
    own = {
        "documents": F.count("*"), "empty": F.count_if(etl.blank(F.col("text"))), "short": F.count_if(F.col("n_chars") < 50), "long": F.count_if(F.col("n_chars") >= 10000),
        "mean_length": F.round(F.avg(length), 4), "longest": F.max(length), "length_mismatch": F.count_if(F.col("n_chars") != length),
    }
    one = d.agg(*(v.cast("double").alias(k) for k, v in own.items()))
    groups = etl.duplicate_keys(d.select(F.sha2("text", 256).alias("h")), "h").agg(
        F.count("*").cast("double").alias("duplicate_texts"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("double").alias("copies"), F.coalesce(F.max("n"), F.lit(0)).cast("double").alias("largest_group")
    )
    rows = lambda df: df.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in df.columns))))
    ids, labels = d.select("doc_id"), t.labels.select("doc_id")
    parts = [
        rows(one), rows(groups), n("edges", e), n("orphan_edges", etl.orphan_edges(e, ids, "doc_id")), n("isolated", G.isolated(ids.select(F.col("doc_id").alias("id")), e.where("src <> dst"))),
        n("unlabelled", ids.join(labels, "doc_id", "left_anti")), n("labels_without_text", labels.join(ids, "doc_id", "left_anti")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query(
    "ql_evaluation",
    fused_list(20) + """, e AS (SELECT item_id AS query_id, doc_id FROM benchmark, documents WHERE contains(documents.text, benchmark.text)), m AS (SELECT e.query_id, count(*) AS must, count(k.doc_id) AS matched FROM e LEFT JOIN (SELECT * FROM fr WHERE rank <= 20) k ON k.query_id = e.query_id AND k.doc_id = e.doc_id GROUP BY 1)
       SELECT query_id, must, matched, round(matched / must, 6) AS recall, CASE WHEN round(matched / must, 6) >= 0.67 THEN 'pass' WHEN round(matched / must, 6) >= 0.33 THEN 'partial' ELSE 'fail' END AS status FROM m""",
)
def ql(t):
    """Documents that hold a benchmark text word for word are what search must find.

    Candidates have all words of the text but its first and last, which can be parts of longer ones, by the
    index that search reads; only their texts are compared. Texts of two words or less are looked for everywhere.
    """
    return V.recall(holders(t, t.benchmark.select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))), fused(t, 20))


def holders(t, q):
    """(query_id, doc_id): documents with a text that holds the needle. q (query_id, needle)."""
    w = X.analyze(F.col("needle"))
    q = T.cut(q.where("needle is not null").select("query_id", "needle", F.array_distinct(F.slice(w, F.lit(2), F.greatest(F.size(w) - 2, F.lit(0)))).alias("inner")), keeping(t.spark), "needles")
    terms = q.select("query_id", F.lit(0).alias("list"), F.explode("inner").alias("term"))
    every = K.Measure([(0, "content")], [1.0], lambda s, n, uniq: np.where(s[0] >= n, 1.0, 0.0), counts=True)
    found = with_documents(t, K.search(fielded(t), terms, None, every).select("query_id", "doc_id"), "text").join(q.select("query_id", "needle"), "query_id")
    short = t.documents.select("doc_id", "text").join(R.sent(q.where(F.size("inner") == 0).select("query_id", "needle")), F.col("text").contains(F.col("needle")))
    return found.where(F.col("text").contains(F.col("needle"))).select("query_id", "doc_id").unionByName(short.select("query_id", "doc_id"))


@query(
    "qn_reindex_articles",
    """SELECT doc_id, '1' AS article_no, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS digest FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '2', md5(source) FROM documents WHERE doc_id % 2 = 0
       UNION ALL SELECT doc_id, '0', md5(text) FROM documents WHERE doc_id % 2 <> 0""",
)
def qn(t):
    """All documents, cut into articles; those without are their own."""
    made = F.concat(F.lit("Article 1. One\n"), F.col("text"), F.lit("\nArticle 2. Two\n"), F.col("source"))
    d = t.documents.select("doc_id", F.when(F.col("doc_id") % 2 == 0, made).otherwise(F.col("text")).alias("text"))
    parts = d.select("doc_id", "text", P.articles("text").alias("a"))
    whole = F.array(F.struct(F.lit("0").alias("number"), F.col("text").alias("content")))
    cut = F.when(F.size("a") > 0, F.transform("a", lambda x: F.struct(x["number"].alias("number"), x["content"].alias("content")))).otherwise(whole)
    return parts.select("doc_id", F.explode(cut).alias("p")).select("doc_id", F.col("p.number").alias("article_no"), F.md5("p.content").alias("digest"))


@query("g10_extracted_edges", "SELECT a.p_partkey AS src, b.p_partkey AS dst, CASE b.p_partkey - a.p_partkey WHEN 1 THEN 'CITES' ELSE 'AMENDED_BY' END AS rel FROM part a JOIN part b ON b.p_partkey - a.p_partkey IN (1, 2)")
def g10(t):
    made = F.concat(F.lit("Căn cứ "), F.col("p_partkey") + 1, F.lit("/2020/QH14. Sửa đổi "), F.col("p_partkey") + 2, F.lit("/2020/QH14."))
    docs = t.part.select(F.col("p_partkey").alias("doc_id"), made.alias("text"))
    refs = P.references(docs)
    number = docs.select(F.col("doc_id").alias("dst"), F.concat(F.col("doc_id"), F.lit("/2020/QH14")).alias("needle"))
    return refs.join(number, "needle").select("src", "dst", "rel")
