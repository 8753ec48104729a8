"""Sources, sinks and predicates."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import etl
from ..sources import tables as S
from ..sources.versions import Versioned
from .base import query

TYPES = {"click": "nhap", "view": "xem", "purchase": "mua"}


def scratch(spark) -> str:
    """A folder for tables that a query writes and reads back: the shared one that the cluster names; a temporary one in one process only."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = f"{(named or 'file://' + tempfile.gettempdir()).rstrip('/')}/corvid-{os.getpid()}-{os.urandom(6).hex()}"
    if path.startswith("file:") and spark.sparkContext.master.startswith("local"):
        atexit.register(shutil.rmtree, re.sub("^file:(?://)?", "", path), ignore_errors=True)
    return path


_kept: dict[str, str] = {}


def keeping(spark) -> str:
    """The folder of indexes that all queries of an application share."""
    return _kept.setdefault(spark.sparkContext.applicationId, f"{scratch(spark)}/kept")


# --- sources


@query("s1_parquet_scan", "SELECT doc_id, lang, n_chars FROM documents WHERE n_chars >= 2000")
def s1(t):
    return S.parquet(t.spark, f"{t.sf_dir}/documents.parquet", ["doc_id", "lang", "n_chars"]).where("n_chars >= 2000")


@query("s2_cached_source", "SELECT p_partkey, p_brand FROM part")
def s2(t):
    """A table read by way of a copy, twice: the second time it is not copied."""
    base = scratch(t.spark)
    S.cached(t.spark, f"{t.sf_dir}/part.parquet", f"{base}/part")
    return S.cached(t.spark, f"{t.sf_dir}/part.parquet", f"{base}/part").select("p_partkey", "p_brand")


@query("s3_aliased_source", "SELECT CAST(doc_id AS VARCHAR) AS id, text AS content, source AS title FROM documents")
def s3(t):
    return S.aliased(t.documents, {"id": ["id", "doc_id"], "title": ["title", "name", "source"], "content": ["content", "text", "body"]})


@query("s4_file_source", "SELECT item_id, md5(text) AS digest FROM benchmark")
def s4(t):
    """Texts written as files, and read back whole."""
    path = scratch(t.spark)
    t.benchmark.select("text", F.col("item_id").cast("string").alias("item_id")).repartition("item_id").write.partitionBy("item_id").option("lineSep", "\u0001").text(path)
    files = S.text_files(t.spark, f"{path}/*")
    one = F.regexp_replace("text", "\u0001$", "")
    return files.select(F.regexp_extract("path", r"item_id=(\d+)", 1).cast("long").alias("item_id"), one.alias("x")).select("item_id", F.md5("x").alias("digest"))


@query("s5_in_memory", "SELECT * FROM (VALUES ('a', 'first text'), ('b', NULL)) v(id, content)")
def s5(t):
    return S.in_memory(t.spark, [{"id": "a", "content": "first text"}, {"id": "b"}], "id string, content string")


@query("s6_ordered_scan", "SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 100")
def s6(t):
    return t.events.select("event_id", "ts").orderBy("ts", "event_id").limit(100)


@query("s7_id_lookup", "SELECT CAST(item_id AS INTEGER) AS place, doc_id, lang, source FROM benchmark JOIN documents ON doc_id = item_id * 7 % 200")
def s7(t):
    ids = t.benchmark.select((F.col("item_id") * 7 % 200).alias("doc_id"), F.col("item_id").cast("int").alias("place"))
    return S.lookup(ids, t.documents.select("doc_id", "lang", "source"), "doc_id")


@query("s8_point_lookup", "SELECT doc_id, text FROM documents WHERE doc_id = 7")
def s8(t):
    return t.documents.where("doc_id = 7").select("doc_id", "text")


@query("s9_key_lookup_preview", "SELECT doc_id, source, substr(text, 1, 300) AS preview FROM documents WHERE source IN ('src1', 'src2')")
def s9(t):
    return t.documents.where(F.col("source").isin("src1", "src2")).select("doc_id", "source", F.substring("text", 1, 300).alias("preview"))


@query("s10_points_without_vectors", "SELECT vec_id, label FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)")
def s10(t):
    ids = t.benchmark.select(F.col("item_id").alias("vec_id"))
    return S.without(t.embeddings.join(ids, "vec_id", "left_semi"), "embedding")


@query("s11_scroll", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 50")
def s11(t):
    return t.embeddings.select("vec_id", "label").orderBy("vec_id").limit(50)


@query("s12_web_search_stub", "SELECT '' AS query, '' AS title, '' AS url, '' AS snippet WHERE false")
def s12(t):
    return S.web_search(t.spark)


@query("s13_request_text", "SELECT 1 AS query_id, 'a contract' AS text")
def s13(t):
    return S.in_memory(t.spark, [{"query_id": 1, "text": "a contract"}], "query_id int, text string")


# --- sinks


@query(
    "k1_upsert",
    """WITH c AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders GROUP BY 1)
       SELECT c_custkey AS id, CASE WHEN k IS NULL THEN c_mktsegment ELSE o_orderpriority END AS state
       FROM customer LEFT JOIN c ON c_custkey = o_custkey LEFT JOIN orders ON o_orderkey = k""",
)
def k1(t):
    target = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("state"))
    changes = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("state"), F.col("o_orderkey").alias("version"))
    table = Versioned.create(target, scratch(t.spark), ["id"], 16)
    table.merge(changes.join(target.select("id"), "id", "left_semi"), "version")
    return table.read()


@query(
    "k2_insert_ignore",
    """SELECT DISTINCT l_orderkey AS src, l_suppkey AS dst FROM lineitem
       WHERE (l_orderkey, l_suppkey) NOT IN (SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R')""",
)
def k2(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_returnflag")
    return etl.insert_new(e.where("l_returnflag = 'R'").drop("l_returnflag"), e.drop("l_returnflag"), ["src", "dst"])


@query(
    "k3_json_merge",
    """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind, CAST(user_id AS BIGINT) AS owner FROM events""",
)
def k3(t):
    j = etl.merge_json(F.col("props"), kind=F.col("event_type"), owner=F.col("user_id"))
    x = t.events.select("event_id", etl.parse_json(j, "k string, kind string, owner string").alias("p"))
    return x.select("event_id", F.col("p.k").cast("long").alias("k"), "p.kind", F.col("p.owner").cast("long").alias("owner"))


@query("k4_partitioned_write", "SELECT label, count(*) AS n FROM embeddings WHERE label < 5 GROUP BY 1")
def k4(t):
    path = scratch(t.spark)
    S.write_parquet(t.embeddings.select("vec_id", "label"), path, by=["label"])
    return t.spark.read.parquet(path).where("label < 5").groupBy("label").agg(F.count("*").alias("n"))


@query("k5_postings_write", "SELECT term, count(DISTINCT item_id) AS docs, count(*) AS n FROM (SELECT item_id, unnest(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS term FROM benchmark) GROUP BY 1")
def k5(t):
    """The postings of a text index, written by blocks of terms and read back."""
    from ..plans import retrieval as R

    path = scratch(t.spark)
    index = R.postings(t.benchmark, X.tokens(F.col("text")), "item_id")
    S.write_parquet(index.withColumn("block", F.pmod(F.xxhash64("term"), F.lit(4))), path, by=["block"])
    return t.spark.read.parquet(path).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").cast("long").alias("n"))


@query("k10_recreate_table", "SELECT label, count(*) AS n FROM embeddings WHERE label % 2 = 1 GROUP BY 1")
def k10(t):
    """A table that is made, dropped and made anew with other rows."""
    path = scratch(t.spark)
    rows = t.embeddings.select("vec_id", "label")
    S.write_parquet(rows.where("label % 2 = 0"), path)
    S.drop(t.spark, path)
    S.write_parquet(rows.where("label % 2 = 1"), path, mode="errorifexists")
    return t.spark.read.parquet(path).groupBy("label").agg(F.count("*").alias("n"))


@query("k9_delete_ids", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k9(t):
    return etl.delete_ids(t.documents.select("doc_id"), t.labels, "doc_id")


@query("k11_cleanup", "SELECT doc_id, source FROM documents WHERE NOT (source LIKE 'src1%') AND n_chars >= 50")
def k11(t):
    return t.documents.where(~F.col("source").startswith("src1") & (F.col("n_chars") >= 50)).select("doc_id", "source")


@query(
    "k12_edge_dedup_first",
    """SELECT src, dst, rel, eid FROM (SELECT l_orderkey AS src, l_partkey AS dst, l_returnflag AS rel, l_linenumber AS eid,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey, l_returnflag ORDER BY l_linenumber) AS r FROM lineitem) WHERE r = 1""",
)
def k12(t):
    e = t.lineitem.select(F.col("l_orderkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_returnflag").alias("rel"), F.col("l_linenumber").alias("eid"))
    return etl.keep_first(e, ["src", "dst", "rel"], ["eid"])


@query("k13_resume", "SELECT doc_id FROM documents WHERE doc_id % 3 <> 0")
def k13(t):
    done = S.Checkpoint(t.spark, scratch(t.spark))
    done.mark(t.documents.where("doc_id % 3 = 0"), "doc_id")
    done.mark(t.documents.where("doc_id % 3 = 1"), "doc_id", "failed")
    return done.todo(t.documents.select("doc_id"), "doc_id")


@query("k14_json_sink", "SELECT doc_id, lang FROM documents WHERE lang = 'es'")
def k14(t):
    path = scratch(t.spark)
    S.write_json(t.documents.where("lang = 'es'").select("doc_id", "lang"), path)
    return S.json_lines(t.spark, path, "doc_id bigint, lang string").select("doc_id", "lang")


# --- predicates and projections


@query("f1_equality", "SELECT doc_id FROM documents WHERE lang = 'de'")
def f1(t):
    return t.documents.where(etl.compile_filter({"lang": "de"})).select("doc_id")


@query("f2_in_list", "SELECT doc_id FROM documents WHERE lang IN ('de', 'fr')")
def f2(t):
    return t.documents.where(etl.compile_filter({"lang": ["de", "fr"]})).select("doc_id")


@query("f3_range", "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice < 50000")
def f3(t):
    return t.orders.where(etl.compile_filter({"o_totalprice": {"gte": 1000, "lt": 50000}})).select("o_orderkey")


@query("f4_compiled_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND source IN ('src1', 'src3') AND n_chars > 500 AND n_chars <= 9000")
def f4(t):
    return t.documents.where(etl.compile_filter({"lang": "en", "source": ["src1", "src3"], "n_chars": {"gt": 500, "lte": 9000}})).select("doc_id")


@query("f5_both_ends", "SELECT o_orderkey AS src, o_custkey AS dst FROM orders WHERE o_orderkey IN (SELECT c_custkey FROM customer) AND o_custkey IN (SELECT c_custkey FROM customer)")
def f5(t):
    return etl.valid_edges(t.orders.select(F.col("o_orderkey").alias("src"), F.col("o_custkey").alias("dst")), t.customer, "c_custkey")


@query("f6_not_member", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def f6(t):
    return t.customer.select("c_custkey").join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@query("f7_min_length", "SELECT doc_id FROM documents WHERE length(trim(text, ' ')) >= 50")
def f7(t):
    return t.documents.where(etl.long_enough(F.col("text"))).select("doc_id")


@query("f8_blank", "SELECT count(*) AS total, count(*) FILTER (text IS NULL OR text = '') AS blanks, count(*) FILTER (lang IS NULL OR lang = '') AS no_lang FROM documents")
def f8(t):
    return t.documents.agg(F.count("*").alias("total"), F.count_if(etl.blank(F.col("text"))).alias("blanks"), F.count_if(etl.blank(F.col("lang"))).alias("no_lang"))


@query("f9_regex", "SELECT doc_id, source FROM documents WHERE regexp_matches(source, '^src[0-9]$')")
def f9(t):
    return t.documents.where(F.col("source").rlike("^src[0-9]$")).select("doc_id", "source")


@query("f10_optional", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%e%' AND p_size >= 10")
def f10(t):
    p = etl.optional("E", lambda v: F.lower("p_name").contains(v.lower())) & etl.optional(None, lambda v: F.col("p_brand") == v) & etl.optional(10, lambda v: F.col("p_size") >= v)
    return t.part.where(p).select("p_partkey")


@query("f11_domain", "SELECT DISTINCT event_type FROM events WHERE event_type NOT IN ('click', 'view')")
def f11(t):
    return t.events.where(~F.col("event_type").isin("click", "view")).select("event_type").distinct()


@query("f12_prune_cast", "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(n_chars AS DOUBLE) AS size FROM documents")
def f12(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("n_chars").cast("double").alias("size"))


@query("f13_default", "SELECT doc_id, coalesce(nullif(source, 'src0'), 'none') AS source FROM documents")
def f13(t):
    return t.documents.select("doc_id", X.or_default(F.when(F.col("source") != "src0", F.col("source")).otherwise(""), "none").alias("source"))


@query(
    "f14_length_buckets",
    """SELECT CASE WHEN n_chars < 100 THEN '<100' WHEN n_chars < 500 THEN '100-499' WHEN n_chars < 1000 THEN '500-999'
       WHEN n_chars < 5000 THEN '1000-4999' WHEN n_chars < 10000 THEN '5000-9999' ELSE '10000+' END AS bucket, count(*) AS n FROM documents GROUP BY 1""",
)
def f14(t):
    b = etl.length_bucket(F.col("n_chars"), [(100, "<100"), (500, "100-499"), (1000, "500-999"), (5000, "1000-4999"), (10000, "5000-9999")], "10000+")
    return t.documents.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@query("f15_dictionary", "SELECT event_id, CASE event_type WHEN 'click' THEN 'nhap' WHEN 'view' THEN 'xem' WHEN 'purchase' THEN 'mua' ELSE 'other' END AS kind FROM events")
def f15(t):
    return t.events.select("event_id", X.map_type(F.col("event_type"), TYPES).alias("kind"))


@query(
    "f16_validation",
    """SELECT doc_id, concat_ws(',', CASE WHEN length(text) < 60 THEN 'short' END, CASE WHEN n_chars > 10000 THEN 'long' END) AS reasons
       FROM documents WHERE length(text) < 60 OR n_chars > 10000""",
)
def f16(t):
    _, bad = etl.validated(t.documents, {"short": F.length("text") >= 60, "long": F.col("n_chars") <= 10000})
    return bad.select("doc_id", F.concat_ws(",", "reasons").alias("reasons"))


@query("d_dates", "SELECT event_id, year(ts) AS y, strftime(ts, '%Y-%m-%d') AS day, CAST(ts AS DATE) = DATE '2024-01-15' AS mid FROM events")
def dates(t):
    return t.events.select("event_id", F.year("ts").cast("long").alias("y"), F.date_format("ts", "yyyy-MM-dd").alias("day"), (F.to_date("ts") == F.lit("2024-01-15").cast("date")).alias("mid"))


@query("d2_date_prefix", "SELECT event_id, CAST(CASE WHEN event_id % 4 < 2 THEN CAST(ts AS DATE) END AS VARCHAR) AS day, CAST(CAST(ts AS DATE) AS VARCHAR) AS typed FROM events")
def d2(t):
    """Days of texts that begin with a date, of others none; and of typed times."""
    k = F.col("event_id") % 4
    made = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd")).when(k == 1, F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" x"))).when(k == 2, F.date_format("ts", "dd/MM/yyyy")).otherwise("2024-02-31")
    return t.events.select("event_id", X.date_prefix(made).cast("string").alias("day"), X.date_prefix(F.col("ts")).cast("string").alias("typed"))


@query("d3_iso_or_fallback", "SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN CAST(ts AS DATE) ELSE DATE '1999-12-31' END AS VARCHAR) AS day FROM events")
def d3(t):
    k = F.col("event_id") % 3
    made = F.when(k == 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).when(k == 1, F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit(" noon")))
    return t.events.select("event_id", X.date_or(made, F.lit("1999-12-31").cast("date")).cast("string").alias("day"))


@query("c_json_get", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def c_json(t):
    return t.events.select("event_id", etl.parse_json(F.col("props"), "k bigint")["k"].alias("k"))


@query("c_arrays", "SELECT doc_id, array_to_string(list_slice(string_split(source, 'c'), 1, 1), '') AS head, list_contains(string_split(lang, 'e'), 'n') AS has_n FROM documents")
def c_arrays(t):
    return t.documents.select("doc_id", F.concat_ws("", F.slice(F.split("source", "c"), 1, 1)).alias("head"), F.exists(F.split("lang", "e"), lambda x: x == "n").alias("has_n"))


@query("c_json_build", "SELECT doc_id, lang AS l, n_chars AS n FROM documents")
def c_build(t):
    j = t.documents.select("doc_id", F.to_json(F.struct(F.col("lang").alias("l"), F.col("n_chars").alias("n"))).alias("j"))
    return j.select("doc_id", etl.parse_json(F.col("j"), "l string, n bigint").alias("p")).select("doc_id", "p.l", "p.n")
