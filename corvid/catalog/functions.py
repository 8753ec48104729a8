"""Text functions. Where the engines' regular expressions differ, tests hold the Unicode side."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import parse as P
from ..functions import text as X
from ..plans import review as V
from .base import query

TOKENS = "list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda x: x <> '')"
LATIN = {"the": "THE", "of": "THE of", "and": "&"}


@query("x1_nfc", "SELECT doc_id, md5(nfc_normalize(text)) AS digest FROM documents")
def x1(t):
    return t.documents.select("doc_id", F.md5(X.nfc("text")).alias("digest"))


@query(
    "x2_space",
    """SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\r\\n?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '(?m)^ +| +$', '', 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM documents""",
)
def x2(t):
    return t.documents.select("doc_id", F.md5(X.normalize_space(F.col("text"))).alias("digest"))


@query("x3_query_normal", "SELECT item_id, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))) AS q FROM benchmark")
def x3(t):
    return t.benchmark.select("item_id", X.normalize_query(F.col("text")).alias("q"))


@query("x4_abbreviations")
def x4(t):
    """Cascading whole-word expansion by the whole table of short forms; look-around is not in the SQL's expressions."""
    return t.documents.select("doc_id", F.md5(X.expand(F.concat(F.lit("Theo BLDS, NĐ-CP và TT-BTC: "), F.col("text")))).alias("digest"))


@query("x5_query_abbreviations", "SELECT doc_id, 'theo Bộ Luật Dân Sự và Nghị Định Chính Phủ số ' || doc_id || ', Tái Thẩm' AS q FROM documents")
def x5(t):
    """Short forms in a query in normal form, by their own table and in its order."""
    made = F.concat(F.lit("Theo  BLDS và NĐ-CP số "), F.col("doc_id"), F.lit(", TT"))
    return t.documents.select("doc_id", X.expand_query(X.normalize_query(made)).alias("q"))


@query("x6_missing_marks")
def x6(t):
    return t.documents.groupBy("lang").agg(F.count_if(X.lacks_marks(F.col("text"))).alias("n"))


@query("x7_iso_dates", "SELECT event_id, regexp_replace(strftime(ts, '%d/%m/%Y'), '(\\d{1,2})/(\\d{1,2})/(\\d{4})', '\\3-\\2-\\1') AS day FROM events")
def x7(t):
    return t.events.select("event_id", X.iso_dates(F.date_format("ts", "dd/MM/yyyy")).alias("day"))


@query("x8_citation_case", "SELECT doc_id, 'Điều ' || doc_id || ' Luật số ' || doc_id || ', Nghị Định ' || doc_id AS citation FROM documents")
def x8(t):
    made = F.concat(F.lit("điều "), F.col("doc_id"), F.lit(" luật  số "), F.col("doc_id"), F.lit(",\tnghị định "), F.col("doc_id"), F.lit(" "))
    return t.documents.select("doc_id", X.normalize_citation(made).alias("citation"))


@query("x9_legal_normal")
def x9(t):
    """Normal form, white space and short forms in one; look-around is not in the SQL's expressions."""
    return t.documents.select("doc_id", F.md5(X.normalize_legal(F.col("text"), LATIN)).alias("digest"))


@query("d1_first_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def d1(t):
    return t.events.select("event_id", X.first_date(F.concat(F.lit("am "), F.date_format("ts", "d/M/yyyy"), F.lit(" und 1/1/1999"))).cast("string").alias("day"))


@query(
    "x10_strip_tags",
    """SELECT page_id, md5(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b[^>]*>.*?</script\\s*>', '', 'g'), '(?is)<style\\b[^>]*>.*?</style\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g'), '<[^>]+>', chr(10), 'g'),
         '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \\t]*\\n\\s*', chr(10), 'g'), '^\\s+|\\s+$', '', 'g')) AS digest FROM pages""",
)
def x10(t):
    return t.pages.select("page_id", F.md5(X.strip_tags(F.col("html"))).alias("digest"))


@query("x11_stripped_length", "SELECT page_id, CAST(length(trim(regexp_replace(html, '<[^>]+>', '', 'g'), ' ')) AS INTEGER) AS n FROM pages")
def x11(t):
    return t.pages.select("page_id", F.length(F.trim(F.regexp_replace("html", "<[^>]+>", ""))).alias("n"))


@query("x10_parsed")
def x10b(t):
    """Text by a parser; tests hold it against the parts of the pages."""
    return t.pages.select("page_id", F.md5(X.parsed_text("html")).alias("digest"))


@query("x12_earliest_type", "SELECT doc_id, coalesce(nullif(regexp_extract(lower(text), '(?:^|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])(the|und|les|los)(?:$|[^\\p{L}\\p{M}\\p{Nd}\\p{Pc}])', 1), ''), 'other') AS kind FROM documents")
def x12(t):
    """The kind named first, by words that these texts have."""
    return t.documents.select("doc_id", X.doc_type(F.col("text"), kinds={w: [w] for w in ("the", "und", "les", "los")}).alias("kind"))


@query("x13_metadata")
def x13(t):
    """Metadata of legal documents; these texts have little of it."""
    return t.documents.select("doc_id", P.metadata(F.col("text")).alias("m")).groupBy("m.doc_type").agg(F.count("*").alias("n"))


@query("x14_articles")
def x14(t):
    made = F.concat(F.lit("Điều 1. A\n1. "), F.col("text"), F.lit("\na) x\nĐiều 2. B\n"), F.col("source"))
    return P.exploded_articles(t.documents.select("doc_id", made.alias("text"))).select("doc_id", "article_no", "title", F.size("subsections").alias("n"))


@query("x15_references", "SELECT doc_id AS src, 'CITES' AS rel, doc_id || '/2020/QH14' AS needle FROM documents UNION ALL SELECT doc_id, 'REFERENCES', doc_id || '/2021/NĐ-CP' FROM documents")
def x15(t):
    made = F.concat(F.lit("Căn cứ Luật số "), F.col("doc_id"), F.lit("/2020/QH14; theo Nghị định "), F.col("doc_id"), F.lit("/2021/NĐ-CP."))
    return P.references(t.documents.select("doc_id", made.alias("text")))


@query("x15_reference_strings", "SELECT doc_id, 'Luật 2013' AS amends, 'Điều ' || doc_id || ' Nghị định 2021' AS cites FROM documents")
def x15b(t):
    made = F.concat(F.lit("Sửa đổi một số điều của Luật Đất đai 2013. Theo Điều "), F.col("doc_id"), F.lit(" của Nghị định số 4/2021"))
    return t.documents.select("doc_id", F.concat_ws("|", P.amendment_refs(made)).alias("amends"), F.concat_ws("|", P.citation_refs(made)).alias("cites"))


@query(
    "x16_whole_document",
    """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN source ELSE 'luat' END AS doc_type, doc_id || '/2020/QH14' AS document_number, strftime(DATE '2020-06-17', '%Y-%m-%d') AS publish_date, '1 2' AS article_nos FROM documents""",
)
def x16(t):
    made = F.concat(F.lit("Luật số "), F.col("doc_id"), F.lit("/2020/QH14\nNgày 17 tháng 6 năm 2020\nĐiều 1. A\n1. x\nĐiều 2. B\n"), F.col("source"))
    d = P.documents(t.documents.select("doc_id", "source", made.alias("text")), {"doc_type": F.when(F.col("doc_id") % 2 == 0, F.col("source"))})
    return d.select("doc_id", "doc_type", "document_number", F.col("publish_date").cast("string").alias("publish_date"), F.concat_ws(" ", F.transform("articles", lambda a: a["number"])).alias("article_nos"))


@query("x17_clauses", "SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(CASE WHEN len(p) > 1 THEN p ELSE [text] END) AS c FROM (SELECT doc_id, text, string_split_regex(text, '\\n\\s*\\n') AS p FROM documents)) WHERE length(trim(regexp_replace(c, '\\s+', ' ', 'g'))) >= 20 GROUP BY 1")
def x17(t):
    return P.clauses(t.documents).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("x18_variants", "SELECT doc_id, 'đền bù ' || doc_id || '|bồi thường ' || doc_id || '|bồi thường thiệt hại ' || doc_id AS variants FROM documents")
def x18(t):
    return t.documents.select("doc_id", F.concat_ws("|", X.variants(F.concat(F.lit("đền bù "), F.col("doc_id")))).alias("variants"))


@query("x19_negation")
def x19(t):
    return t.documents.select("doc_id", X.has_negation(F.col("text"), ("the", "und")).alias("neg"), X.negation_scope(F.col("text"), ("the", "und")).alias("scope"))


@query("x20_citations", "SELECT doc_id, 'Điều ' || doc_id || '|Luật Đất đai năm 2013|Thông tư 59/2020/TT-BTC|Khoản 2' AS cites FROM documents")
def x20(t):
    made = F.concat(F.lit("Điều "), F.col("doc_id"), F.lit(" khoản 2 và điều "), F.col("doc_id"), F.lit(" của luật Đất đai  năm 2013, thông tư 59/2020/TT-BTC"))
    return t.documents.select("doc_id", F.concat_ws("|", X.citations(made)).alias("cites"))


@query("x21_strategy", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'citation' WHEN 1 THEN 'negation' ELSE 'semantic' END AS strategy FROM documents")
def x21(t):
    """Strategies of plans: citations go before negation, negation before the rest."""
    k = F.col("doc_id") % 3
    made = F.concat(F.when(k == 0, "Điều 5 không được ").when(k == 1, "Nghiêm  cấm ").otherwise("Quyền "), F.col("source"))
    return P.plan(t.documents.select("doc_id", made.alias("text")), "doc_id").select(F.col("query_id").alias("doc_id"), "strategy")


@query("x22_plan")
def x22(t):
    p = P.plan(t.benchmark, "item_id")
    return p.select("query_id", "normalized", "strategy", "has_negation", F.size("variants").alias("n_variants"))


@query("x23_cut_at_word", "SELECT doc_id, CASE WHEN length(text) <= 350 THEN text ELSE regexp_extract(text, '(?s)^(.{0,350})\\s', 1) END AS head FROM documents")
def x23(t):
    return t.documents.select("doc_id", X.cut_at_word(F.col("text"), 350).alias("head"))


@query("x24_previews", "SELECT doc_id, substr(text, 1, 100) AS p100, substr(text, 1, 200) AS p200 FROM documents")
def x24(t):
    return t.documents.select("doc_id", F.substring("text", 1, 100).alias("p100"), F.substring("text", 1, 200).alias("p200"))


@query("x25_root_id", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey AS VARCHAR) AS root FROM lineitem")
def x25(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", X.root_id(F.concat_ws("_", F.col("l_orderkey").cast("string"), F.lit("article"), F.col("l_linenumber").cast("string"))).alias("root"))


@query("x26_key_phrases", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '[;.\\n]'), lambda p: length(trim(p, ' ')) > 20)) AS INTEGER) AS n FROM documents")
def x26(t):
    return t.documents.select("doc_id", F.size(V.key_phrases(F.col("text"), 20)).alias("n"))


@query("x27_negation_words", "SELECT doc_id, contains(lower(text), ' not ') OR contains(lower(text), ' nicht ') OR contains(lower(source), 'không') AS neg FROM documents")
def x27(t):
    return t.documents.select("doc_id", (V.negative(F.col("text"), (" not ", " nicht ")) | V.negative(F.col("source"))).alias("neg"))


@query("x28_numbers", "SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[0-9]+'))), ',') AS numbers FROM documents")
def x28(t):
    return t.documents.select("doc_id", F.concat_ws(",", F.array_sort(V.ascii_numbers(F.col("text")))).alias("numbers"))


@query("x28_quantities", "SELECT doc_id, doc_id || ' ngày|5 %|' || n_chars || ' đồng' AS q FROM documents")
def x28b(t):
    made = F.concat(F.lit("trong "), F.col("doc_id"), F.lit(" ngày, phạt 5 % và "), F.col("n_chars"), F.lit(" đồng"))
    return t.documents.select("doc_id", F.concat_ws("|", X.quantities(made)).alias("q"))


@query("x29_jaccard", f"SELECT doc_id, coalesce(round(len(list_intersect(list_distinct(a), list_distinct(b))) / nullif(len(list_distinct(list_concat(a, b))), 0), 6), 0) AS j FROM (SELECT doc_id, {WORDS} AS a, (SELECT {WORDS} FROM documents WHERE doc_id = 0) AS b FROM documents)")
def x29(t):
    one = t.documents.where("doc_id = 0").select(F.col("text").alias("other"))
    return t.documents.crossJoin(F.broadcast(one)).select("doc_id", F.round(X.jaccard(F.col("text"), F.col("other")), 6).alias("j"))  # one row


@query("x30_host", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages")
def x30(t):
    return t.pages.select("page_id", X.host(F.col("url")).alias("host"))


@query("x31_reply_fields", "SELECT doc_id, 'entailed' AS level, CAST(least(100.0, doc_id % 150 + 0.5) AS DOUBLE) AS confidence, 'see ' || source AS rationale FROM documents")
def x31(t):
    reply = F.concat(F.lit("VERIFICATION: ENTAILED\nCONFIDENCE: "), F.col("doc_id") % 150, F.lit(".5\nRATIONALE: see "), F.col("source"), F.lit("\n"))
    return t.documents.select("doc_id", V.parse_reply(reply).alias("r")).select("doc_id", "r.level", "r.confidence", "r.rationale")


@query("x32_grounding", "SELECT doc_id, 'a [1] b' || CASE WHEN doc_id % 2 = 0 THEN ' [2]' ELSE '' END || ' c.' AS text FROM documents")
def x32(t):
    known = F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return t.documents.select("doc_id", X.ground(F.lit("a [1] b [2] c [9]."), known).alias("text"))


@query("x33_prompt", "SELECT o_custkey, string_agg('[' || rank || '] ' || o_orderkey || ' (' || o_orderstatus || ')', chr(10) ORDER BY rank) AS prompt FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank FROM orders) WHERE rank <= 3 GROUP BY 1")
def x33(t):
    from ..plans.retrieval import ranked

    x = ranked(t.orders.select(F.col("o_custkey").alias("query_id"), F.col("o_orderkey").alias("doc_id"), "o_orderstatus", (-F.col("o_orderkey")).alias("score")), 3)
    lines = F.array_sort(F.collect_list(F.struct("rank", F.format_string("[%d] %d (%s)", "rank", "doc_id", "o_orderstatus").alias("line"))))
    return x.groupBy(F.col("query_id").alias("o_custkey")).agg(F.concat_ws("\n", F.transform(lines, lambda s: s["line"])).alias("prompt"))


@query("x34_reference_parts", "SELECT doc_id, 2000 + doc_id % 24 AS year, CAST(doc_id AS VARCHAR) AS number FROM documents")
def x34(t):
    made = F.concat(F.col("doc_id"), F.lit("/"), 2000 + F.col("doc_id") % 24, F.lit("/QH14"))
    n = X.document_number(made)
    return t.documents.select("doc_id", F.split(n, "/")[1].cast("long").alias("year"), F.split(n, "/")[0].alias("number"))


@query("x35_word_estimate", "SELECT doc_id, len(string_split_regex(trim(text, ' '), '\\s+')) AS words, round(CAST(len(string_split_regex(trim(text, ' '), '\\s+')) AS DOUBLE) * 1.3, 4) AS tokens FROM documents WHERE trim(text, ' ') <> ''")
def x35(t):
    w = F.col("text")
    return t.documents.where(F.trim("text") != "").select("doc_id", X.word_count(w).cast("long").alias("words"), F.round(X.token_estimate(w), 4).alias("tokens"))


@query("x36_analyzer", "SELECT doc_id, len(list_filter(string_split_regex(strip_accents(lower(replace(text, 'ß', 's'))), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS n FROM documents")
def x36(t):
    return t.documents.select("doc_id", F.size(X.analyze(F.col("text"))).cast("long").alias("n"))


@query("x36_tokens", f"SELECT doc_id, len(x) AS n, len(list_distinct(x)) AS vocabulary FROM (SELECT doc_id, {TOKENS} AS x FROM documents)")
def x36b(t):
    x = X.tokens(F.col("text"))
    return t.documents.select("doc_id", F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("vocabulary"))
