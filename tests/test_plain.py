"""Queries and functions that SQL does not express, against plain Python over all rows."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvid.catalog import QUERIES
from corvid.functions import lexicons as L
from corvid.functions import parse as P
from corvid.functions import text as X
from corvid.operators import etl
from corvid.operators import graph as G
from corvid.plans import review as V
from corvid.plans import postings
from corvid.sources import tables as S
from corvid.streaming import ingest as I


def md5(t):
    return hashlib.md5(t.encode()).hexdigest()


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").collect()


def expanded(t, words, order):
    for short in order:
        t = re.sub(rf"(?<!\w){re.escape(short)}(?!\w)", words[short], t, flags=re.I)
    return t


def longest(words):
    return sorted(words, key=len, reverse=True)


def test_abbreviations(spark, sf_dir):
    got = {r["doc_id"]: r["digest"] for r in QUERIES["x4_abbreviations"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: md5(expanded("Theo BLDS, NĐ-CP và TT-BTC: " + r["text"], L.ABBREVIATIONS, longest(L.ABBREVIATIONS))) for r in docs(spark, sf_dir)}


def test_every_short_form(spark):
    for words, f, order in ((L.ABBREVIATIONS, X.expand, longest(L.ABBREVIATIONS)), (L.QUERY_ABBREVIATIONS, X.expand_query, list(L.QUERY_ABBREVIATIONS))):
        rows = spark.createDataFrame([(w, f"({w.lower()}) {w}1 {w}") for w in words], "w string, t string")
        for r in rows.select("t", f(F.col("t")).alias("x")).collect():
            assert r["x"] == expanded(r["t"], words, order)


def test_tables_from_files(tmp_path):
    path = tmp_path / "words.json"
    path.write_text(json.dumps({"a": "b", "c": ["d"]}))
    assert L.read(str(path)) == {"a": "b", "c": ["d"]}
    path.write_text(json.dumps({"a": 1}))
    with pytest.raises(ValueError):
        L.read(str(path))


def plain_variants(t):
    made = set()
    for w, vs in L.SYNONYMS.items():
        if re.search(rf"\b{w.replace(' ', r'\s+')}\b", t, re.I):
            made |= {re.sub(rf"\b{re.escape(w)}\b", v, t, flags=re.I) for v in vs}
    for table in (L.VERBS, L.CONCEPTS):
        made |= {t.replace(w, v) for w, vs in table.items() for v in vs if w in t}
    return [t, *sorted(made - {t})][:10]


def test_variants(spark):
    texts = ["hợp đồng lao động và báo cáo", "công ty vi phạm", "đất đai", "nothing", "BHXH của nhân viên"]

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.variants(F.col("t")).alias("v")).collect()
    assert all(r["v"] == plain_variants(r["t"]) for r in rows)


def test_legal_normal_form(spark, sf_dir):
    words = {"the": "THE", "of": "THE of", "and": "&"}

    def plain(t):
        t = re.sub(r"[ \t]+", " ", unicodedata.normalize("NFC", t))
        t = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", t))
        t = "\n".join(x.strip(" ") for x in t.split("\n")).strip(" \t\n\x0b\f\r")
        return expanded(t, words, longest(words))

    got = {r["doc_id"]: r["digest"] for r in QUERIES["x9_legal_normal"](spark, sf_dir).collect()}
    assert got == {r["doc_id"]: md5(plain(r["text"])) for r in docs(spark, sf_dir)}


def test_plans(spark, sf_dir):
    """Every step of a plan, over all texts and some that cite or negate."""
    texts = {r["item_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    odd = {-1: "  Theo  Điều 5 Luật Đất đai 2013 ", -2: "không được\tsa thải NLĐ", -3: "BHXH của nhân viên", -4: ""}
    rows = spark.createDataFrame(list({**texts, **odd}.items()), "item_id long, text string")
    got = {r["query_id"]: r for r in P.plan(rows, "item_id").collect()}
    assert set(got) == {*texts, *odd}
    for i, t in {**texts, **odd}.items():
        normal = re.sub(r"\s+", " ", unicodedata.normalize("NFC", t)).strip(" ").lower()
        more = expanded(normal, L.QUERY_ABBREVIATIONS, list(L.QUERY_ABBREVIATIONS))
        assert (got[i]["original"], got[i]["normalized"], got[i]["expanded"], got[i]["variants"]) == (t, normal, more, plain_variants(more))
    assert [got[i]["strategy"] for i in odd] == ["citation", "negation", "semantic", "semantic"] and got[-2]["has_negation"] and got[-1]["citations"]
    asked = {r["query_id"]: (r["normalized"], r["strategy"], r["has_negation"], r["n_variants"]) for r in QUERIES["x22_plan"](spark, sf_dir).collect()}
    assert asked == {i: (got[i]["normalized"], got[i]["strategy"], got[i]["has_negation"], len(got[i]["variants"])) for i in texts}
    assert {got[i]["strategy"] for i in texts} == {"semantic"}  # invented words neither cite nor negate


def test_missing_marks(spark, sf_dir):
    words = [(w, "".join(c for c in unicodedata.normalize("NFD", w) if unicodedata.category(c) != "Mn")) for w in X.MARKED_WORDS]

    def plain(t):
        head = (t or "").lower()[:2000]
        seen = [w for w, p in words if re.search(rf"(?<!\w){p}(?!\w)", head)]
        return bool(seen) and sum(w not in head for w in seen) > 0.5 * len(seen)

    exp = {}
    for r in docs(spark, sf_dir):
        exp[r["lang"]] = exp.get(r["lang"], 0) + plain(r["text"])
    assert {r["lang"]: r["n"] for r in QUERIES["x6_missing_marks"](spark, sf_dir).collect()} == exp
    texts = ["hop dong lao dong", "hợp đồng lao động", "hoi dong hội đồng", "thông tu", "dinh dinh", None, ""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.lacks_marks(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r["x"] for r in rows] == [plain(t) for t in texts]


def test_negation(spark, sf_dir):
    def scope(t):
        for w in ("the", "und"):
            m = re.search(rf"(?<!\w){w}(?!\w)\s*(.*)$", t, re.I | re.S)
            if m:
                first = re.match(r"[^,.;!?]+", m[1])
                return (first[0] if first else m[1][:100]).strip(" ")
        return None

    text = {r["doc_id"]: r["text"] for r in docs(spark, sf_dir)}
    rows = QUERIES["x19_negation"](spark, sf_dir).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert r["neg"] == bool(re.search(r"(?<!\w)(the|und)(?!\w)", text[r["doc_id"]], re.I))
        assert r["scope"] == scope(text[r["doc_id"]])


def test_articles_of_all_documents(spark, sf_dir):
    exp = []
    for r in docs(spark, sf_dir):
        body = f"1. {r['text']}\na) x"
        subs = len(re.findall(r"^\s*\d+\.\s+.*", body, re.M))
        exp += [(r["doc_id"], "1", "A", subs), (r["doc_id"], "2", "B", len(re.findall(r"^\s*\d+\.\s+.*", r["source"], re.M)))]
    assert sorted(tuple(r) for r in QUERIES["x14_articles"](spark, sf_dir).collect()) == sorted(exp)


def test_metadata_of_all_documents(spark, sf_dir):
    words = {k: re.compile("|".join(rf"(?<!\w){w.replace(' ', r'\s+')}(?!\w)" for w in ws), re.I) for k, ws in X.KIND_WORDS.items()}
    exp = {}
    for r in docs(spark, sf_dir):
        found = [(m.start(), i, k) for i, (k, p) in enumerate(words.items()) if (m := p.search(r["text"][:500]))]
        k = min(found)[2] if found else "other"
        exp[k] = exp.get(k, 0) + 1
    assert {r["doc_type"]: r["n"] for r in QUERIES["x13_metadata"](spark, sf_dir).collect()} == exp


def test_chunks_of_all_documents(spark, sf_dir):
    text = {r["doc_id"]: r["text"] for r in docs(spark, sf_dir)}
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", P.chunks("text").alias("c")).collect()
    for r in rows:
        joined = " ".join(s.strip() for s in re.split(r"(?<=[.;\n])\s+", text[r["doc_id"]]) if s.strip())
        assert all(joined[c["start_char"] : c["end_char"]] == c["content"] for c in r["c"])
        assert bool(r["c"]) == (len(text[r["doc_id"]].split()) * 1.3 >= 100)
        covered = 0
        for c in r["c"]:
            assert c["start_char"] <= covered + 1 and c["end_char"] > covered
            covered = c["end_char"]
        assert not r["c"] or covered == len(joined)


def test_percentiles_of_a_gaussian(spark, sf_dir):
    rows = QUERIES["w5_percentile"](spark, sf_dir).collect()
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").collect()
    lists = {}
    for o in orders:
        lists.setdefault(o["o_custkey"] % 50, []).append(o["o_totalprice"])
    exp = []
    for q, xs in lists.items():
        mean = sum(xs) / len(xs)
        dev = math.sqrt(sum((x - mean) ** 2 for x in xs) / len(xs))
        exp += [50 * (1 + math.erf((x - mean) / dev / math.sqrt(2))) if dev > 1e-10 else 50.0 for x in xs]
    got = sorted(float(r[c]) for r in rows for c in rows[0].__fields__ if c not in ("query_id", "doc_id"))
    assert len(got) == len(exp) and all(abs(a - b) < 1e-3 for a, b in zip(got, sorted(exp), strict=True))


def test_page_text(spark, sf_dir):
    assert X.page_text("<p>a &amp; b</p><script>x</script><ul><li> c<li>d<!-- e --><b>f</b></ul>&eacute;<style>y") == "a & b\nc\nd\nf\né"
    assert X.page_text(None) == X.page_text("") == ""
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = {r["page_id"]: r["digest"] for r in QUERIES["x10_parsed"](spark, sf_dir).collect()}
    from html import unescape

    for i, h in pages.items():
        bare = re.sub(r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->|<!doctype[^>]*>", "\0", h)
        lines = [x.strip() for part in re.split("<[^>]+>|\0", bare) for x in unescape(part).splitlines()]
        assert got[i] == md5("\n".join(x for x in lines if x))


def test_phrases_against_all_places(spark):
    rnd = random.Random(1)
    rows = [([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))], [rnd.choice("abcd") for _ in range(rnd.randint(1, 4))]) for _ in range(300)]

    def plain(d, q, slop):
        total = 0.0
        for i, w in enumerate(d):
            if w == q[0]:
                at = i
                for x in q[1:]:
                    at = next((j for j in range(at + 1, min(len(d), at + slop + 2)) if d[j] == x), None)
                    if at is None:
                        break
                if at is not None and at - i - (len(q) - 1) <= slop:
                    total += 1 / (1 + at - i - (len(q) - 1))
        return total

    df = spark.createDataFrame([(d, q, [[i for i, x in enumerate(d) if x == w] for w in q]) for d, q in rows], "d array<string>, q array<string>, p array<array<int>>")
    for slop in (0, 1, 2):
        for r in df.select("d", "q", postings.phrase_places(F.col("p"), slop).alias("f")).collect():
            assert r["f"] == pytest.approx(plain(r["d"], r["q"], slop))


def test_context_is_in_order_and_without_repeats(spark):
    hits = spark.createDataFrame([(1, 10, 1), (1, 20, 2), (1, 99, 9)], "query_id long, id long, rank long")
    edges = spark.createDataFrame([(1, 10, "CONTAINS"), (1, 11, "CONTAINS"), (10, 30, "AMENDED_BY"), (20, 30, "AMENDED_BY"), (40, 10, "CITES"), (20, 11, "REFERENCES"), (99, 7, "CITES")], "src long, dst long, rel string")
    stored = spark.createDataFrame([(50, 10), (20, 60)], "src long, dst long")
    got = [(r["id"], r["source"]) for r in G.context(hits, edges, stored).orderBy("place").collect()]
    assert got == [(1, "parent"), (11, "sibling"), (30, "amendment"), (40, "related"), (50, "stored"), (60, "stored")]


def test_references_are_numbered_in_order(spark, monkeypatch):
    monkeypatch.setattr(V, "SPAN", 3)
    rnd = random.Random(4)
    rows = [(rnd.randrange(20), rnd.randrange(5), rnd.randrange(60)) for _ in range(150)]
    first = {}
    for q, p, r in sorted(rows):
        first.setdefault(r, (q, p))
    exp = {r: n for n, (_, r) in enumerate(sorted(((qp, r) for r, qp in first.items()), key=lambda x: (x[0], x[1])), 1)}
    got = V.unique_references(spark.createDataFrame(rows, "query_id long, place long, ref_id long")).collect()
    assert {r["ref_id"]: r["n"] for r in got} == exp


def test_citations_with_related(spark):
    hits = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, doc_id long, rank long")
    related = spark.createDataFrame([(1, 5, 6, 1), (1, 5, 7, 2), (1, 5, 8, 3), (1, 6, 7, 1), (1, 6, 9, 2)], "query_id long, doc_id long, related long, n long")
    got = [(r["doc_id"], r["via"]) for r in V.cited_with_related(hits, related).orderBy("n").collect()]
    assert got == [(5, None), (6, 5), (7, 5), (9, 6)]


def test_tries_and_waits():
    waits, calls = [], []

    def work():
        calls.append(1)
        if len(calls) < 3:
            raise TimeoutError

    assert I.retried(work, sleep=waits.append, jitter=lambda: 0.5) == 3 and waits == [1.5, 2.5]
    assert I.delays(8, jitter=lambda: 0.0) == [1, 2, 4, 8, 16, 30, 30]
    with pytest.raises(ConnectionError):
        I.retried(lambda: (_ for _ in ()).throw(ConnectionError()), tries=2, sleep=waits.append)
    with pytest.raises(KeyError):  # what cannot pass is not tried again
        I.retried(lambda: {}["x"], sleep=waits.append)


def test_batches_that_fail_go_aside(spark, tmp_path):
    spark.range(20).withColumn("v", F.col("id")).repartition(2).write.parquet(f"file://{tmp_path}/in")

    def broken(batch):
        raise OSError("never")

    rows = I.stream(spark, f"file://{tmp_path}/in", "id long, v long")
    I.ingest(rows, f"file://{tmp_path}/out", f"file://{tmp_path}/state", F.col("v") >= 5, broken, lambda w: I.retried(w, tries=2, base=0.0, jitter=lambda: 0.0)).awaitTermination()
    assert spark.read.parquet(f"file://{tmp_path}/out/failed").count() == 15 and spark.read.parquet(f"file://{tmp_path}/out/quarantine").count() == 5


def test_web_search_keeps_to_its_sites(spark):
    asked, clock, cache = [], [0.0], {}

    def find(q):
        asked.append(q)
        return [{"title": "a", "url": u, "snippet": ""} for u in ("https://www.luatvietnam.vn/x", "https://sub.baophapluat.vn/", "https://evilluatvietnam.vn/", "http://example.com/")]

    run = lambda: [r["url"] for r in S.web_search(spark, ["q"], find, cache=cache, ttl=10, now=lambda: clock[0]).collect()]
    assert run() == run() == ["https://www.luatvietnam.vn/x", "https://sub.baophapluat.vn/"]
    assert len(asked) == 1 and asked[0].startswith("(q) (site:thuvienphapluat.vn OR ")
    clock[0] = 11
    run()
    assert len(asked) == 2 and S.web_search(spark).count() == 0


def test_cached_copies(spark, tmp_path):
    spark.range(10).coalesce(1).write.parquet(f"file://{tmp_path}/a")
    assert S.cached(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b").count() == 10
    copy = next(p for p in (tmp_path / "b").iterdir() if p.suffix == ".parquet")
    at = copy.stat().st_mtime_ns
    assert S.cached(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b").count() == 10 and copy.stat().st_mtime_ns == at
    copy.write_bytes(copy.read_bytes()[:50])  # broken off
    assert S.cached(spark, f"file://{tmp_path}/a", f"file://{tmp_path}/b").count() == 10


@pytest.mark.parametrize("longest_first", [True, False])
def test_short_forms_of_any_kind(spark, longest_first):
    """Forms in, beside and made by one another, letters that only folding equates, signs and empty replacements: as one replacement after the other."""
    rnd = random.Random(11)
    words = {"ab": "cd-x", "cd": "e k", "e k": "ab", "a-b": "", "x": "-", "kx": "$1 q", "b-cd": "zz", "tt-btc": "t", "tt": "btc", "btc": "tt", "đk": "Đ"}
    made = ["ab", "AB", "cd", "x", "X", "k", "K", "e", "a", "b", "tt", "TT", "btc", "đk", "ĐK", "-", "-", " ", " ", " ", "\n", "_", "ß", "́", "İ"]
    texts = ["", None, *("".join(rnd.choice(made) for _ in range(rnd.randint(1, 12))) for _ in range(1000))]
    c = F.col("t")
    for short in longest(words) if longest_first else words:
        c = F.regexp_replace(c, rf"(?iuU)(?<!\w){re.escape(short)}(?!\w)", words[short].replace("$", r"\$"))
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", X.expand(F.col("t"), words, longest_first).alias("x"), c.alias("exp")).collect()
    assert [r["x"] for r in rows] == [r["exp"] for r in rows]
    assert sum(r["x"] != r["t"] for r in rows) > 150


def test_short_forms_are_looked_for_once(spark):
    """A text without any is scanned once; so is a head for words without marks, whatever the number of words."""
    plan = lambda c: spark.range(1).select(c.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    text = F.concat(F.lit("a "), F.col("id").cast("string"))
    assert plan(X.expand(text)).count("regexp_replace") == 1 and plan(X.lacks_marks(text)).lower().count("rlike") == 0


def stores(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc_id long, text string").write.mode("overwrite").parquet(f"file://{tmp_path}/documents.parquet")
    return {r["store"]: r["n"] for r in QUERIES["qi_ingest_batch"](spark, f"file://{tmp_path}").collect()}


def batch():
    words = lambda a, n: " ".join(f"{a}{k}" for k in range(n)) + "."
    rows = [
        (1, words("a", 60) + " Căn cứ 3/2020/QH14.\n" + words("b", 60)),  # cites one by its number
        (2, words("c", 20) + "\nĐiều 7. Tên\n" + words("d", 20)),  # an article of its own
        (3, unicodedata.normalize("NFD", words("é", 400))),  # several chunks
        (4, words("f", 20)), (4, words("g", 20)),  # one id twice
        (6, unicodedata.normalize("NFD", "é" * 40)), (7, None), (8, "short"),
    ]
    return rows, {1: 120 + 5, 2: 40 + 1, 3: 400, 4: 20}  # words of each that is stored


def test_a_batch_goes_from_stage_to_stage(spark, tmp_path):
    """What texts themselves hold counts in each store, and a repeated id is stored, parsed, cut and indexed once."""
    rows, words = batch()
    got = stores(spark, tmp_path, rows)
    edges = {(1, 2), (2, 3), (3, 4), (1, 3)}  # by the number of the next id, and the one told in the text
    assert got == {"rejected": 3, "documents": 4, "articles": 2 * 4 + 1, "edges": len(edges), "chunked": 2, "postings": sum(words.values())}


@pytest.mark.parametrize(
    ("stage", "changed"),
    [
        ("nfc", {"rejected": 2, "documents": 5, "edges": 4, "articles": 11}),
        ("upsert", {"documents": 5, "articles": 0, "edges": 0, "chunked": 0, "postings": 0}),
        ("articles", {"articles": 4, "chunked": 0, "postings": 2 * 4}),
        ("chunks", {"chunked": 4, "postings": 3 * 4}),
    ],
)
def test_each_stage_of_a_batch_tells_on_the_next(spark, tmp_path, monkeypatch, stage, changed):
    made = {
        "nfc": (X, F.col),
        "upsert": (etl, lambda target, *_: target),  # the earlier edition stays
        "articles": (P, lambda c: F.array(F.struct(F.lit("one").alias("title"), F.lit("two").alias("content")))),
        "chunks": (P, lambda c: F.array(F.struct(F.lit("one two three").alias("content")))),
    }
    monkeypatch.setattr(made[stage][0], stage, made[stage][1])
    got = stores(spark, tmp_path, batch()[0])
    assert {k: got[k] for k in changed} == changed


def test_chunks_of_articles_lose_no_word(spark, sf_dir):
    """The index of a batch's chunks has the words of the texts, each once for a document."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(trim(text)) >= 50")
    want = d.agg(F.sum(F.size(F.array_distinct(X.analyze(F.col("text"))))).alias("n")).first()["n"]
    assert {r["store"]: r["n"] for r in QUERIES["qi_ingest_batch"](spark, sf_dir).collect()}["postings"] == want


def test_what_is_made_of_texts_leaves_a_worker_in_parts():
    """An Arrow batch goes out as parts of a few texts, with the rows that each text gives alone."""
    import pyarrow as pa

    texts = [unicodedata.normalize("NFD", f"é {k}. ") * 40 for k in range(1000)] + [None, ""]
    for f, alone in ((X.nfc, lambda t: t and unicodedata.normalize("NFC", t)), (P.chunks, lambda t: P.chunk(t or "")), (P.articles, lambda t: P.articles_of(t or ""))):
        parts = list(f.func(iter([pa.array(texts), pa.array(texts[:3])])))
        assert max(map(len, parts)) <= 64 and [x for p in parts for x in p.to_pylist()] == [alone(t) for t in [*texts, *texts[:3]]]
