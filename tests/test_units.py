"""Properties and fixed examples of single operators."""

from __future__ import annotations

import datetime
import math
import threading
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvid.functions import parse as P
from corvid.functions import text as X
from corvid.operators import etl
from corvid.operators import graph as G
from corvid.plans import retrieval as R
from corvid.plans import review as V
from corvid.sources import tables as S
from corvid.streaming import ingest as I
from corvid.streaming.tasks import Tasks


def one(spark, make, text):
    """A text expression of one row."""
    return spark.createDataFrame([(text,)], "t string").select(make(F.col("t")).alias("x")).first()["x"]


def hits(spark, *lists):
    return [spark.createDataFrame([("q", d, i) for i, d in enumerate(x, 1)], "query_id string, doc_id string, rank int") for x in lists]


def test_rrf_of_two_lists(spark):
    rows = R.rrf(hits(spark, ["doc1", "doc2", "doc3"], ["doc2", "doc3", "doc4"]), digits=12).orderBy("rank").collect()
    assert rows[0]["doc_id"] == "doc2" and abs(rows[0]["score"] - (1 / 62 + 1 / 61)) < 1e-10


def test_rrf_does_not_depend_on_the_order_of_lists(spark):
    a, b = hits(spark, ["a", "b"], ["c", "a"])
    get = lambda x: {r["doc_id"]: r["score"] for r in x.collect()}
    assert get(R.rrf([a, b])) == get(R.rrf([b, a]))


def test_rrf_weights_must_fit(spark):
    with pytest.raises(ValueError):
        R.rrf(hits(spark, ["a"]), [1.0, 2.0])


def test_rrf_of_nothing(spark):
    assert R.rrf(hits(spark, [], []) if False else [spark.createDataFrame([], "query_id string, doc_id string, rank int")]).count() == 0


def test_position_decay_keeps_half(spark):
    h = spark.createDataFrame([("q", i, s) for i, s in enumerate([0.9, 0.8, 0.7, 0.6])], "query_id string, doc_id int, score double")
    assert R.position_decay(h).count() == 2
    alone = R.position_decay(h.limit(1), alpha=0.0).first()
    assert alone["decayed"] == 1.0


def test_sandwich_is_a_permutation(spark):
    h = spark.createDataFrame([("q", i, float(-i)) for i in range(5)], "query_id string, doc_id int, score double")
    assert [r["doc_id"] for r in R.sandwich(h).orderBy("place").collect()] == [0, 2, 4, 3, 1]


@pytest.mark.parametrize("method", ["min-max", "z-score", "percentile", "rank", "centered"])
def test_normalisers_keep_the_order(spark, method):
    h = spark.createDataFrame([("q", i, s) for i, s in enumerate([0.0328, 0.0312, 0.0299, 0.0164])], "query_id string, doc_id int, score double")
    got = [r["norm"] for r in R.normalized(h, method).orderBy("doc_id").collect()]
    assert got == sorted(got, reverse=True)


def test_percentile_is_the_gaussian(spark):
    s = [1.0, 2.0, 4.0]
    h = spark.createDataFrame([("q", i, x) for i, x in enumerate(s)], "query_id string, doc_id int, score double")
    mean = sum(s) / 3
    dev = math.sqrt(sum((x - mean) ** 2 for x in s) / 3)
    got = [r["norm"] for r in R.normalized(h, "percentile").orderBy("doc_id").collect()]
    assert got == pytest.approx([50 * (1 + math.erf((x - mean) / dev / math.sqrt(2))) for x in s])


@pytest.mark.parametrize(("method", "value"), [("min-max", 50.0), ("z-score", 0.0), ("percentile", 50.0)])
def test_lists_without_spread(spark, method, value):
    h = spark.createDataFrame([("q", 1, 2.0), ("q", 2, 2.0)], "query_id string, doc_id int, score double")
    assert {r["norm"] for r in R.normalized(h, method).collect()} == {value}


def test_max_sim(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[2.0, 0.0]])], "a array<array<double>>, b array<array<double>>")
    assert df.select(R.max_sim("a", "b").alias("s")).first()["s"] == pytest.approx(1.0)


def test_compiled_filter(spark):
    df = spark.createDataFrame([("luat", 1, "2021-01-01"), ("luat", 3, "2021-01-01"), ("nd", 1, "2019-01-01")], "doc_type string, level int, date string")
    assert df.where(etl.compile_filter({"doc_type": "luat", "level": [1, 2], "date": {"gte": "2020-01-01"}})).count() == 1
    with pytest.raises(ValueError):
        etl.compile_filter({"a": {"near": 1}})


def test_upsert_keeps_the_latest(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, x string")
    c = spark.createDataFrame([(2, "c", 1), (2, "d", 2), (3, "e", 1)], "id int, x string, v int")
    assert sorted(tuple(r) for r in etl.upsert(t, c, ["id"], "v").collect()) == [(1, "a"), (2, "d"), (3, "e")]


def test_json_merge_of_what_is_no_object(spark):
    df = spark.createDataFrame([('{"a": "1", "b": "2"}',), ("nonsense",), (None,)], "j string")
    got = [r["x"] for r in df.select(etl.merge_json(F.col("j"), b=F.lit("3")).alias("x")).collect()]
    assert got[0] == '{"a":"1","b":"3"}' and got[2] == '{"b":"3"}'


def test_index_percentile(spark):
    df = spark.createDataFrame([(float(i),) for i in [5, 1, 4, 2, 3, 3]], "v double")
    r = etl.index_percentile(df, "v", {"p50": 0.5, "p95": 0.95}).first()
    s = sorted([5, 1, 4, 2, 3, 3])
    assert (r["p50"], r["p95"], r["n"]) == (s[3], s[5], 6)


def test_dates(spark):
    assert one(spark, lambda c: X.first_date(c), "Luật Doanh nghiệp\nNgày 17 tháng 6 năm 2020") == datetime.date(2020, 6, 17)
    assert one(spark, lambda c: X.first_date(c, 2), "Ngày 17 tháng 6 năm 2020") is None
    assert one(spark, X.iso_dates, "ngày 1 tháng 2 năm 2020") == "2020-2-1"
    assert one(spark, X.iso_dates, "3-4-2021, 2022/5/6, 112/4/2026") == "2021-4-3, 2022-5-6, 112/4/2026"
    assert one(spark, X.date_in_words, "ngày 30 tháng 2 năm 2020") is None and one(spark, X.date_in_words, "1/2/2020") is None


@pytest.mark.parametrize(("text", "number"), [("Số: 99/2020/NĐ-CP", "99/2020/NĐ-CP"), ("Số 13/2020/TT-BTC", "13/2020/TT-BTC"), ("none", None), ("số 103/SL", "103/SL"), ("36/1999/Chính", "36/1999"), ("x 7/QĐ/abc", "7/QĐ"), (None, None)])
def test_document_number(spark, text, number):
    assert one(spark, X.document_number, text) == number


def test_nfc(spark):
    s = "Nguyễn "
    assert one(spark, X.nfc, unicodedata.normalize("NFD", s)) == s
    assert one(spark, X.nfc, None) is None


def test_abbreviations_cascade_and_keep_word_ends(spark):
    assert one(spark, lambda c: X.expand(c, {"ab": "cd x", "cd": "e"}), "AB cab ab.") == "e x cab e x."


def test_space(spark):
    assert one(spark, X.normalize_space, "a\t\t b \r\n\r\n\r\n\r\n c ") == "a b\n\nc"


def test_fold(spark):
    assert one(spark, X.fold, "ĐIỀU Ương") == "dieu uong"


def test_citations_kind_by_kind(spark):
    assert one(spark, X.citations, "khoản 2 Điều 5a.1, điều 5; điểm b Chương IV; Luật  Nhà ở năm 2014, điều 5") == ["Điều 5a.1", "Điều 5", "Luật Nhà ở năm 2014", "Khoản 2", "Điểm b", "Chương IV"]
    assert one(spark, X.citations, "") == [] and one(spark, X.citations, None) is None


def test_negation(spark):
    assert one(spark, X.has_negation, "Bên A không  được chuyển nhượng") is True
    assert one(spark, X.negation_scope, "Bên A không được chuyển nhượng, trừ khi có lý do") == "chuyển nhượng"
    assert one(spark, X.negation_scope, "bị cấm; không được bán") == "bán"  # by the order of the list
    assert one(spark, X.negation_scope, "bị cấm; bán") == "; bán"
    assert one(spark, X.negation_scope, "được bán") is None
    assert one(spark, X.has_negation, "knot") is False


def test_types_by_first_name(spark):
    assert one(spark, X.doc_type, "Căn cứ Nghị định và Luật") == "nghi_dinh"
    assert one(spark, X.doc_type, "Bộ luật và QĐ") == "luat"
    assert one(spark, X.doc_type, "số 5/TT-BTC") == "thong_tu"
    assert one(spark, X.doc_type, "bức thư") == "other"
    assert one(spark, X.map_type, " Sắc luật ") == "luat" and one(spark, X.map_type, "công văn") == "other"


def test_issuer_by_list(spark):
    assert one(spark, X.issuer, "Chính phủ trình quốc  hội") == "quốc  hội"
    assert one(spark, X.issuer, "Bộ Y tế") is None


def test_missing_marks(spark):
    assert one(spark, X.lacks_marks, "hop dong lao dong thang nam") is True
    assert one(spark, X.lacks_marks, "hợp đồng lao động tháng năm") is False
    assert one(spark, X.lacks_marks, "") is False and one(spark, X.lacks_marks, None) is False


def test_quantities_pattern_by_pattern(spark):
    assert one(spark, X.quantities, "5% trong 3 tháng, 2.5 và 10 000 đồng ngày 1/2/2020") == ["3 tháng", "5%", "10 000 đồng", "1/2/2020", "2.5", "5%"]


def test_variants_whole_words_and_parts(spark):
    got = one(spark, lambda c: X.variants(c, {"a b": ["x"]}, {"cd": ["e"]}), "a b cab cdd")
    assert got == ["a b cab cdd", "a b cab ed", "x cab cdd"]
    assert one(spark, lambda c: X.variants(c, {}, {}), "q") == ["q"]


def test_normal_citation(spark):
    assert one(spark, X.normalize_citation, " điều 5  nghị  định 3, điều 2 của luật") == "Điều 5 Nghị Định 3, điều 2 của Luật"


def test_jaccard_by_white_space(spark):
    df = spark.createDataFrame([("Bên A, bên B", "bên a b"), ("", "x")], "a string, b string")
    assert [r["j"] for r in df.select(X.jaccard(F.col("a"), F.col("b")).alias("j")).collect()] == [0.5, 0.0]


def test_reference_strings(spark):
    assert one(spark, P.amendment_refs, "Sửa đổi Luật Đầu tư số 61/2020/QH14\nsửa đổi thông tư số 5") == ["Luật số 61", "thông tư số 5"]
    assert one(spark, P.citation_refs, "theo Điều 3 của Luật 2014") == ["Điều 3 Luật 2014"]


def test_grounding(spark):
    df = spark.createDataFrame([("see [1] and [7] .", [1])], "t string, k array<int>")
    assert df.select(X.ground(F.col("t"), F.col("k")).alias("x")).first()["x"] == "see [1] and."


def test_articles():
    text = "Điều 1. Phạm vi\nA\nĐiều 46. Hợp đồng\n1. Một\na) x\nb) y\n2. Hai"
    got = P.articles_of(text)
    assert [a["number"] for a in got] == ["1", "46"]
    assert [s["number"] for s in got[1]["subsections"]] == ["1", "2"]
    assert [c["letter"] for c in got[1]["subsections"][0]["clauses"]] == ["a", "b"]
    assert got[1]["subsections"][0]["text"] == "Một" and got[1]["subsections"][0]["content"] == "a) x\nb) y" and got[1]["clauses"] == []
    assert P.articles_of("Điều 1:\na) x\nb) y")[0]["clauses"][-1] == {"letter": "b", "text": "y"}
    assert P.articles_of("Điều 5 của Luật") == [] and P.articles_of("") == []


def test_chunks_cover_all_sentences():
    sentences = [f"w{i} " * 50 + f"end{i}." for i in range(20)]
    got = P.chunk(" ".join(sentences))
    assert all(any(f"end{i}." in c["content"] for c in got) for i in range(20))
    assert all(len(c["content"].split()) <= P.WORDS_PER_CHUNK + 51 for c in got)
    assert P.chunk("few words") == []
    assert len(P.chunk("x " * 1000)) == 1  # a sentence longer than a chunk stays whole


def test_rules_in_order(spark):
    rows = [
        ("the employee shall receive the full wage.", "It holds that the employee shall receive the full wage.", "entailed"),
        ("pay is không due on day one now here", "pay is due on day one now here", "contradicted"),
        ("pay 5 ngày from the day of the end", "pay 7 ngày from the day of the end", "contradicted"),
        ("pay no 5 on the day of the end", "pay no 7 on the day of the end", None),
        ("apples", "oranges", None),
        ("", "x", None),
    ]
    df = spark.createDataFrame(rows, "c string, p string, e string").withColumn("l", V.rule_level(F.col("c"), F.col("p"))["level"])
    assert [r["l"] for r in df.collect()] == [r[2] for r in rows]


def test_the_model_sees_only_what_rules_leave(spark):
    df = spark.createDataFrame([("q", "apples", "oranges"), ("q", "a long enough phrase to be found", "here is a long enough phrase to be found")], "query_id string, clause string, passage string")
    seen = []

    def model(rest):
        seen.append(rest.count())
        return rest.withColumns({"level": F.lit("partially_supported"), "confidence": F.lit(0.5)})

    assert {r["decided_by"] for r in V.verified(df, model).collect()} == {"rule", "model"} and seen == [1]


def test_risks_are_filled_with_zeros(spark):
    found = spark.createDataFrame([("high",)], "risk string")
    assert {r["risk"]: r["n"] for r in V.risk_summary(found).collect()} == {"high": 1, "medium": 0, "low": 0, "none": 0}


def test_distances(spark):
    e = spark.createDataFrame([(1, 2, "r"), (2, 3, "r"), (3, 4, "r")], "src int, dst int, rel string")
    s = spark.createDataFrame([(1,)], "id int")
    assert {r["id"]: r["distance"] for r in G.distances(s, e, 2).collect()} == {2: 1, 3: 2}
    assert G.depth_of(0) == 2 and G.depth_of(99) == 2 and G.depth_of(3) == 3


def test_paths_use_no_edge_twice(spark):
    e = spark.createDataFrame([(1, 2, "r", 1), (2, 1, "r", 2)], "src int, dst int, rel string, eid int")
    assert G.paths(spark.createDataFrame([(1,)], "id int"), e, 5).count() == 2


def test_sources_and_checkpoints(spark, tmp_path):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "a.txt").write_bytes(b"ab\xff")
    assert S.text_files(spark, f"file://{tmp_path}/f").first()["text"] == "ab�"
    df = spark.createDataFrame([(1, None, "n"), (2, "t", "n")], "id int, title string, name string")
    assert [r["title"] for r in S.aliased(df, {"id": ["id"], "title": ["title", "name"]}).orderBy("id").collect()] == ["n", "t"]
    c = S.Checkpoint(spark, f"file://{tmp_path}/c")
    assert c.todo(df, "id").count() == 2
    c.mark(df.where("id = 1"), "id")
    assert [r["id"] for r in c.todo(df, "id").collect()] == [2]


def test_bucketed_join_needs_no_shuffle(spark):
    a = spark.range(1000).withColumnRenamed("id", "k")
    S.bucketed(a, "bucketed_a", 8, "k")
    S.bucketed(a, "bucketed_b", 8, "k")
    joined = spark.table("bucketed_a").hint("merge").join(spark.table("bucketed_b"), "k")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and joined.count() == 1000
    for t in ("bucketed_a", "bucketed_b"):
        spark.sql(f"drop table {t}")


def test_streamed_windows_with_late_data(spark, tmp_path):
    rows = [("2024-01-01 00:00:01", "a", 1.0), ("2024-01-01 00:03:00", "a", 3.0), ("2024-01-01 00:06:00", "a", 5.0)]
    df = spark.createDataFrame(rows, "ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(f"file://{tmp_path}/in")
    s = I.stream(spark, f"file://{tmp_path}/in", "ts timestamp, event_type string, value double")
    q = I.latency_windows(s, late="10 minutes").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["n"] for r in spark.table("windows").collect()) == [1, 2]
    assert I.progress(q)["rows"] == 3


def test_approximate_distinct_count_is_close(spark):
    r = spark.range(100_000).agg(F.approx_count_distinct("id", 0.01).alias("n")).first()
    assert abs(r["n"] - 100_000) < 3000


def test_running_task_is_cancelled(spark):
    tasks, began = Tasks(spark), threading.Event()

    def long():
        began.set()
        return spark.range(8, numPartitions=8).select(F.expr("java_method('java.lang.Thread', 'sleep', 60000L + id)")).collect()

    first, second = tasks.submit("long", long), tasks.submit("short", lambda: spark.range(3).count())
    assert began.wait(30)
    start = time.time()  # its Spark job may not have started yet
    assert tasks.cancel(first) and not tasks.cancel(first)
    tasks.wait(30)
    assert time.time() - start < 30
    assert [(r["name"], r["state"]) for r in tasks.states().orderBy("task_id").collect()] == [("long", "cancelled"), ("short", "completed")]
    assert tasks.tasks[second]["result"] == 3 and not tasks.cancel(second)
    tasks.close()


def test_documents_with_overrides(spark):
    df = spark.createDataFrame([(1, "Nghị định số 5/2021/NĐ-CP\nĐiều 1. A\nx", "khac"), (2, "Nghị định", None), (3, None, None)], "doc_id long, text string, kind string")
    got = {r["doc_id"]: r for r in P.documents(df, {"doc_type": F.col("kind")}).collect()}
    assert [got[i]["doc_type"] for i in (1, 2, 3)] == ["khac", "nghi_dinh", "other"]
    assert got[1]["document_number"] == "5/2021/NĐ-CP" and got[2]["document_number"] is None
    assert [len(got[i]["articles"]) for i in (1, 2, 3)] == [1, 0, 0]


def test_vectors_come_in_batches(spark):
    df = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(10)], "doc_id long, text string").coalesce(1)

    def model(texts):
        assert len(texts) <= 4
        return [[len(t)] for t in texts]

    got = {r["doc_id"]: r["vector"] for r in R.vectors(df, model, batch=4).collect()}
    assert got == {i: [0.0 if i == 3 else float(i)] for i in range(10)}
    assert R.vectors(df.limit(0), model).count() == 0


def test_parts_of_texts_are_held_a_few_texts_at_a_time():
    """Parts go to Arrow memory slice by slice: Python holds those of few texts, and the rows are what each text gives alone."""
    import tracemalloc

    import pyarrow as pa

    made = ["".join(f"Article {i}. T{i} {k}\nbody {k}\n" for i in range(20)) for k in range(2000)] + [None, ""]
    tracemalloc.start()
    held = [P.articles_of(t or "") for t in made]
    whole = tracemalloc.get_traced_memory()[0]
    assert P.in_slices(pa.array(made), P.articles_of, P.ARTICLES_ARROW).to_pylist() == held
    del held
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    P.in_slices(pa.array(made), P.articles_of, P.ARTICLES_ARROW)
    peak = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert peak < whole / 8
    assert P.in_slices(pa.array([], pa.string()), P.chunk, P.CHUNKS_ARROW).to_pylist() == []
