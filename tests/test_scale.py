"""Vector lists, percentiles, references and laws where keys are large, against plain loops."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvid.operators import etl
from corvid.operators import graph as G
from corvid.plans import retrieval as R
from corvid.plans import vectors as V

FIELDS = "doc_id long, v array<double>"


def nearest(rows, queries, top):
    """The first of each query by cosine rounded to six digits, then id."""
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    m, ids = np.stack([unit(v) for _, v in rows]), [d for d, _ in rows]
    return {q: [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-round(float(s[i]), 6), ids[i]))[:top]] for q, v in queries if (s := m @ unit(v)) is not None}


def found(df):
    got = {}
    for r in df.collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["doc_id"]))
    return {q: [d for _, d in sorted(x)] for q, x in got.items()}


def test_lists_are_exact_and_prune(spark, tmp_path, monkeypatch):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.05 * rnd.normal(size=8)).tolist()) for i in range(600)] + [(1000 + i, [1.0] * 8) for i in range(200)]  # a quarter are copies of one
    odd = [(5000, None), (5001, [0.0] * 8), (5002, [math.nan] * 8)]
    V.write(spark.createDataFrame(rows + odd, FIELDS), f"file://{tmp_path}/v", lists=14)
    x = V.read(spark, f"file://{tmp_path}/v")
    assert x.vectors.count() == 800 and x.lists.agg(F.sum("n")).first()[0] == 800
    queries = [(i, rows[i][1]) for i in range(0, 600, 25)] + [(900, [1.0] * 8)]
    q = spark.createDataFrame([*queries, (901, [0.0] * 8), (902, None)], "query_id long, q array<double>")
    want = nearest(rows, queries, 5)
    assert found(V.search(x, q, 5)) == want
    met = V.met
    monkeypatch.setattr(V, "met", lambda x, asked, top: met(x, asked, top, block=16))  # lists and queries in many blocks
    assert found(V.search(x, q, 5)) == want
    bounds = V.bounds(x, q).collect()
    worst = {r["query_id"]: r["score"] for r in V.search(x, q, 5).where("rank = 5").collect()}
    assert sum(r["bound"] < worst[r["query_id"]] - 1e-5 for r in bounds) > len(bounds) / 2  # lists that need not be read


def test_probe_recall(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("v"))
    x = V.kept(e, f"file://{tmp_path}", "v")
    q = e.where("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    exact = found(V.search(x, q, 10))
    rows = [(r["doc_id"], r["v"]) for r in e.collect()]
    assert exact == nearest(rows, [(d, v) for d, v in rows if d % 10 == 0], 10)
    n = x.lists.count()
    share = lambda p: sum(len(set(exact[k]) & set(p.get(k, []))) for k in exact) / sum(map(len, exact.values()))
    # these vectors lie nearly evenly, so that lists tell little: three quarters must be read
    assert share(found(V.search(x, q, 10, probe=math.ceil(0.75 * n)))) >= 0.9
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(20, 16))
    c = spark.createDataFrame([(i, (centres[i % 20] + 0.2 * rnd.normal(size=16)).tolist()) for i in range(1000)], FIELDS)
    V.write(c, f"file://{tmp_path}/c", lists=31)
    y = V.read(spark, f"file://{tmp_path}/c")
    q = c.where("doc_id % 20 = 3").select(F.col("doc_id").alias("query_id"), F.col("v").alias("q"))
    exact = found(V.search(y, q, 10))
    assert share(found(V.search(y, q, 10, probe=3))) >= 0.9 and y.lists.count() > 20


def test_lists_of_nothing(spark, tmp_path):
    V.write(spark.createDataFrame([], FIELDS), f"file://{tmp_path}/v")
    q = spark.createDataFrame([(1, [1.0, 2.0])], "query_id long, q array<double>")
    assert V.search(V.read(spark, f"file://{tmp_path}/v"), q, 3).count() == 0


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_percentiles_by_place(spark, accuracy):
    """A group with nearly all rows, one of one value, heavy ties, outliers and nulls."""
    rnd = random.Random(7)
    groups = {"large": [rnd.choice([0.0, 1.0, rnd.gauss(0, 1), 1e12 * rnd.random()]) for _ in range(20_000)], "one": [3.5], "same": [2.0] * 500, "few": [5.0, 1.0, 4.0]}
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in [*vs, None]] + [("none", None)], "g string, v double")
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r["g"]: r for r in etl.index_percentile(df, "v", shares, ["g"], accuracy).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        xs = sorted(vs)
        assert [got[g][k] for k in shares] == [xs[min(int(len(xs) * p), len(xs) - 1)] for p in shares.values()]
        assert got[g]["n"] == len(xs) and got[g]["mean"] == pytest.approx(sum(xs) / len(xs))
    every = sorted(v for vs in groups.values() for v in vs)
    r = etl.index_percentile(df, "v", {"p95": 0.95}, accuracy=accuracy).first()
    assert r["p95"] == every[int(len(every) * 0.95)]
    assert etl.index_percentile(df.where("g = 'none'"), "v", {"p50": 0.5}, ["g"]).count() == 0


def test_references_against_all_pairs(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abÄ ") for _ in range(rnd.randint(0, 5)))
    docs = [(i, rnd.choice(["k", "l", None]), rnd.choice([1, 2]), rnd.choice(["ab", "b", None]), rnd.choice([None, word(), word() + word()])) for i in range(200)]
    refs = [(i, rnd.choice(["k", "l", None]), rnd.choice([1, 2, None]), rnd.choice([None, "", word()])) for i in range(300)]
    want = {}
    for i, k, y, n in refs:
        if None in (k, y, n):
            continue
        graded = [(0 if num == n else 1, d) for d, kind, year, num, title in docs if (kind, year) == (k, y) and (num == n or (title is not None and n.lower() in title.lower()))]
        if graded:
            want[i] = min(graded)[1]
    got = G.resolve(spark.createDataFrame(refs, "ref_id int, kind string, year int, needle string"), spark.createDataFrame(docs, "doc_id int, kind string, year int, number string, title string"))
    assert {r["ref_id"]: r["doc_id"] for r in got.collect()} == want


def test_one_kind_and_year_with_very_many_documents(spark):
    i = F.col("id")
    docs = spark.range(100_000).select(i.alias("doc_id"), F.lit("law").alias("kind"), F.lit(2020).alias("year"), F.concat(i, F.lit("/X")).alias("number"), F.concat(F.lit("on the matter of case "), F.sha1(i.cast("string"))).alias("title"))
    refs = spark.range(3000).select(i.alias("ref_id"), F.lit("law").alias("kind"), F.lit(2020).alias("year"), F.when(i % 2 == 0, F.concat(i, F.lit("/X"))).otherwise(F.substring(F.sha1(i.cast("string")), 5, 20)).alias("needle"))
    start = time.time()
    got = {r["ref_id"]: r["doc_id"] for r in G.resolve(refs, docs).collect()}
    assert got == {k: k for k in range(3000)} and time.time() - start < 60


def test_laws_of_a_long_list(spark):
    """A list of many rows has no list in its rows, and the places it is judged by are those of the sorted list."""
    rnd = random.Random(5)
    rows = [(q, i, f"l{rnd.randrange(6)}", rnd.random() < 0.7, rnd.randrange(40), round(rnd.random() * 100, 3)) for q in range(3) for i in range(q * 700 + 1)]
    df = spark.createDataFrame(rows, "query_id int, doc_id int, law_id string, is_article boolean, article_no int, score double")
    out = R.aggregate_laws(df)
    assert "all_" not in out._jdf.queryExecution().optimizedPlan().toString()
    want = set()
    for q in range(3):
        mine = [r for r in rows if r[0] == q]
        scores = sorted((r[5] for r in mine), reverse=True)
        floor, median = scores[max(1, len(scores) // 3) - 1], scores[len(scores) // 2]
        for law in {r[2] for r in mine}:
            arts = [r for r in mine if r[2] == law and r[3]]
            roots = [r for r in mine if r[2] == law and not r[3]]
            best = max(arts, key=lambda r: (r[5], -r[1]), default=None)
            root = max(roots, key=lambda r: r[1], default=None)
            if not arts:
                want.add((q, root[1]))
            elif root is None or sum(r[5] for r in arts) > root[5] or best[5] >= floor:
                want.add((q, best[1]))
            else:
                want |= {(q, root[1])} | {(q, r[1]) for r in arts if r[5] >= median}
    assert {(r["query_id"], r["doc_id"]) for r in out.collect()} == want


def test_late_interaction_in_blocks_and_tiles(spark, monkeypatch):
    """Few blocks while they are small: what moves grows with the rows. Tiles give what whole blocks give."""
    rnd = random.Random(2)
    rows = spark.createDataFrame([(rnd.randrange(4), i, [rnd.gauss(0, 1) for _ in range(4)]) for i in range(300)], "matrix int, row long, v array<float>")
    whole = {(r["a"], r["b"]): r["score"] for r in R.late_interaction(rows, 300).collect()}
    for name, n in (("LEAST_ROWS", 1), ("BLOCKS", 3), ("TILE", 7)):
        monkeypatch.setattr(R, name, n)
    cut = R.late_interaction(rows)
    assert {(r["a"], r["b"]): r["score"] for r in cut.collect()} == pytest.approx(whole) and len(whole) == 6
    assert "sequence(0, 2" in cut._jdf.queryExecution().analyzed().toString() or "array(0, 1, 2)" in cut._jdf.queryExecution().optimizedPlan().toString() or "[0,1,2]" in cut._jdf.queryExecution().optimizedPlan().toString()


def test_terms_of_documents_move_once(spark, sf_dir):
    from corvid.catalog import QUERIES

    plan = QUERIES["j11_terms_postings"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(doc_id") == 1 and "Exchange hashpartitioning(query_id" not in plan.split("BroadcastExchange")[0]


def test_lists_give_back_only_what_betters_the_first(spark, tmp_path, monkeypatch):
    """Of the lists after the first, what moves is above a query's floor, not so many rows of each list; what both need is worked out once."""
    rnd = np.random.default_rng(4)
    rows = [(i, rnd.normal(size=8).tolist()) for i in range(900)]
    V.write(spark.createDataFrame(rows, FIELDS), f"file://{tmp_path}/v", lists=20)
    x = V.read(spark, f"file://{tmp_path}/v")
    queries = rows[::30]
    met, seen = V.met, []
    monkeypatch.setattr(V, "met", lambda *a: seen.append(met(*a)) or seen[-1])
    got = V.search(x, spark.createDataFrame(queries, "query_id long, q array<double>"), 5)
    assert found(got) == nearest(rows, queries, 5)
    assert seen[1].count() < len(queries) * 5 * 4  # of up to 18 lists, five each before
    assert got._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1


def test_documents_of_few_hits_stay(spark, sf_dir):
    """Texts are joined where they are to hits that a count shows few."""
    from corvid.catalog import QUERIES

    plan = QUERIES["m13_rule_verifier"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan and "FlatMapCoGroupsInArrow" not in plan


def test_holders_against_every_text(spark, tmp_path):
    """Documents that hold a text: parts of words at its ends, repeated words, one or two words, none."""
    from corvid.catalog import composites as C
    from corvid.catalog.base import Tables

    rnd = random.Random(8)
    texts = [" ".join(rnd.choice(["ab", "Ab", "a", "b-a", "ä", "ba."]) for _ in range(rnd.randint(0, 9))) for _ in range(300)]
    spark.createDataFrame([(i, t or None) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    needles = ["ab a b", "b a b-a ä", "ä ba. a", "a", "ab b", ". ", "zz a b zz", "b b b", "a Ab ab b-a"]
    q = spark.createDataFrame(list(enumerate(needles)), "query_id long, needle string")
    got = {(r["query_id"], r["doc_id"]) for r in C.holders(Tables(spark, f"file://{tmp_path}"), q).collect()}
    assert got == {(i, d) for i, n in enumerate(needles) for d, t in enumerate(texts) if t and n in t} and len(got) > 100
