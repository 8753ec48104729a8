"""Deduplication and components against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from corvid.llm import exactdedup, graph, simhash, similar


def union_find(ids, pairs):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@settings(max_examples=100, deadline=None)
@given(st.text("aAÄb \t\n\x0b\x85\xa0é", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_components(spark):
    rnd = random.Random(3)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000 + i) for i in range(1, 60)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    exp = union_find({x for p in pairs for x in p}, pairs)
    assert {k: v for k, v in exp.items() if k != v} == got
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_find_every_close_pair(spark):
    rnd = random.Random(5)
    base = [rnd.getrandbits(64) for _ in range(60)]
    fps = set(base)
    for b in base:
        for _ in range(12):
            x = b
            for bit in rnd.sample(range(64), rnd.randrange(6)):
                x ^= 1 << bit
            fps.add(x)
    fps = sorted(fps)
    exp = union_find(fps, [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 3])
    tile, simhash.TILE = simhash.TILE, 8  # many tiles
    try:
        edges = simhash.links(spark.createDataFrame([(simhash.signed(x),) for x in fps], "fp long")).collect()
    finally:
        simhash.TILE = tile
    got = union_find(fps, [(e["u"] % 2**64, e["v"] % 2**64) for e in edges])
    assert got == exp


def test_every_number_of_blocks_keeps_every_link():
    rnd = random.Random(1)
    assert [simhash.blocks_for(n) for n in (0, 10**9, 10**10, 10**12)] == [5, 5, 6, 7]
    for blocks in (5, 6, 7):
        for _ in range(300):
            x = 0
            for bit in rnd.sample(range(64), 3):
                x |= 1 << bit
            assert any(x & m == 0 for m in simhash.masks(blocks))


ROWS = [
    (1, "The quick brown fox jumps over the lazy dog", "s"), (2, "the QUICK brown fox jumps over the lazy dog", "s"), (3, None, None), (4, "", "s"), (5, " \n", "s"),
    (6, "Ä b c", "s"), (7, "ä b c", "s"), (7, "ä b c", "s"), (None, "ä b c", "s"), (8, "entirely different words stand in this one", "s"),
]


def test_near_duplicates(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, fingerprint string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()]
    assert len(got) == len(ROWS)
    fp = [brute_fingerprint(t) for _, t, _ in ROWS]
    comp = union_find(range(len(ROWS)), [(i, j) for i in range(len(ROWS)) for j in range(i) if (fp[i] ^ fp[j]).bit_count() <= 3])
    low = {}
    for i, (d, _, _) in enumerate(ROWS):
        if d is not None:
            low[comp[i]] = min(low.get(comp[i], d), d)
    assert sorted(map(str, got)) == sorted(str((d, f"{fp[i]:016x}", low[comp[i]])) for i, (d, _, _) in enumerate(ROWS))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in simhash.keep_one(docs).collect()} >= {1, 3, 8, None}


def test_similar_documents(spark):
    rnd = random.Random(11)
    words = [f"w{i}" for i in range(3000)]
    rows, group = [], {}
    for g in range(60):
        text = [rnd.choice(words) for _ in range(150)]
        for c in range(3):
            t = list(text)
            for _ in range(c):  # a word changed takes five shingles of about 150
                t[rnd.randrange(150)] = "changed"
            group[len(rows)] = g
            rows.append((len(rows), " ".join(t)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    assert len(got) == len(rows)
    assert all(group[d] == group[c] for d, c in got.items())  # no clean document is drawn in
    assert np.mean([c == 3 * group[d] for d, c in got.items()]) >= 0.97
    assert similar.keep_one(docs).count() <= 64
    odd = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "x")], "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(odd).collect()} == {1: 1, 2: 1, None: 3, 3: 3}
    assert similar.near_duplicates(docs.limit(0)).count() == 0


def joined(n, pairs):
    """Smallest row reachable from each, by a plain union of sets."""
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return np.array([top(i) for i in range(n)])


def test_forest_loses_no_link():
    pairs = [(1, 3), (3, 9), (9, 0), (5, 6)]
    assert simhash.forest(10, *np.array(pairs).T).tolist() == [0, 0, 2, 0, 4, 5, 5, 7, 8, 0]
    rnd = np.random.default_rng(0)
    for n in (2, 10, 100, 1000):
        for m in (1, n // 2, n, 2 * n):
            pairs = rnd.integers(0, n, (m, 2))
            assert (simhash.forest(n, *pairs.T) == joined(n, pairs.tolist())).all()


def plain_components(fp, most):
    d = np.bitwise_count(fp[:, None, :] ^ fp[None, :, :]).sum(2)
    return joined(len(fp), np.argwhere(np.triu(d <= most, 1)).tolist())


@pytest.mark.parametrize("seed", range(6))
def test_large_buckets_are_compared_in_full(seed, monkeypatch):
    monkeypatch.setattr(similar, "CHUNK", 1000)
    rnd = np.random.default_rng(seed)
    flips = (20, 40, 60, 75, 90, 120)[seed]  # copies near their origin, chains of copies, and unrelated rows
    fp = [rnd.integers(0, 2**63, similar.WIDE).astype(np.uint64) for _ in range(5)]
    for _ in range(495):
        bits = np.unpackbits(fp[rnd.integers(len(fp))].view(np.uint8))
        bits[rnd.choice(256, rnd.integers(flips), replace=False)] ^= 1
        fp.append(np.packbits(bits).view(np.uint64))
    fp = np.stack(fp)[rnd.permutation(500)]
    assert (simhash.forest(500, *similar.ball_links(fp, 51)) == plain_components(fp, 51)).all()
    group = np.sort(rnd.integers(0, 12, 500) ** 2 // 20)  # large and small buckets
    got = simhash.forest(500, *similar.near_pairs(fp, group, 51, fp[:2]))
    for g in np.unique(group):
        at = np.flatnonzero(group == g)
        assert (got[at] - at[0] == plain_components(fp[at], 51)).all()


def test_hot_buckets_are_dealt_as_tiles(spark, monkeypatch):
    """A chain of copies, each a few words from the one before, lies in few buckets; tiles of 16 rows leave no link out."""
    rnd = random.Random(5)
    text = [rnd.choice("abcdefgh") * 3 + str(i) for i in range(300)]
    rows = []
    for i in range(150):
        text[rnd.randrange(300)] = f"new{i}"
        rows.append((i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    monkeypatch.setattr(similar, "HOT", 16)
    tiled = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(docs).collect()}
    assert tiled == plain and set(plain.values()) == {0}


def test_filter_has_no_false_negative():
    rnd = np.random.default_rng(2)
    for n in (1, 2, 3, 10, 1000, 20_000):
        keys = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        blob = exactdedup.build_filter(keys)
        assert exactdedup.maybe_in(blob, keys).all()
    other = rnd.integers(0, 2**63, 20_000).astype(np.uint64)
    assert exactdedup.maybe_in(blob, other).mean() < 0.02
    assert len(blob) * 8 / n < 14


def test_exact_dedup(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, kept string")
    got = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in exactdedup.exact_dedup(docs).collect()]
    norm = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    groups = {}
    for d, t, _ in ROWS:
        groups.setdefault(norm(t), []).append(d)
    exp = []
    for d, t, _ in ROWS:
        ids = groups[norm(t)]
        keep = max((x for x in ids if x is not None), default=None)
        exp.append((d, keep, len(ids), d == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    assert sorted(map(str, got)) == sorted(map(str, exp))
    assert exactdedup.exact_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("name", ["op2_simhash", "op10_exact_dedup"])
def test_queries_return_every_document(spark, sf_dir, name):
    from corvid.llm.queries import QUERIES

    assert QUERIES[name](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_hot_keys_are_joined_where_the_rows_are(spark, monkeypatch):
    from pyspark.sql import functions as F

    from corvid.llm import common

    monkeypatch.setattr(common, "OFTEN", 5)
    rows = spark.createDataFrame([(i, i % 4 if i < 40 else 100 + i) for i in range(60)], "id long, k long")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("most"))
    got = {r["id"]: r["most"] for r in common.lookup(rows, table, ["k"]).collect()}
    assert got == {i: 36 + i % 4 if i < 40 else i for i in range(60)}
    assert exactdedup.exact_dedup(spark.createDataFrame([(i, "same") for i in range(50)], "doc_id long, text string")).where("keep_id = 49 and group_size = 50").count() == 50
