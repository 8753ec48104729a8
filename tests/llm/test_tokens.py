"""Tokenizers against the libraries, and round trips."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corvid.llm import bytebpe, packing, wordbpe
from corvid.llm.queries import BYTE_BPE, WORD_BPE

BPE = bytebpe.of(BYTE_BPE, P.PATTERN)
REF = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=BPE.ranks, special_tokens={})
WORD = wordbpe.of(WORD_BPE)
LIB = Tokenizer.from_file(WORD_BPE)

TEXT = st.one_of(st.text(max_size=200), st.text("ab'srelt \n\t", max_size=300), st.text("aäß. '1²éＡ́\x85\xa0<|>endoftx", max_size=120))
CASES = ["", " ", "a" * 5000, "ab" * 4000, " " * 5000, "<|endoftext|> x <|ENDOFTEXT|>", "I'LL we'll 'r e", "Ünïcödé́ ﬁ İ ẞ", "汉字かなカナ 한국어", "👩‍👩‍👧 \x00\x1c\x85"]


@pytest.mark.parametrize("text", CASES)
def test_byte_bpe_cases(text):
    ids = BPE.encode(text)
    assert ids == REF.encode_ordinary(text) and BPE.decode(ids) == text.encode()


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_byte_bpe_is_the_library(text):
    leaf, bytebpe.LEAF_CHARS = bytebpe.LEAF_CHARS, 16  # many joins
    try:
        assert BPE.encode(text) == REF.encode_ordinary(text)
    finally:
        bytebpe.LEAF_CHARS = leaf


@settings(max_examples=100, deadline=None)
@given(st.text("abcdef", min_size=100, max_size=600))
def test_joins_inside_a_piece(text):
    assert BPE.piece(text.encode()) == REF.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_word_bpe_is_the_library(text):
    ids = LIB.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(WORD.encode_batch([text])[0], "<u4").tolist() == ids
    assert WORD.count_batch([text]) == [len(ids)]


@pytest.mark.parametrize("text", CASES)
def test_word_bpe_cases(text):
    assert np.frombuffer(WORD.encode_batch([text])[0], "<u4").tolist() == LIB.encode(text, add_special_tokens=False).ids


ROWS = [(1, "Hello there", "x"), (2, None, "x"), (3, "", None), (3, "", None), (None, "no id", "x"), (4, "long words " * 5000, "x")]
SCHEMA = "doc_id long, text string, ids_sha256 string"  # a column whose name clashes with a result's


def test_round_trip_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bytebpe.round_trip(docs, BYTE_BPE, P.PATTERN).collect())
    exp = []
    for i, t, _ in ROWS:
        ids = REF.encode_ordinary(t or "")
        exp.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(exp)
    back = bytebpe.decode(bytebpe.encode(docs, BYTE_BPE, P.PATTERN), BYTE_BPE, P.PATTERN)
    assert sorted(bytes(r["decoded"]).decode() for r in back.collect()) == sorted(t or "" for _, t, _ in ROWS)


def test_count_rows(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    got = sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in wordbpe.count(docs, WORD_BPE).collect())
    n = [len(LIB.encode(t or "", add_special_tokens=False).ids) for _, t, _ in ROWS]
    assert got == sorted((i or -1, len((t or "").encode()), c, c > 2048) for (i, t, _), c in zip(ROWS, n, strict=True))


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bytebpe.round_trip(none, BYTE_BPE, P.PATTERN).count() == 0
    assert wordbpe.count(none, WORD_BPE).count() == 0
    assert packing.best_fit_pack(none, WORD_BPE).count() == 0


def test_packing_is_whole(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    rows = packing.best_fit_pack(docs, WORD_BPE).collect()
    ids = {}
    for i, t, _ in ROWS:
        ids.setdefault(i, []).append(LIB.encode(t or "", add_special_tokens=False).ids + [1])
    assert sum(r["length"] for r in rows) == sum(len(x) for v in ids.values() for x in v)
    for r in rows:
        part = ids[r["doc_id"]][0][r["start"] : r["start"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(part, "<u4").tobytes())
        assert r["length"] <= packing.CAPACITY
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in by.values():
        at = 0
        for offset, length in sorted(seq):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
def test_local_search_never_adds_bins(lengths):
    n = np.array(lengths)
    first = packing.best_fit(n, 100)
    better = packing.local_search([list(b) for b in first], n, 100)
    assert sorted(i for b in better for i in b) == list(range(len(n)))
    assert all(n[b].sum() <= 100 for b in better)
    assert -(-n.sum() // 100) <= len(better) <= len(first)
    square = lambda bins: sum(int(n[b].sum()) ** 2 for b in bins)
    assert square(better) >= square(first)


def test_local_search_empties_bins():
    n = np.array([60, 40, 50, 50, 70, 30])
    bad = [[0, 5], [1, 2], [3], [4]]  # fills 90, 90, 50, 70
    assert len(packing.local_search(bad, n, 100)) == 3


def test_packing_quality(spark, sf_dir):
    rows = packing.best_fit_pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), WORD_BPE)
    r = rows.agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("t")).first()
    assert r["n"] <= -(-r["t"] // packing.CAPACITY) + 2


def test_the_search_does_the_packing():
    rnd = np.random.default_rng(1)
    n = np.minimum(rnd.geometric(1 / 500, 6000), 4095)
    plain = packing.next_fit(n)
    least = -(-int(n.sum()) // packing.CAPACITY)
    assert len(plain) > 1.1 * least
    assert len(packing.pack(n)) == len(packing.local_search(plain, n)) == least


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), min_size=1, max_size=9))
def test_few_pieces_need_no_more_bins_than_any_way_but_one(lengths):
    def fewest(left, rooms):  # every way to deal the pieces
        if not left:
            return len(rooms)
        n, rest = left[0], left[1:]
        ways = [fewest(rest, rooms[:i] + [r - n] + rooms[i + 1 :]) for i, r in enumerate(rooms) if r >= n and r not in rooms[:i]]
        return min([fewest(rest, [*rooms, 12 - n]), *ways])

    bins = packing.pack(np.array(lengths), 12)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert len(bins) <= fewest(sorted(lengths, reverse=True), []) + 1


def test_rounds_bring_underfull_bins_together(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "word " * (200 + 37 * i % 3000)) for i in range(300)], "doc_id long, text string")
    rows = packing.best_fit_pack(docs, WORD_BPE, group=20).collect()  # about 15 groups at first
    assert len({(r["doc_id"], r["piece"]) for r in rows}) == len(rows) >= 300
    groups = [[r["length"] for r in rows[at : at + 20]] for at in range(0, len(rows), 20)]
    apart, together = sum(len(packing.pack(np.array(g))) for g in groups), len(packing.pack(np.array(sum(groups, []))))
    assert together <= len({r["sequence_id"] for r in rows}) < apart
