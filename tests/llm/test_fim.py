"""Fill-in-the-middle: ropes against slices of lists, forms against the rule, and round trips."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXT = st.one_of(st.text(max_size=60), st.text(" \t\nab<PSM>ü汉\x85\xa0", max_size=120))


def plainly(text: str, doc_id, seed=42):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in (0, 8, 16, 24))
    u = UNIT.findall(text)
    n = len(u)
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    form = "spm" if h4 % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(0, 2000), st.sampled_from([1, 2, 7]))
def test_split_and_join(text, at, per_leaf):
    r = fim.rope(text, per_leaf)
    u = UNIT.findall(text)
    assert (r.units, r.points, fim.written(r)) == (len(u), len(text), text)
    k = at % (len(u) + 1)
    a, b = fim.split(r, k)
    assert (fim.written(a), fim.written(b)) == ("".join(u[:k]), "".join(u[k:])) and (a.units, b.units) == (k, len(u) - k)
    k = at % (len(text) + 1)
    a, b = fim.split(r, k, by_units=False)
    assert (fim.written(a), fim.written(b)) == (text[:k], text[k:])


@settings(max_examples=300, deadline=None)
@given(TEXT, st.integers(-5, 10**12))
def test_forms_and_round_trip(text, doc_id):
    out, n, form, pre, mid = fim.rearranged(text, doc_id, 42, 50, 80)
    assert (n, form, pre, mid, out) == plainly(text, doc_id)
    assert fim.restored(out, form) == text


def test_long_texts():
    text = "a  bc\n" * 300_000 + "x" * 500_000
    for doc_id in range(12):
        out, *rest = fim.rearranged(text, doc_id, 42, 100, 50)
        assert rest[1] in ("psm", "spm") and len(out) == len(text) + 9 and fim.restored(out, rest[1]) == text


def test_frames(spark):
    rows = [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (4, "a <S> b"), (None, "x y z"), (5, " \n "), (6, "<" * 9 + " P> S> <M")] + [(i, f"w{i} " * i) for i in range(7, 60)]
    df = spark.createDataFrame([(*r, "c", 1) for r in rows], "doc_id long, text string, output string, n int")
    made = fim.transform(df)
    told = fim.restore(made.withColumn("restored_", F.lit(0)).withColumnRenamed("restored_", "restored"))
    assert told.columns[-1] == "restored_"
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["restored_"]) for r in told.collect()), key=str)
    want = sorted(((i, *plainly(t or "", i), t or "") for i, t in rows), key=str)
    assert got == want
    d = fim.digests(df)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert sorted(map(tuple, d.collect()), key=str) == sorted(((*w[:5], sha(w[5]), sha(w[6])) for w in want), key=str)
    assert d.dtypes == [("doc_id", "bigint"), ("n", "bigint"), ("form", "string"), ("prefix_chars", "bigint"), ("middle_chars", "bigint"), ("output_sha256", "string"), ("restored_sha256", "string")]
    assert fim.digests(df.limit(0)).collect() == []
