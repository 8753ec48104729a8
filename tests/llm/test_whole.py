"""Whole jobs: what earlier versions left out."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvid.llm import pii, similar, simhash


WORDS = [f"w{i}" for i in range(4000)]


def varied(seed, groups=40, copies=5, words=120):
    """Texts in groups of copies with a word in ten changed at most, a passage that many share, and texts of that passage alone."""
    rnd = random.Random(seed)
    passage = [rnd.choice(WORDS) for _ in range(60)]
    out = []
    for g in range(groups):
        base = [rnd.choice(WORDS) for _ in range(words)] + passage * (g % 2)
        for c in range(copies):
            t = list(base)
            for _ in range(c):
                t[rnd.randrange(len(t))] = rnd.choice(WORDS)
            out.append(" ".join(t))
    for c in range(60):
        t = list(passage)
        t[rnd.randrange(60)] = f"own{c}"
        out.append(" ".join(t))
    return out + ["", None, "a b", "a b", "A B c", " ".join(passage).upper()]


def grams(text):
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} - {()}


@pytest.mark.parametrize("hot", [1 << 16, 9])
def test_no_near_copy_is_left_out(spark, monkeypatch, hot):
    """Against all pairs: those whose fingerprints agree and of which each has four fifths of the other's shingles."""
    monkeypatch.setattr(similar, "HOT", hot)
    texts = varied(3)
    got = {r["doc_id"]: r["component_id"] for r in similar.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [grams(t) for t in texts]
    fp = np.stack([np.frombuffer(similar.wide_fingerprint(similar.shingles((t or "").encode())), np.uint64) for t in texts])
    alike = np.bitwise_count(fp[:, None] ^ fp[None]).sum(2) <= 51
    must, may = [], []
    for i, j in np.argwhere(np.triu(alike, 1)).tolist():
        both = len(sets[i] & sets[j])
        if both >= 0.8 * max(len(sets[i]), len(sets[j])):
            must.append((i, j))
        may.append((i, j))
    assert len(must) > 300 and len({i for p in must for i in p}) > 250
    assert all(got[i] == got[j] for i, j in must)
    label = simhash.forest(len(texts), *np.array(may).T)  # and nothing is joined but by fingerprints that agree
    assert all(label[i] == label[c] and c <= i for i, c in got.items())


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 300), min_size=1, max_size=60), st.sets(st.integers(0, 300), max_size=8), st.integers(0, 14), st.integers(0, 10**6))
def test_similar_sets_share_a_key(a, more, less, seed):
    rnd = np.random.default_rng(seed)
    hashes = rnd.integers(0, 2**64, 301, dtype=np.uint64)
    levels = rnd.integers(0, 3, 1 << 12).astype(np.uint8)
    b = (set(rnd.permutation(sorted(a)).tolist()[less:]) | more) or a
    if len(a & b) >= 0.8 * max(len(a), len(b)):
        k = [set(similar.keys_of(hashes[sorted(x)], levels).tolist()) for x in (a, b)]
        assert k[0] & k[1]


def test_frequencies_count_every_text(spark, monkeypatch):
    monkeypatch.setattr(similar, "FAN", 2)  # more than one round of sums
    texts = ["a b c d e"] * 40 + ["f g h i j", "", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    levels = similar.frequencies(df, 5, len(texts))
    slot = lambda t: int(similar.shingles(t)[0] >> np.uint64(64 - 12))
    assert levels[slot(b"a b c d e")] == 6 and levels[slot(b"f g h i j")] == 1 and levels.astype(bool).sum() == 2
    assert not similar.frequencies(df.limit(0), 5, 0).any()


PRIVATE = {
    "phone": ["+49 30 12 34 56", "+47 22 12 34 56", "+45 32 12 34 56", "+39 06 698 123", "+1 (555) 123 456", "(555) 123-4567", "555.123.4567"],
    "iban": ["GB82 WEST ABCD EFGH", "DE89 3704 0044 0532 0130 00", "XX12ABCDEFGHIJKL"],
    "email": ["a@b.co"],
    "ip": ["1.2.3.4", "10.20.30.40"],
    "ssn": ["123-45-6789"],
    "card": ["4111 1111 1111 1111", "4111111111111111"],
    "secret": ["token=abcdefghijklmnop", "API_KEY: 'abcd-efgh_ijkl-mnop", "password = " + "aB3-" * 50, "secret=" + "x7" * 5000],
    "name": ["Mr. Ab", "Frau Müller", "Госпожа Иванова", "Señora López Ruiz"],
}


def test_every_match_has_the_hint(spark):
    rows = [(kind, f"see {text} there") for kind, texts in PRIVATE.items() for text in texts]
    for m in pii.MALE.split("|") + pii.FEMALE.split("|"):
        rows.append(("name", f"{m.replace('.?', '').replace(chr(92), '')} Ab"))
    rnd = random.Random(3)
    for _ in range(2000):  # phones of all groups of digits and separators
        number = "+" + "1" * rnd.randint(1, 3) + rnd.choice([" ", ".", "-", ""]) + rnd.choice(["(" + "2" * rnd.randint(1, 4) + ")", "2" * rnd.randint(2, 4)])
        rows.append(("phone", number + "".join(rnd.choice([" ", ".", "-", ""]) + "3" * rnd.randint(2, 4) for _ in range(rnd.randint(2, 3)))))
        rows.append(("iban", "".join(rnd.choices("ABXZ", k=2)) + "12" + "".join(rnd.choice([" ", ""]) + "".join(rnd.choices("ABC7", k=4)) for _ in range(rnd.randint(3, 7)))))
    df = spark.createDataFrame(rows, "kind string, text string").select("*", F.col("text").rlike(f"(?:{pii.ANY})").alias("hit"), F.col("text").rlike(pii.HINT).alias("hint"))
    assert df.where("hit").select("kind").distinct().count() == len(PRIVATE)
    assert [r["text"] for r in df.where("hit and not hint").collect()] == []
    assert [r["text"][:40] for r in df.limit(sum(map(len, PRIVATE.values()))).where("not hit").collect()] == []


def test_numbers_alone_and_long_secrets_are_replaced(spark):
    long = "token=" + "".join(random.Random(4).choices("abcdefXYZ0189_-", k=3000))
    texts = [f"call {p} now" for p in PRIVATE["phone"]] + [long + " end", "password: " + "k9" * 600_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.replace(docs, "k")[0].collect()}
    for i, p in enumerate(PRIVATE["phone"]):
        assert p not in got[i] and re.sub(r"\d", "0", got[i]) == re.sub(r"\d", "0", texts[i])
    for i in (len(texts) - 2, len(texts) - 1):
        assert len(got[i]) == len(texts[i])
        same = sum(a == b for a, b in zip(got[i][-1000:-4], texts[i][-1000:-4], strict=True))
        assert same < 400  # the tail is replaced as the head is; characters agree by chance only


def test_short_formats_never_run_out_of_surrogates(spark):
    mails = [f"{a}@{b}.co" for a in range(10) for b in range(10)]
    out, table = pii.replace(spark.createDataFrame([(i, f"to {m} now") for i, m in enumerate(mails)], "doc_id long, text string"), "k")
    new = [r["text"] for r in out.collect()]
    assert len(set(new)) == 100 and all(re.fullmatch(r"to \w+@\w+\.co now", t) for t in new)
    assert not {r["sur"] for r in table.collect()} & set(mails)


def test_names_of_any_length_and_script(spark):
    texts = [
        "Mr John Ronald Tolkien met Tolkien; TOLKIEN and tolkienish", "Mr. Jean-Luc de la Tour d'Auvergne", "Dr. Jane Roe, and Roe", "Prof. Li Wei Mr 王伟, 王伟",
        "mail john@mail.bigcorp.com", "x" * 100 + "@b.co", "at 2001:db8::1 and fe80::1:2, at 12:30:45", "Mr. O'Neil \\E O'Neil", "clean Roe and Tour and Li",
    ]
    got = {r["doc_id"]: r["text"] for r in pii.replace(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k")[0].collect()}
    for i, gone in enumerate(["John Ronald Tolkien TOLKIEN", "Jean Luc Tour Auvergne", "Jane Roe", "Li Wei 王伟", "john mail. bigcorp", "xxx", "2001:db8::1 fe80", "Neil"]):
        words = re.findall(r"[\w:.]+", got[i])
        assert not [g for g in gone.split() if g in words or (i != 0 and g in got[i])], got[i]
    a, b, c = re.match(r"Mr \w+ \w+ (\w+) met (\w+); (\w+) and tolkienish$", got[0]).groups()
    assert a == b and a.upper() == c
    assert "12:30:45" in got[6] and got[8] == texts[8]
    assert re.fullmatch(r"Prof\. \w+ \w+ Mr (\w+), \1", got[3]), got[3]


def test_a_key_is_required(spark):
    with pytest.raises(ValueError, match="key"):
        pii.replace(spark.createDataFrame([(1, "x")], "doc_id long, text string"), "")


def plain_replacement(text, table):
    """The text with each match replaced from the table, one at a time."""
    import regex

    def checks(d):
        d = [int(c) for c in d][::-1]
        return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0

    def put(kind, canon, mention):
        new = table[kind, canon]
        if kind in ("phone", "card", "ssn"):
            left = iter(new)
            return "".join(next(left) if c.isdigit() else c for c in mention) + "".join(left)
        if kind == "iban":
            left = list(new)
            return "".join(" " if c == " " else left.pop(0) for c in mention) + "".join(left)
        return new.upper() if kind == "email" and mention.upper() == mention else new

    def one(m):
        t = m[0]
        lead = regex.match(pii.SECRET_LEAD, t)
        if "@" in t:
            return put("email", t.lower(), t)
        if lead:
            return lead[0] + put("secret", t[lead.end() :], t[lead.end() :])
        if lead := regex.match(pii.TOKEN_LEAD, t):
            return lead[0] + put("secret", t[lead.end() :], t[lead.end() :])
        if regex.fullmatch(pii.IP, t):
            return put("ip", t, t)
        digits = "".join(c for c in t if c.isdigit())
        if regex.fullmatch(r"\d{3}-\d{2}-\d{4}", t):
            return put("ssn", digits, t)
        if regex.fullmatch(pii.CARD, t):
            return put("card", digits, t) if checks(digits) else t
        if regex.match("[A-Z]{2}[0-9]{2}", t):
            return put("iban", t.replace(" ", ""), t)
        return put("phone", digits, t)

    return regex.sub("|".join((pii.EMAIL, pii.PHONE, pii.IP, pii.SSN, pii.CARD, pii.IBAN, pii.SECRET, pii.TOKEN)), one, text)


def test_replacement_against_a_plain_one(spark, sf_dir):
    rnd = random.Random(6)
    texts = []
    for _ in range(300):
        found = [rnd.choice(texts_) for kind, texts_ in PRIVATE.items() if kind != "name" for _ in range(rnd.randint(0, 2))]
        rnd.shuffle(found)
        texts.append(" ".join(x for f in found for x in (rnd.choice(["see", "(", "über", "a,"]), f, rnd.choice(["ok", ")", "!"]))))
    docs = spark.createDataFrame([(-i, t) for i, t in enumerate(texts, 1)], "doc_id long, text string").unionByName(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    out, table = pii.replace(docs, "k")
    new = {(r["kind"], r["canon"]): r["sur"] for r in table.collect()}
    assert len(set(new.values())) == len(new) > 25
    was = {r["doc_id"]: r["text"] for r in docs.collect()}
    changed = 0
    for r in out.collect():
        assert r["text"] == plain_replacement(was[r["doc_id"]], new)
        changed += r["text"] != was[r["doc_id"]]
    assert changed > 250


def test_language_stage_without_labels(spark):
    import corpus_pipeline as C

    rows = [(1, "the cat sat", None), (2, None, None), (3, "12 !", None), (4, "²½Ⅷ", None), (5, "ну", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert sorted(r["doc_id"] for r in C.language(spark, docs, "").collect()) == [1, 5]
    labelled = docs.withColumn("lang", F.lit("und"))  # a label like the mark of no language
    assert sorted(r["doc_id"] for r in C.language(spark, labelled, "").collect()) == [1, 5]
