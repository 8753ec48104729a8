"""The prefix trie against dictionaries of all prefixes."""

from __future__ import annotations

import hashlib
import math
import random
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from corvid.llm import trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def by_dictionary(conversations: dict[int, list[tuple[str, str]]]) -> list[tuple]:
    """Every prefix of every conversation, its members, and sums over all that start with it."""
    members: dict[tuple, list[int]] = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids: dict[tuple, int] = {}
    leaves: dict[tuple, int] = {}
    saved: dict[tuple, int] = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    for p, of in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + (len(of) - 1) * (len(p[-1][1]) if p else 0)
    out = []
    for p, of in members.items():
        ends = ",".join(str(c) for c in sorted(of) if len(conversations[c]) == len(p))
        out.append((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), kids.get(p, 0), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rebuilt(rows: list[tuple]) -> dict[int, list[tuple[str, str]]]:
    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            r, t = role or "", text or ""
            key = hashlib.sha256(f"{len(r)}:{r}{t}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, r, key, t))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, v in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = turns.get(c - int(math.fmod(c, 100)), [])[:h] + v[h:]
    return out


def rows_of(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=6), min_size=1, max_size=40), st.lists(st.integers(0, 40), max_size=8), st.sampled_from([1, 2, 1024]))
def test_ranges_cut_anywhere(paths, cuts, block):
    """Any ranges of the order give the same nodes: open stacks and blocks of ids are stitched."""
    was, trie.BLOCK = trie.BLOCK, block
    try:
        key = {x: hashlib.sha256(x.encode()).digest()[: trie.KEY] for x in "abc"}
        rows = sorted((b"".join(key[x] for x in p), [ord(x) for x in p], i) for i, p in enumerate(paths))
        edges = sorted({0, len(rows), *(c for c in cuts if c < len(rows))})
        told = [r for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) for r in trie.sweep(iter(rows[a:b]), n)]
        blocks: dict[bytes, list] = {}
        for r in told:
            if r["kind"] == "ids":
                blocks.setdefault(r["key"], []).append((r["conv_id"], r["ids"]))
        stacks = (trie.json.loads(r["stack"]) for r in told if r["kind"] == "stack")
        nodes = [r for r in told if r["kind"] == "node"] + list(trie.stitch(stacks))
        low = {n["key"]: n["conv_id"] for n in nodes}
        assert len(low) == len(nodes)
        out = []
        for n in nodes:
            ends = n["ends"] or hashlib.sha256(",".join(x for _, x in sorted(blocks[n["key"]])).encode()).hexdigest()
            out.append((n["conv_id"], n["depth"], low[n["parent"]] if n["parent"] else None, n["n_convs"], n["n_children"], n["n_leaves"], n["saved"], ends))
        assert sorted(out, key=str) == by_dictionary({i: [("", x * ord(x)) for x in p] for i, p in enumerate(paths)})
    finally:
        trie.BLOCK = was


def test_whole_table(spark, sf_dir):
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    rows = [tuple(r) for r in t.select("conv_id", "turn", "role", "text").collect()]
    want = by_dictionary(rebuilt(rows))
    for n in (1, 23):
        assert rows_of(trie.prefix_trie(t, partitions=n)) == want


def test_copies_nulls_ties_and_names(spark):
    draw = random.Random(5)
    rows = []
    for c in range(-120, 700):
        if c % 3 == 0:
            rows += [(c, t, "user", "the same") for t in range(8)]  # a third of all conversations
        else:
            rows += [(c, draw.choice([None, 0, 1, 2]), draw.choice([None, "", "user"]), draw.choice([None, "", "x", "ü" * 5])) for _ in range(draw.randrange(1, 9))]
    rows += rows[:40] + [(None, 0, "user", "nobody's")] * 3
    rows += [(705, t, "user", "y" * (t % 7)) for t in range(700)]  # a long one
    df = spark.createDataFrame([(*r, i, "k") for i, r in enumerate(rows)], "conv_id long, turn int, role string, text string, n long, key string")
    want = by_dictionary(rebuilt([(c, t, r, x) for c, t, r, x in rows]))
    assert rows_of(trie.prefix_trie(df, partitions=17)) == want
    named = df.select(*(df[c].alias(n) for c, n in (("conv_id", "path"), ("turn", "ends"), ("role", "n_convs"), ("text", "turns"))))
    assert rows_of(trie.prefix_trie(named, "path", "ends", "n_convs", "turns", partitions=3)) == want


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
    assert rows_of(trie.prefix_trie(df)) == []


def test_a_conversation_without_turns(spark):
    """Conversation 108 takes its first turns from 100, which is not there; of its own, those that h covers are replaced by nothing."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    df = spark.createDataFrame([(c, 0, "user", "a"), (c, 1, "user", "b")], "conv_id long, turn int, role string, text string")
    assert rows_of(trie.prefix_trie(df)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
