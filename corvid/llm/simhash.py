"""Near duplicates by SimHash fingerprints and pivot distance tables.

Fingerprints of 64 bits are linked at Hamming distance ``RADIUS`` or less.
By the triangle inequality, the distances of two linked fingerprints to any
pivot differ by at most RADIUS. Each fingerprint carries a table of its
distances to ``PIVOTS`` fixed reference fingerprints; a pair of which any
coordinate differs by more is discarded, and only what is left is compared.

Where the tables are compared: two words within RADIUS agree in all but RADIUS
of any blocks of bits, so every linked pair meets in a bucket of equal blocks,
and no other pairs of the corpus are looked at. This is the main step; blocks
become more, and the bits that must agree with them, as the table grows, so that
buckets of unrelated words stay at about ``BUCKET`` (:func:`blocks_for`). Buckets
are sorted by the first pivot's distance, so that a scan ends where that
coordinate alone discards the rest. A bucket of more than TILE fingerprints is
dealt out as pairs of tiles, none of it to one task. Of the links within a
bucket only a spanning forest leaves the task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup, slices, without_ids
from .graph import components

BITS, RADIUS, PIVOTS, TILE = 64, 3, 16, 512
BUCKET = 64  # unrelated fingerprints in a bucket, at most, as long as blocks can be more
SEED = 42
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def pivots(n: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed words that look random."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % i, SEED) for i in range(n)], np.uint64)


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """Majority of each bit over the hashes of all shingles (repeats included); 0 for no word."""
    data = text.encode() if isinstance(text, str) else (text or b"")
    words = WORD.findall(data.lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    grams = list(map(b" ".join, zip(*(words[i:] for i in range(shingle))))) if len(words) >= shingle else [b" ".join(words)]  # noqa: B905
    h = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), grams), np.uint64, len(grams))
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of each text as a long. One narrow pass over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(t, shingle) for t in b.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias(text_col)).mapInArrow(run, f"`{id_col}` {kind}, fp long")


def blocks_for(n: int) -> int:
    """How many blocks, for ``n`` distinct fingerprints: 5, 6 or 7, with 10, 20 or 35 keys of 25, 32 or 36 bits."""
    return next((b for b in (5, 6) if n >> (BITS * (b - RADIUS) // b) <= BUCKET), 7)


def masks(blocks: int = 5) -> list[int]:
    """The bits of each choice of blocks that two linked words can agree in."""
    agree = blocks - RADIUS
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]
    block = [sum(1 << b for b in range(cuts[i], cuts[i + 1])) for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), agree)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def close_pairs(fp: np.ndarray, group: np.ndarray, chunk: np.ndarray, across: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of rows. Rows are sorted by group and, in it, by dist[:, 0]; where ``across``, only rows of different chunks pair up."""
    left, right = [], []
    i, lag = np.arange(len(fp) - 1), 1
    while len(i):
        i = i[i + lag < len(fp)]
        j = i + lag
        live = (group[i] == group[j]) & (dist[j, 0] - dist[i, 0] <= RADIUS)  # once false, false for larger lags
        i, j = i[live], j[live]
        a, b = i, j
        if across.any():
            ok = ~across[a] | (chunk[a] != chunk[b])
            a, b = a[ok], b[ok]
        for p in range(1, dist.shape[1]):
            if not len(a):
                break
            ok = np.abs(dist[a, p] - dist[b, p]) <= RADIUS
            a, b = a[ok], b[ok]
        ok = np.bitwise_count(fp[a] ^ fp[b]) <= RADIUS
        left.append(a[ok])
        right.append(b[ok])
        lag += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (i, i)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each row the smallest row it is linked with, over any number of links."""
    label = np.arange(n)
    while len(a):
        # labels are roots here: each root hangs itself on the smallest root it is linked with, and all rows with it
        x, y = label[a], label[b]
        keep = x != y
        a, b, x, y = a[keep], b[keep], x[keep], y[keep]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
    return label


def links(distinct: DataFrame) -> DataFrame:
    """(u, v): edges that join the same distinct fingerprints (column fp) as all links within RADIUS do."""
    chosen = masks(blocks_for(distinct.count()))
    keys = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for t, m in enumerate(chosen))))
    rows = distinct.select("fp", keys.alias("k")).select("fp", "k.t", "k.key")
    full = rows.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    first = int(pivots(1)[0])
    tiled = (
        rows.join(full, ["t", "key"])
        .withColumn("k", F.ceil(F.col("n") / TILE).cast("int"))
        .withColumn("c", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
        .withColumn("other", F.explode(F.expr("sequence(0, k - 1)")))
        .select(
            F.xxhash64("t", "key", F.least("c", "other"), F.greatest("c", "other")).alias("tile"),
            "t", "key", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "c", "fp",
            F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(first)))).alias("d"),
        )
    )
    dealt = tiled.repartition("tile").sortWithinPartitions("tile", "t", "key", "i", "j", "d")
    table = pivots()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: dict[str, np.ndarray] | None = None

        def solve(x: dict[str, np.ndarray]) -> pa.RecordBatch:
            new = np.ones(len(x["fp"]), bool)
            new[1:] = False
            for c in ("tile", "t", "key", "i", "j"):
                new[1:] |= x[c][1:] != x[c][:-1]
            fp = x["fp"].view(np.uint64)
            dist = np.bitwise_count(fp[:, None] ^ table[None, :]).astype(np.int8)
            a, b = close_pairs(fp, np.cumsum(new), x["c"], x["i"] != x["j"], dist)
            label = forest(len(fp), a, b)
            at = np.flatnonzero(label != np.arange(len(fp)))
            return pa.RecordBatch.from_arrays([pa.array(x["fp"][at]), pa.array(x["fp"][label[at]])], names=["u", "v"])

        for b in batches:
            now = {n: c.to_numpy(zero_copy_only=False) for n, c in zip(b.schema.names, b.columns, strict=True)}
            if rest is not None:
                now = {k: np.concatenate([rest[k], v]) for k, v in now.items()}
            same = np.ones(len(now["fp"]), bool)  # rows of the last group, which may go on
            for c in ("tile", "t", "key", "i", "j"):
                same &= now[c] == now[c][-1:]
            if not same.all():
                yield solve({k: v[~same] for k, v in now.items()})
            rest = {k: v[same] for k, v in now.items()}
        if rest is not None and len(rest["fp"]):
            yield solve(rest)

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``docs``.

    component_id is the smallest id reachable over links. Null text counts as
    empty: fingerprint zero, linked like any other. Rows with a null id stay
    and do not lower component_id. Repeated rows give repeated results; an
    empty table gives none.
    """
    prints = cut(fingerprints(docs, shingle, id_col, text_col), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "simhash-fp")
    roots = components(links(distinct.select("fp")))
    owned = cut(distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "n", "low", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    lows = cut(owned.groupBy("root").agg(F.min("low").alias("component_id"), F.count("*").alias("m")), "simhash-lows")
    classes = cut(lookup(owned.select("fp", "n", "root"), lows, ["root"], "m").select("fp", "n", "component_id"), "simhash-classes")
    return lookup(prints, classes, ["fp"]).select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns, that have the smallest id of their component."""
    marks = cut(near_duplicates(docs, shingle, id_col, text_col), "components")
    kept = F.col(id_col).isNull() | (F.col(id_col) == F.col("component_id"))
    return without_ids(docs, marks.where(~kept).select(id_col), id_col)
